"""Vector arithmetic on arrays, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inner_product(a: Column, b: Column) -> Column:
    """Sum of products in double precision; null if either is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalise_vector(a: Column) -> Column:
    """The vector at length 1, as floats; a zero vector stays as it is."""
    size = F.sqrt(inner_product(a, a))
    return F.when(size > 0, F.transform(a, lambda x: (x / size).cast("float"))).otherwise(F.transform(a, lambda x: x.cast("float")))
