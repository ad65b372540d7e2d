"""Helpers shared by the corpus operators: shared-folder tables, code shipping, components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import SETTINGS, discard, materialise, new_table_path, shared_folder  # noqa: F401  used by the operators beside this module
from ..session import ship as _ship


def ship(spark: SparkSession) -> None:
    """Ship the package, and send whole texts to Python in batches of bounded memory."""
    for batch in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"):
        spark.conf.set(batch, SETTINGS[batch])
    _ship(spark)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Bits of an id bitmap: a fixed 8 MB.
BITMAP_BITS = 26


def bitmap_of(names: DataFrame, column: str) -> np.ndarray:
    """Bitmap (64 bits a number) with the bits of the numbers in a bigint column, by their first ``BITMAP_BITS`` bits."""
    bits = names.select(F.shiftrightunsigned(column, 64 - BITMAP_BITS).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    found = words.toArrow()  # at most 2**(BITMAP_BITS - 6) rows of 16 bytes
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint64)


def bit_lookup(spark: SparkSession, bitmap: np.ndarray):
    """A function from a column of 64-bit names to whether their bit is set in a bitmap (``bitmap_of``)."""
    held = spark.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def marked(bit: pd.Series) -> pd.Series:
        b = bit.to_numpy()
        return pd.Series((held.value[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1) == 1)

    return lambda name: marked(F.shiftrightunsigned(name, 64 - BITMAP_BITS))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every id in ``edges`` (columns ``a`` and ``b``, bigint).

    Alternates large-star and small-star steps until only stars are left. Each step is one
    ``min`` per id (combined before the shuffle) and one equi-join, so a component of any
    size is spread over all tasks; each round is cut by a table in the shared folder.
    Ids without edges are not returned. An empty input gives an empty result. Raises if
    ``max_rounds`` rounds do not suffice (each round about halves the depth of the trees).
    """
    e = edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
    e = e.where("a is not null and b is not null and a <> b")
    e = materialise(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        old, e = e, materialise(_star_round(e), "edges")
        discard(old)
        if _are_stars(e):
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())


def _star_round(e: DataFrame) -> DataFrame:
    """A large-star and a small-star step on distinct edges ``u`` > ``v``."""
    # Large star: every larger neighbour of an id is linked with the smallest id near it.
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("m")), F.struct(F.col("v").alias("id"), F.col("v").alias("m")))).alias("x")).select("x.*")
    low = ends.groupBy("id").agg(F.min("m").alias("m"))
    e = e.join(low, e.v == low.id).select("u", F.col("m").alias("v")).distinct()
    # Small star: the smaller neighbours of u, and u, are linked with the smallest of them.
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    return e.join(low, "u").select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _are_stars(e: DataFrame) -> bool:
    """Whether each ``u`` has one ``v`` only and no ``v`` is a ``u``: then each ``v`` is the smallest id of its component."""
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(2).alias("n")), F.struct(F.col("v").alias("id"), F.lit(1).alias("n")))).alias("x")).select("x.*")
    ends = ends.groupBy("id").agg(F.sum(F.when(F.col("n") == 2, 1).otherwise(0)).alias("up"), F.min("n").alias("low"))
    return not ends.where("up > 1 or up = 1 and low = 1").limit(1).count()
