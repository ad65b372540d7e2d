"""Running numbers and neighbours of rows in a total order, shared out to all tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def number_rows(rows: DataFrame, order: Sequence[Column | str], group: Sequence[str] = (), name: str = "seq") -> DataFrame:
    """``rows`` with a running number from 1 on (``name``) by ``order``, in each ``group`` apart.

    Rows are dealt out by ranges of group and order, sorted in each range and stored; a row's
    number is its place in its range plus the rows of the ranges before it, of which there are
    as many as partitions. No window runs over all rows or over a group, so a group of any
    size is spread over many tasks. Rows that are equal in all of ``order`` lie in one range
    and are numbered in any order.
    """
    keys = [*map(F.col, group), *(F.col(c) if isinstance(c, str) else c for c in order)]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    stored = materialise(placed, "numbered")
    part = F.shiftright("_at", 33)
    before, offsets = 0, []
    for p, n in sorted(map(tuple, stored.groupBy(part).count().collect())):  # a row a partition
        offsets.append((p, before))
        before += n
    known = F.broadcast(rows.sparkSession.createDataFrame(offsets, "_part bigint, _before bigint"))
    number = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    out = stored.join(known, part == F.col("_part")).withColumn(name, number).drop("_at", "_part", "_before")
    if not group:
        return out
    same = [F.col(g).eqNullSafe(F.col(f"_g{k}")) for k, g in enumerate(group)]
    firsts = out.groupBy(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)]).agg(F.min(name).alias("_first"))
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return out.join(firsts, cond).withColumn(name, F.col(name) - F.col("_first") + 1).drop("_first", *[f"_g{k}" for k in range(len(group))])


def with_next(rows: DataFrame, order: Sequence[Column | str], columns: Sequence[str]) -> DataFrame:
    """``rows`` with ``next_<column>`` of the row behind by ``order`` for each of ``columns``; null at the end."""
    numbered = number_rows(rows, order, name="_seq")
    behind = numbered.select((F.col("_seq") - 1).alias("_seq"), *[F.col(c).alias(f"next_{c}") for c in columns])
    return numbered.join(behind, "_seq", "left").drop("_seq")
