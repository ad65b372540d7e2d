"""Near-duplicate vectors by counted collisions on many one-dimensional projections."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialise, partitions, ship

#: Collisions that make a pair a candidate; chance that a pair at the limit has fewer.
COLLISIONS, MISS = 2, 1e-6
#: Vectors of the largest group expected in one tail; share of a tail: at least, at most.
IN_TAIL, SHARES = 10, (2.5e-4, 2e-3)
#: Half a window, as a multiple of the standard deviation between vectors at the limit.
WIDTH = 1.25
#: Projections in which a vector looks for a leader.
LEADERS = 3


@dataclass(frozen=True)
class Projections:
    """count: number of random directions; tail: value from which on a vector takes part; window: largest distance of a collision."""

    count: int
    tail: float
    window: float


def calibrate(largest: int, similarity: float) -> Projections:
    """Projections for groups of at most ``largest`` vectors.

    Unit vectors projected on Gaussian directions are normal. Only values beyond ``tail`` take part, where few of the other vectors are: for larger groups
    the tail gets thinner and the directions more. Their number makes the expected count of
    collisions of a pair at the limit so large that a Poisson count stays under
    ``COLLISIONS`` with a probability of at most ``MISS``.
    """
    share = min(max(IN_TAIL / max(largest, 1), SHARES[0]), SHARES[1])
    upper = np.linspace(0, 8, 80_001)
    beyond = np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in upper])
    tail = float(upper[np.argmax(beyond <= share)])
    spread = math.sqrt(1 - similarity**2)
    window = WIDTH * math.sqrt(2 - 2 * similarity)
    x = np.linspace(tail, tail + 4, 4001)
    density = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    normal = lambda v: 0.5 * np.array([math.erfc(-t / math.sqrt(2)) for t in v])
    inside = normal((x + window - similarity * x) / spread) - normal((np.maximum(x - window, tail) - similarity * x) / spread)
    each = 2 * float(np.sum(density * inside) * (x[1] - x[0]))  # both ends of a direction
    need = COLLISIONS
    while math.exp(-need) * sum(need**k / math.factorial(k) for k in range(COLLISIONS)) > MISS:
        need += 0.25
    return Projections(math.ceil(need / each), tail, window)


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """Rows of equal length as an array in double precision."""
    values = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(batch.num_rows, -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_size(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their unit vectors) for each length of vectors in a batch."""
    sizes = pc.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, _unit(_matrix(batch.take(pa.array(rows)), column))


def _entries(vectors: DataFrame, plan: Projections) -> DataFrame:
    """One row per vector and tail it lies in: ``group``, ``tail``, ``value``, ``id``, ``leader``, ``rank`` (0: the farthest out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions: dict[int, np.ndarray] = {}
        for batch in batches:
            for rows, x in _by_size(batch, "v"):
                d = x.shape[1]
                if d not in directions:
                    directions[d] = np.random.default_rng(20_011 + d).standard_normal((d, plan.count))
                for at in range(0, len(rows), 256):
                    p = x[at : at + 256] @ directions[d]
                    i, j = np.nonzero(np.abs(p) >= plan.tail)
                    value = p[i, j]
                    order = np.lexsort((-np.abs(value), i))
                    i, j, value = i[order], j[order], value[order]
                    first = np.searchsorted(i, np.arange(p.shape[0]))
                    taken = pa.array(rows[at + i])
                    out = {
                        "grp": batch.column("grp").take(taken),
                        "tail": pa.array((2 * j + (value < 0)).astype(np.int32)),
                        "value": pa.array(np.abs(value)),
                        "id": batch.column("id").take(taken),
                        "leader": batch.column("leader").take(taken),
                        "rank": pa.array((np.arange(len(i)) - first[i]).astype(np.int32)),
                    }
                    yield pa.RecordBatch.from_pydict(out)

    return vectors.select("grp", "id", "leader", "v").mapInArrow(run, "grp string, tail int, value double, id bigint, leader bigint, rank int")


def _reaching(pairs: DataFrame, vectors: DataFrame, limit: float) -> DataFrame:
    """The pairs (``a``, ``b``) whose cosine reaches ``limit``, in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            sizes = pc.list_value_length(batch.column("va")).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                part = batch.take(pa.array(rows))
                x, y = _matrix(part, "va"), _matrix(part, "vb")
                x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
                ok[rows] = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y)) >= limit
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(ok))

    one = vectors.select(F.col("id").alias("a"), F.col("v").alias("va"))
    two = vectors.select(F.col("id").alias("b"), F.col("v").alias("vb"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").mapInArrow(run, "a bigint, b bigint")


def _collisions(entries: DataFrame, window: float) -> DataFrame:
    """Pairs within a window of one tail, less those of one leader: ``a`` < ``b``, a row each time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            fresh = batch.num_rows
            if held is not None and held.num_rows:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            old = batch.num_rows - fresh
            group, tail, value, ids, leader = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "tail", "value", "id", "leader"))
            change = np.concatenate([[False], (group[1:] != group[:-1]) | (tail[1:] != tail[:-1])])
            run_of = np.cumsum(change)
            k = 1
            while k < batch.num_rows:
                near = (run_of[k:] == run_of[:-k]) & (value[k:] - value[:-k] <= window)
                near[: max(0, old - k)] = False  # both were there before
                if not near.any():
                    if k >= old:
                        break
                else:
                    i = np.flatnonzero(near & (leader[k:] != leader[:-k]))
                    if len(i):
                        x, y = ids[i], ids[i + k]
                        yield pa.RecordBatch.from_pydict({"a": np.minimum(x, y), "b": np.maximum(x, y)})
                k += 1
            last = (run_of == run_of[-1]) & (value >= value[-1] - window)
            held = batch.slice(int(np.argmax(last)))

    ordered = entries.select("grp", "tail", "value", "id", "leader").repartition(partitions(entries.sparkSession), "grp", "tail").sortWithinPartitions("grp", "tail", "value", "id")
    return ordered.mapInArrow(run, "a bigint, b bigint")


def vector_links(vectors: DataFrame, similarity: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "label") -> DataFrame:
    """Links between vectors of one group whose cosine reaches ``similarity``, and their components.

    Method: vectors are projected on many random directions (``calibrate``). First, vectors
    that lie farthest out in the same tail get its smallest id as leader, if their angle to
    it is at most half of that allowed: all vectors of one leader are then linked with each
    other, and their pairs are counted without being made. Then each tail is sorted; pairs
    of different leaders within a window centred on one of them collide there, collisions
    are counted per pair, and pairs with at least ``COLLISIONS`` are verified by their
    cosine. Whole ids, never texts or vectors, are shuffled for the counts.

    Returns per row the id, ``n_links`` (vectors linked directly), ``component_id`` (smallest
    id reachable, itself included), ``kept`` (whether it is that id). Null vectors, empty
    ones, zero ones, those with null or non-finite components, and rows with a null group
    link with nothing; vectors of different length do not compare. Rows of equal id are one
    vector (the first by value); null ids link with nothing and keep a null component. An
    empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = F.col(vector_col)
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(sound & F.col(group_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("bigint").alias("id"), F.concat_ws(":", F.col(group_col).cast("string"), F.size(v)).alias("grp"), v.alias("v"))
    rows = materialise(rows.groupBy("id").agg(F.min(F.struct("grp", "v")).alias("x")).select("id", "x.grp", "x.v"), "vectors")
    largest = rows.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    plan = calibrate(largest, similarity)

    out_there = _entries(rows.withColumn("leader", F.col("id")), plan).where(F.col("rank") < LEADERS)
    lead = out_there.groupBy("grp", "tail").agg(F.min("id").alias("a"))
    offers = out_there.select("grp", "tail", F.col("id").alias("b")).join(lead, ["grp", "tail"]).where("a <> b").select("a", "b").distinct()
    half = math.cos(math.acos(similarity) / 2) + 1e-9
    led = _reaching(offers, rows, half).groupBy(F.col("b").alias("id")).agg(F.min("a").alias("leader"))
    units = rows.join(led, "id", "left").withColumn("leader", F.coalesce("leader", "id"))
    units = materialise(units, "led")

    counted = _collisions(_entries(units, plan), plan.window).groupBy("a", "b").count().where(F.col("count") >= COLLISIONS)
    links = materialise(_reaching(counted, rows, similarity), "links")
    groups = connected_components(links.union(units.select(F.col("leader").alias("a"), F.col("id").alias("b"))))
    of_leader = units.groupBy("leader").agg((F.count("*") - 1).alias("within"))
    outside = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("outside"))
    found = units.select("id", "leader").join(of_leader, "leader").join(outside, "id", "left").join(groups, "id", "left")
    found = found.select(F.col("id").alias("_id"), (F.col("within") + F.coalesce("outside", F.lit(0))).alias("n_links"), "component_id")
    out = vectors.select(id_col).join(found, F.col(id_col) == F.col("_id"), "left")
    component = F.coalesce("component_id", F.col(id_col).cast("bigint"))
    return out.select(id_col, F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col(id_col), F.lit(True)).alias("kept"))
