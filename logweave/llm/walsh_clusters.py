"""Clustering of integer vectors around centroids, searched progressively in Walsh-Hadamard coefficients."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, ship

SIZE = 64
#: Coefficients that have been compared after each step.
STEPS = (1, 2, 4, 8, 16, 32, 64)
#: Integers reach this far at most, so that 64 squared differences of coefficients fit a long.
LIMIT = 1 << 24
#: Vectors searched at once.
BLOCK = 4096


def _coarse_to_fine() -> np.ndarray:
    """The coefficients' positions by rising number of sign changes."""
    signs = np.array([[(i & j).bit_count() & 1 for j in range(SIZE)] for i in range(SIZE)])
    return np.argsort((np.diff(signs, axis=1) != 0).sum(1), kind="stable")


_ORDER = _coarse_to_fine()


def walsh_hadamard(x: np.ndarray) -> np.ndarray:
    """Exact integer transform of rows of 64 integers, coarse coefficients first.

    Squared distances of transforms are 64 times those of the rows.
    """
    x = x.astype(np.int64)
    step = 1
    while step < SIZE:
        pairs = x.reshape(len(x), SIZE // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(x), SIZE)
        step *= 2
    return x[:, _ORDER]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid to each row (ties: the smallest), and the squared distance.

    Differences of coefficients are added up from coarse to fine. At each step the centroid
    that leads a row is finished over all coefficients; those whose part is larger already
    than the least finished sum (strictly, so that ties live) are given up. What is left
    after all 64 coefficients is compared exactly.
    """
    rows, centres = walsh_hadamard(x), walsh_hadamard(centroids)
    n, k = len(rows), len(centres)
    row, col = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    part = np.zeros(n * k, np.int64)
    least = np.full(n, np.iinfo(np.int64).max)
    before = 0
    for stop in STEPS:
        part += ((rows[row, before:stop] - centres[col, before:stop]) ** 2).sum(1)
        before = stop
        first = np.flatnonzero(np.diff(row, prepend=-1))
        low = np.minimum.reduceat(part, first) if len(first) else part[:0]
        leads = np.flatnonzero(part == np.repeat(low, np.diff(first, append=len(row))))
        leads = leads[np.diff(row[leads], prepend=-1) != 0]
        finished = part[leads] + ((rows[row[leads], stop:] - centres[col[leads], stop:]) ** 2).sum(1)
        least = np.minimum(least, finished)
        if stop < SIZE:
            live = part <= least[row]
            row, col, part = row[live], col[live], part[live]
    return col[leads], part[leads] // SIZE


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, vectors) of blocks of a batch."""
    for first in range(0, len(batch), BLOCK):
        part = batch.column("v").slice(first, BLOCK)
        yield first, part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), SIZE)


def _sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Number and sum of the vectors nearest to each centroid: one row a centroid and task, added by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), SIZE), np.int64)
        for batch in batches:
            for _, x in _rows(batch):
                at, _ = nearest(x, centroids)
                np.add.at(sums, at, x)
                counts += np.bincount(at, minlength=len(centroids))
        some = np.flatnonzero(counts)
        out = [pa.array(some, pa.int32()), pa.array(counts[some])] + [pa.array(sums[some, j]) for j in range(SIZE)]
        yield pa.RecordBatch.from_arrays(out, ["cluster", "n", *(f"s{j}" for j in range(SIZE))])

    parts = vectors.select("v").mapInArrow(run, "cluster int, n bigint, " + ", ".join(f"s{j} bigint" for j in range(SIZE)))
    found = parts.groupBy("cluster").agg(F.sum("n"), *[F.sum(f"s{j}") for j in range(SIZE)]).collect()  # a row a centroid
    return {r[0]: (r[1], list(r[2:])) for r in found}


def centroid_text(centroid: np.ndarray) -> str:
    """Lowercase hex sha256 of a centroid's numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster_vectors(vectors: DataFrame, clusters: int = 16, rounds: int = 3, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Vectors of 64 finite components, as integers ``floor(64 * x)``, around ``clusters`` centroids.

    Centroids start as the vectors with the smallest sha256 of ``<seed>:<id>``. Each round
    assigns every vector to its nearest centroid (``nearest``) and puts each non-empty
    centroid to the floor of its vectors' mean; then all are assigned once more. A round reads
    all vectors and shuffles one row a centroid and task; a bounded number of centroids goes
    to the tasks.

    Left out are vectors that are null, of another length, or with a component that is null,
    not finite or so large (from 2**24 on as an integer) that squared distances would not fit
    a long. Rows of one id are each a vector; rows without an id are no starting centroid.
    With fewer vectors than ``clusters`` there are as many centroids as vectors with an id
    (none: every row is left out). Other columns are ignored. An empty table gives an empty
    result.

    Returns ``id_col``, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia``,
    ``centroid_sha256``.
    """
    spark = vectors.sparkSession
    ship(spark)
    fits = F.forall(vector_col, lambda x: F.coalesce(F.abs(x.cast("double") * 64) < LIMIT, F.lit(False)))
    ints = F.transform(vector_col, lambda x: F.floor(x.cast("double") * 64).cast("int"))
    kind = vectors.schema[id_col].dataType.simpleString()
    kept = vectors.where((F.size(vector_col) == SIZE) & fits).select(F.col(id_col).alias("id"), ints.alias("v"))
    table = materialise(kept, "vectors")
    first = table.where("id is not null").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), "v").limit(clusters).collect()
    centroids = np.array([r.v for r in first], np.int64).reshape(len(first), SIZE)
    for _ in range(rounds if len(first) else 0):
        for k, (n, sums) in _sums(table, centroids).items():
            centroids[k] = [s // n for s in sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, x in _rows(batch):
                at, distance = nearest(x, centroids)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(begin, len(x)), pa.array(at, pa.int32()), pa.array(distance)], ["id", "cluster", "distance"])

    found = (table if len(first) else table.limit(0)).mapInArrow(run, f"id {kind}, cluster int, distance bigint")
    found = materialise(found, "clusters")
    discard(table)
    inertia = {r[0]: r[1] for r in found.groupBy("cluster").agg(F.sum("distance")).collect()}  # a row a centroid
    totals = [(k, inertia.get(k, 0), sum(inertia.values()), centroid_text(c)) for k, c in enumerate(centroids)]
    known = spark.createDataFrame(totals, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
