"""A stored index of vectors: coarse lists, product-quantised residuals, exact re-ranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import inner_product, normalise_vector
from ..session import new_table_path, ship
from .vectors import by_blocks, ranked

#: Vectors that centroids are fitted on, about; lists and codewords of a part at most.
SAMPLE, MAX_LISTS, CODEWORDS = 20_000, 4096, 256
#: Components of one part of a residual: a byte for two floats.
PART = 2
#: Queries of a block, and the calibration's queries.
QUERY_BLOCK, TRIALS = 1000, 300
#: Recall that lists alone, and lists with re-ranking, reach on the sample.
LIST_RECALL, RECALL = 0.98, 0.97


def _kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """``k`` centroids of the rows of ``x`` (a bounded sample); fewer if there are fewer different rows."""
    r = np.random.default_rng(seed)
    start = np.unique(x, axis=0)
    c = start[r.permutation(len(start))[:k]].astype(np.float32)
    for _ in range(rounds):
        at = _closest(x, c)
        n = np.bincount(at, minlength=len(c))
        order = np.argsort(at, kind="stable")
        cuts = np.flatnonzero(np.diff(at[order], prepend=-1))
        c[n > 0] = np.add.reduceat(x[order], cuts, axis=0) / n[n > 0, None]
        c[n == 0] = x[r.integers(0, len(x), int((n == 0).sum()))]
    return c


def _closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    size = (c * c).sum(1)
    return np.concatenate([np.argmin(size - 2 * (x[k : k + 8192] @ c.T), 1) for k in range(0, len(x), 8192)]) if len(x) else np.zeros(0, int)


@dataclass
class VectorIndex:
    """``model``: what searches need (``coarse`` centroids, ``books`` of codewords, ``probes``, ``rerank``, ``dims``);
    ``path``: the table of all vectors, by list: ``_row``, ``_code``, ``embedding`` and the other columns."""

    spark: SparkSession
    path: str
    coarse: np.ndarray
    books: np.ndarray
    probes: int
    rerank: int
    dims: int
    schema: str

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/lists")

    def list_sizes(self) -> dict[int, int]:
        """Vectors of each list that has any: a row a list."""
        return {r[0]: r[1] for r in self.table().groupBy("_list").count().collect()}


def _encode(x: np.ndarray, coarse: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The list of each row, and the codeword of each part of its residual."""
    at = _closest(x, coarse)
    rest = _parts(x - coarse[at], len(books))
    return at, np.stack([_closest(rest[:, m], books[m]) for m in range(len(books))], 1).astype(np.uint8)


def _parts(x: np.ndarray, parts: int) -> np.ndarray:
    """Rows as ``parts`` parts each, with zeros behind the last component."""
    out = np.zeros((len(x), parts * PART), np.float32)
    out[:, : x.shape[1]] = x
    return out.reshape(len(x), parts, PART)


def _table_scores(query: np.ndarray, books: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Inner products of queries with the codewords of coded residuals: rows by queries."""
    tables = np.einsum("qmp,mwp->mwq", _parts(query, len(books)), books)
    out = np.zeros((len(codes), len(query)), np.float32)
    for m in range(len(books)):
        out += tables[m][codes[:, m]]
    return out


def _calibrate(x: np.ndarray, coarse: np.ndarray, books: np.ndarray, k: int, n: int) -> tuple[int, int]:
    """The fewest lists, then the fewest re-ranked rows a query, with which the sample's own neighbours are found.

    The number of rows grows with the square root of how many more vectors than the sample there are.
    """
    r = np.random.default_rng(11)
    own = r.permutation(len(x))[:TRIALS]
    at, codes = _encode(x, coarse, books)
    score = x[own] @ x.T
    score[np.arange(len(own)), own] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return len(coarse), 10
    true = np.argpartition(-score, k - 1, axis=1)[:, :k]
    near = np.argsort(-(x[own] @ coarse.T), axis=1, kind="stable")
    place = np.empty_like(near)
    np.put_along_axis(place, near, np.arange(len(coarse))[None], 1)
    needed = np.sort(np.take_along_axis(place, at[true], 1).ravel()) + 1
    probes = int(needed[min(len(needed) - 1, int(np.ceil(LIST_RECALL * len(needed))) - 1)])
    ranks = []
    for q, i in enumerate(own):
        rows = np.flatnonzero(place[q][at] < probes)
        rows = rows[rows != i]
        guess = (x[i] @ coarse[at[rows]].T) + _table_scores(x[i : i + 1], books, codes[rows])[:, 0]
        rank = np.empty(len(x))
        rank[:] = np.inf
        rank[rows[np.argsort(-guess, kind="stable")]] = np.arange(1, len(rows) + 1)
        ranks.extend(rank[true[q]])
    ranks = np.sort(ranks)
    found = ranks[min(len(ranks) - 1, int(np.ceil(RECALL * len(ranks))) - 1)]
    rerank = int(found) if np.isfinite(found) else int(ranks[np.isfinite(ranks)].max())
    return probes, max(2 * k, int(np.ceil(rerank * max(1.0, n / len(x)) ** 0.5)))


def build_vector_index(vectors: DataFrame, path: str | None = None, lists: int | None = None, k: int = 10) -> VectorIndex:
    """An index of vectors (``embedding`` and any other columns) below ``path``, or a new folder.

    Fitted on a sample of about ``SAMPLE`` rows, taken by a hash: ``lists`` coarse centroids
    (about the root of the number of vectors, ``MAX_LISTS`` at most) and codewords of the
    residuals' parts; how many lists a query looks into, and how many rows it compares
    exactly, follow from the recall of ``k`` neighbours in the sample. Every vector is then
    put into its nearest list with the code of its residual; rows are dealt out by ranges of
    list and row, so that a list of any size is shared out. Rows whose vector is null, holds
    null or not finite components, or is not as long as most of the sample, are left out.
    """
    spark = vectors.sparkSession
    ship(spark)
    path = path or new_table_path(spark, "vector-index")
    fine = vectors.where(F.size("embedding") > 0).where(F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))
    n = fine.count()
    picked = fine.select("embedding").where(F.pmod(F.xxhash64("embedding"), F.lit(max(1, n // SAMPLE))) == 0).limit(2 * SAMPLE)
    sample = [np.asarray(r[0], np.float32) for r in picked.collect()] or [np.asarray(r[0], np.float32) for r in fine.select("embedding").limit(1).collect()]
    lengths = [len(v) for v in sample]
    dims = max(set(lengths), key=lambda d: (lengths.count(d), d)) if sample else 1
    x = np.array([v for v in sample if len(v) == dims], np.float32).reshape(-1, dims)
    if len(x):
        coarse = _kmeans(x, min(MAX_LISTS, lists or max(1, round(n**0.5)), max(1, len(x) // 8)))
        rest = _parts(x - coarse[_closest(x, coarse)], -(-dims // PART))
        found = [_kmeans(rest[:, m], CODEWORDS) for m in range(rest.shape[1])]
        books = np.stack([np.resize(b, (CODEWORDS, PART)) for b in found])
        probes, rerank = _calibrate(x, coarse, books, k, n)
    else:
        coarse, books, probes, rerank = np.zeros((1, dims), np.float32), np.zeros((-(-dims // PART), 1, PART), np.float32), 1, 1
    held = spark.sparkContext.broadcast((coarse, books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(batch), dims)
            at, codes = _encode(v, *held.value)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32()), packed], [*batch.schema.names, "_list", "_code"])

    rows = fine.where(F.size("embedding") == dims).withColumn("_row", F.monotonically_increasing_id())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    coded = rows.mapInArrow(run, f"{schema}, _list int, _code binary")
    schema += ", _code binary, _list int"
    coded.repartitionByRange("_list", "_row").write.partitionBy("_list").parquet(f"{path}/lists")
    model = [(coarse.tobytes(), books.tobytes(), len(coarse), books.shape[1], probes, rerank, dims, schema)]
    spark.createDataFrame(model, "coarse binary, books binary, lists int, words int, probes int, rerank int, dims int, columns string").coalesce(1).write.parquet(f"{path}/model")
    return VectorIndex(spark, path, coarse, books, probes, rerank, dims, schema)


def open_vector_index(spark: SparkSession, path: str) -> VectorIndex:
    """The index that ``build_vector_index`` has stored below ``path``."""
    r = spark.read.parquet(f"{path}/model").first()
    coarse = np.frombuffer(r.coarse, np.float32).reshape(r.lists, r.dims)
    return VectorIndex(spark, path, coarse, np.frombuffer(r.books, np.float32).reshape(-1, r.words, PART), r.probes, r.rerank, r.dims, r.columns)


def probed_lists(index: VectorIndex, queries: np.ndarray, probes: int | None = None) -> np.ndarray:
    """The lists that each query (a row) looks into, the nearest first."""
    return np.argsort(-(queries @ index.coarse.T), axis=1, kind="stable")[:, : probes or index.probes]


def search_index(index: VectorIndex, queries: DataFrame, k: int = 5, probes: int | None = None, rerank: int | None = None) -> DataFrame:
    """About the ``k`` rows of largest inner product with each query (``query_id``, ``query``), by an index.

    Only the lists that some query looks into are read, and of those the codes: each task
    keeps the best ``rerank`` rows of each query by coded residuals, and of all tasks' rows
    the best ``rerank`` are compared exactly. Queries are made unit vectors and broadcast in
    blocks of ``QUERY_BLOCK``; queries that are null or of another length have no rows. The
    result has the columns of ``vector_topk``.
    """
    ship(index.spark)
    held = queries.where(F.size("query") == index.dims).select("query_id", normalise_vector(F.col("query")).alias("query"))
    take = max(rerank or index.rerank, k)
    books, coarse = index.books, index.coarse

    def search(block: DataFrame) -> DataFrame:
        rows = block.select("query_id", "query").collect()  # a block of queries
        wanted = np.array([r.query for r in rows], np.float32).reshape(len(rows), index.dims)
        lists = probed_lists(index, wanted, probes)
        asking: dict[int, np.ndarray] = {int(v): np.flatnonzero((lists == v).any(1)) for v in np.unique(lists)}
        known = index.spark.sparkContext.broadcast((wanted, asking))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query, asked = known.value
            best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)]

            def cut() -> None:
                order = np.lexsort((best[1], -best[2], best[0]))
                q = best[0][order]
                first = np.flatnonzero(np.diff(q, prepend=-1))
                keep = order[np.arange(len(q)) - np.repeat(first, np.diff(first, append=len(q))) < take]
                best[:] = [b[keep] for b in best]

            for batch in batches:
                at = batch.column("_list").to_numpy()
                names = batch.column("_row").to_numpy()
                codes = np.frombuffer(b"".join(batch.column("_code").to_pylist()), np.uint8).reshape(len(batch), len(books))
                for v in np.unique(at).tolist():
                    here, qs = np.flatnonzero(at == v), asked[v]
                    score = _table_scores(query[qs], books, codes[here]) + (query[qs] @ coarse[v])[None]
                    best[:] = [np.concatenate([b, x]) for b, x in zip(best, (np.tile(qs, len(here)), np.repeat(names[here], len(qs)), score.ravel()))]
                    if len(best[0]) > 4 * take * len(query) + 1_000_000:
                        cut()
            cut()
            yield pa.RecordBatch.from_arrays([pa.array(best[0], pa.int32()), pa.array(best[1]), pa.array(best[2], pa.float32())], ["_q", "_row", "_score"])

        table = index.table().where(F.col("_list").isin(list(asking)))
        found = table.select("_list", "_row", "_code").mapInArrow(run, "_q int, _row bigint, _score float")
        few = found.groupBy("_q").agg(F.slice(F.sort_array(F.collect_list(F.struct("_score", F.col("_row"))), False), 1, take).alias("b"))  # a few rows a task
        few = few.select("_q", F.explode("b").alias("b")).select("_q", F.col("b._row").alias("_row"))
        known_queries = index.spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], f"_q int, query_id {block.schema['query_id'].dataType.simpleString()}, query array<float>")
        pairs = table.drop("_code", "_list").join(few, "_row").join(F.broadcast(known_queries), "_q")
        scored = pairs.withColumn("similarity", inner_product(F.col("embedding"), F.col("query"))).drop("_q", "_row", "query")
        ties = [c for c in scored.columns if c not in ("embedding", "query_id", "similarity")]
        return ranked(scored, ties, k)

    return by_blocks(held, search, QUERY_BLOCK)


def approx_topk(vectors: DataFrame, queries: DataFrame | list[float], k: int = 5) -> DataFrame:
    """About the ``k`` rows of largest inner product with each query (or one list), by an index made for it.

    For repeated searches, keep the index: ``build_vector_index``, ``search_index``.
    """
    if not isinstance(queries, DataFrame):
        queries = vectors.sparkSession.createDataFrame([(0, [float(x) for x in queries])], "query_id int, query array<double>")
    return search_index(build_vector_index(vectors, k=max(k, 10)), queries, k)
