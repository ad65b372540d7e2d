"""Template vectors: embedding, nearest neighbours, drill-down, prompt rows."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import normalise_vector
from ..session import new_table_path, ship
from .numbering import number_rows

DIMENSIONS = 384
#: Queries of one block, which are broadcast.
MAX_QUERIES = 10_000


def hashed_ngrams(texts: pd.Series) -> pd.Series:
    """Default encoder: words and letter trigrams hashed with signs into ``DIMENSIONS`` numbers of length 1."""

    def one(text: str | None) -> list[float]:
        v = np.zeros(DIMENSIONS)
        for word in re.findall(r"\w+|<\w+>", (text or "").lower()):
            padded = f" {word} "
            for part, weight in [(word, 2.0), *((padded[k : k + 3], 1.0) for k in range(len(padded) - 2))]:
                h = zlib.crc32(part.encode())
                v[h % DIMENSIONS] += weight if h & 0x80000000 else -weight
        size = np.linalg.norm(v)
        return (v / size if size else v).astype(np.float32).tolist()

    return texts.map(one)


def embed_templates(counts: DataFrame, encoder: Callable[[pd.Series], pd.Series] = hashed_ngrams) -> DataFrame:
    """Vectors of length 1 for templates (``file``, ``template``, ``count``); each distinct text is encoded once."""
    encode = F.pandas_udf(encoder, "array<float>")
    distinct = counts.select("template").where("template is not null").distinct().select("template", encode("template").alias("embedding"))
    distinct = distinct.withColumn("embedding", normalise_vector(F.col("embedding")))
    return counts.join(distinct, "template").select("file", "template", F.col("count").alias("frequency"), "embedding")


def query_blocks(queries: DataFrame, size: int) -> list[DataFrame]:
    """Queries in blocks of at most ``size``, each small enough to be broadcast."""
    if queries.limit(size + 1).count() <= size:
        return [queries]
    rows = number_rows(queries, ["query_id"], name="_seq")
    n = rows.count()
    return [rows.where(F.col("_seq").between(at + 1, at + size)).drop("_seq") for at in range(0, n, size)]


def by_blocks(queries: DataFrame, search: Callable[[DataFrame], DataFrame], size: int) -> DataFrame:
    """``search`` of each block of queries, united. Of several blocks one is searched and stored at a time."""
    blocks = query_blocks(queries, size)
    if len(blocks) == 1:
        return search(blocks[0])
    path = new_table_path(queries.sparkSession, "topk")
    for block in blocks:
        found = search(block)
        found.write.mode("append").parquet(path)
    return queries.sparkSession.read.schema(found.schema).parquet(path)


def ranked(scored: DataFrame, ties: list[str], k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), *ties)
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.withColumn("similarity", F.round("similarity", 4))


def _first_k(query: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each query by falling key, then by place."""
    order = np.lexsort((-key, query))
    first = np.flatnonzero(np.diff(query[order], prepend=-1))
    return order[np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order))) < k]


def _best_rows(batches: Iterator[pa.RecordBatch], queries: dict[int, tuple[np.ndarray, np.ndarray]], ties: list[str], k: int) -> Iterator[pa.RecordBatch]:
    """Rows of a task with ``_q`` and ``similarity``: the best ``k`` of each query (by length, -1 for none: their numbers and vectors)."""
    held: list[pa.Table] = []
    waiting = 0  # vectors are not held: a row may be among the best of many queries
    numbers = sum(len(n) for n, _ in queries.values())

    def merged() -> pa.Table:
        rows = pa.concat_tables(held)
        rows = rows.take(pc.sort_indices(rows, [(c, "ascending") for c in ties], null_placement="at_start")) if ties else rows
        key = pc.fill_null(rows.column("similarity"), -np.inf).to_numpy()
        return rows.take(pa.array(_first_k(rows.column("_q").to_numpy(), np.where(np.isnan(key), np.inf, key), k)))

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if ties:  # equal similarities stay in this order
            rows = rows.take(pc.sort_indices(rows, [(c, "ascending") for c in ties], null_placement="at_start"))
        lists = rows.column("embedding").combine_chunks()
        rows = rows.drop_columns("embedding")
        size = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
        for dims, (names, wanted) in queries.items():
            has, x = np.zeros(0, np.int64), np.zeros((0, max(dims, 0)))
            if dims > 0:
                has = np.flatnonzero(size == dims)
                values = pc.cast(lists.take(pa.array(has)).flatten(), pa.float64())
                whole = values.is_valid().to_numpy(zero_copy_only=False).reshape(len(has), dims).all(1)
                x = pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False).reshape(len(has), dims)[whole]
                has = has[whole]
            for at in range(0, len(names), 500):
                score = np.full((len(rows), len(names[at : at + 500])), -np.inf)  # no number: behind all others
                score[has] = np.round(x @ wanted[at : at + 500].T, 12)
                key = np.where(np.isnan(score), np.inf, score)
                cut = np.partition(key, max(len(key) - k, 0), axis=0)[max(len(key) - k, 0)]
                query, place = np.nonzero((key >= cut).T)
                some = _first_k(query, key[place, query], k)
                query, place = query[some], place[some]
                found = score[place, query]
                held.append(rows.take(pa.array(place)).append_column("_q", pa.array(names[at:][query], pa.int32())).append_column("similarity", pa.array(found, mask=np.isneginf(found))))
                waiting += len(place)
        if waiting > 4 * k * numbers + 100_000:
            held, waiting = [merged()], 0
    if held:
        yield from merged().combine_chunks().to_batches()


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` rows of largest inner product with each query (``query_id``, ``query``), exactly.

    Queries are made unit vectors and broadcast, in blocks of at most ``MAX_QUERIES``; a
    query's rows are complete inside its block, so its ``query_id`` must be its own. Vectors
    are never shuffled: each task multiplies its batches with the queries as matrices, in
    double precision to twelve digits, and sends on ``k`` rows a query. Ties are taken by the
    other columns, which must be plain ones. A pair of different lengths, or with a null
    or nothing in it, has a null similarity and comes last. Returns ``query_id``, the other
    columns without ``embedding``, ``similarity`` (four digits) and ``rank``.
    """
    spark = vectors.sparkSession
    ship(spark)
    held = queries.select("query_id", normalise_vector(F.col("query")).alias("query"))
    ties = [c for c in vectors.columns if c != "embedding"]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in vectors.schema.fields if f.name != "embedding")
    kind = queries.schema["query_id"].dataType.simpleString()

    def search(block: DataFrame) -> DataFrame:
        rows = block.collect()  # a block of queries
        by_size: dict[int, list[int]] = {}
        for n, r in enumerate(rows):
            by_size.setdefault(-1 if not r.query or None in r.query else len(r.query), []).append(n)
        asked = {d: (np.array(ns, np.int32), np.array([rows[n].query if d > 0 else [] for n in ns], float).reshape(len(ns), max(d, 0))) for d, ns in by_size.items()}
        known = spark.sparkContext.broadcast(asked)
        best = vectors.mapInArrow(lambda b: _best_rows(b, known.value, ties, k), f"{fields}_q int, similarity double")
        names = spark.createDataFrame([(n, r.query_id) for n, r in enumerate(rows)], f"_q int, query_id {kind}")
        return ranked(best.join(F.broadcast(names), "_q").drop("_q"), ties, k)

    return by_blocks(held, search, MAX_QUERIES)


def drilldown_hits(hits: DataFrame, parsed: DataFrame) -> DataFrame:
    """The parsed lines of search hits, by file and template."""
    return hits.select("file", "template").distinct().join(parsed, ["file", "template"])


def prompt_rows(hits: DataFrame, limit: int = 50) -> DataFrame:
    """Per file one prompt text: its ``limit`` most frequent retrieved templates as JSON lines."""
    ranked = hits.withColumn("rn", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("frequency"), "template"))).where(F.col("rn") <= limit)
    entry = F.to_json(F.struct(F.col("file").alias("filename"), "template", "frequency"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rn", entry.alias("e")))), lambda x: x["e"])
    return ranked.groupBy("file").agg(F.array_join(lines, "\n").alias("prompt"))
