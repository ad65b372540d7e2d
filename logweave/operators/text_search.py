"""Search for templates by text: tf-idf weights, an inverted index in segments, the lines behind the hits."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import new_table_path, ship
from .numbering import number_rows
from .vectors import by_blocks, drilldown_hits

#: Entries of a segment, the unit that one task scores; queries of a block; terms that a scan is filtered by.
SEGMENT, QUERY_BLOCK, FILTER_TERMS = 2048, 4000, 500
#: Queries scored at once. From so many pairs of an entry and a query on, a term's scores are a product of
#: matrices of so many terms; below, its pairs are made and added up, so many at a time.
TABLE_QUERIES, DENSE_PAIRS, DENSE_TERMS, ADDED_PAIRS = 256, 4096, 256, 1 << 18
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: Column) -> Column:
    """Runs of letters, digits and characters beyond ASCII, with A to Z in lower case."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_TERM), 0)


@dataclass
class TextIndex:
    """Tables below ``path``: ``entries`` (``entry``, ``file``, ``template``, ``frequency``), ``weights``
    (``term``, ``idf``) and ``postings`` (``segment``, ``term``, places in the segment, weights)."""

    spark: SparkSession
    path: str
    segment: int = SEGMENT

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


def _slices(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of runs of ``lens`` from ``starts`` on."""
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)


def _segments(batches: Iterator[pa.RecordBatch], reduce: Callable[[pa.RecordBatch], pa.RecordBatch] = lambda b: b) -> Iterator[tuple[int, pa.Table]]:
    """Each segment of batches sorted by ``segment``, and its rows, of which ``reduce`` makes those that are held."""
    now, held = None, []
    for batch in batches:
        numbers = batch.column("segment").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
        for first, stop in zip(cuts, cuts[1:]):
            if stop == first:
                continue
            if numbers[first] != now:
                if held:
                    yield now, pa.Table.from_batches(held)
                now, held = int(numbers[first]), []
            held.append(reduce(batch.slice(first, stop - first)))
    if held:
        yield now, pa.Table.from_batches(held)


def _flat(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and the length of each list."""
    lists = table.column(name).combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``segment``, ``place`` and ``terms`` as one of each segment and term, with its places and how often it stands there."""

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = batch.column("terms")
        row = np.repeat(batch.column("place").to_numpy(), pc.list_value_length(words).to_numpy(zero_copy_only=False))
        coded = words.flatten().dictionary_encode()
        pairs, counts = np.unique(coded.indices.to_numpy().astype(np.int64) << 32 | row, return_counts=True)
        return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(pairs >> 32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), pa.array(counts)], ["term", "place", "count"])

    for segment, rows in _segments(batches, counted):
        coded = rows.column("term").combine_chunks().dictionary_encode()
        code = coded.indices.to_numpy()
        order = np.argsort(code, kind="stable")  # places come in order
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))]), pa.int32())
        places, counts = (pa.ListArray.from_arrays(ends, rows.column(c).combine_chunks().take(pa.array(order))) for c in ("place", "count"))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), segment)), coded.dictionary, places, counts], ["segment", "term", "places", "counts"])


def _weigh_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a segment's terms as weights, of which each entry's have length 1."""
    for _, rows in _segments(batches):
        place, lens = _flat(rows, "places")
        weight = _flat(rows, "counts")[0] * np.repeat(rows.column("idf").to_numpy(), lens)
        weight /= np.sqrt(np.bincount(place, weight * weight))[place]
        ends = pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32())
        yield pa.RecordBatch.from_arrays([rows.column(c).combine_chunks() for c in ("segment", "term", "places")] + [pa.ListArray.from_arrays(ends, pa.array(weight))], ["segment", "term", "places", "weights"])


class _Asked:
    """Up to ``TABLE_QUERIES`` queries, by term: their numbers (from ``first`` on) and weights; and the best ``k`` entries of each so far."""

    def __init__(self, first: int, size: int, term: np.ndarray, query: np.ndarray, weight: np.ndarray, k: int):
        self.first, self.size, self.k, self.query, self.weight = first, size, k, query, weight
        self.terms, self.starts, self.lens = np.unique(term, return_index=True, return_counts=True)
        self.best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)  # query, entry, score
        self.least = np.full(size, -1.0)  # score of the k-th, -1 without one

    def score(self, segment: int, term: np.ndarray, starts: np.ndarray, lens: np.ndarray, place: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Scores of a segment's entries by query: lists of terms lie in ``place`` and ``weight``."""
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        lists = np.flatnonzero(self.terms[at] == term)
        at = at[lists]
        pairs = lens[lists] * self.lens[at]
        scores = np.zeros((self.size, segment))
        dense = np.flatnonzero(pairs >= DENSE_PAIRS)
        for k in range(0, len(dense), DENSE_TERMS):
            some = dense[k : k + DENSE_TERMS]
            asked, entries = np.zeros((self.size, len(some))), np.zeros((len(some), segment))
            number = np.arange(len(some))
            q, e = _slices(self.starts[at[some]], self.lens[at[some]]), _slices(starts[lists[some]], lens[lists[some]])
            asked[self.query[q], np.repeat(number, self.lens[at[some]])] = self.weight[q]
            entries[np.repeat(number, lens[lists[some]]), place[e]] = weight[e]
            scores += asked @ entries
        rest = np.flatnonzero(pairs < DENSE_PAIRS)
        group = np.cumsum(pairs[rest]) // ADDED_PAIRS
        for some in np.split(rest, np.flatnonzero(np.diff(group)) + 1):
            n, m = lens[lists[some]], self.lens[at[some]]
            e = _slices(starts[lists[some]], n)  # each entry meets all queries of its term
            each = np.repeat(m, n)
            q = _slices(np.repeat(self.starts[at[some]], n), each)
            scores += np.bincount(self.query[q] * segment + np.repeat(place[e], each), self.weight[q] * np.repeat(weight[e], each), self.size * segment).reshape(scores.shape)
        return scores

    def keep(self, scores: np.ndarray, first: int) -> None:
        """Take a segment's scores (of entries from ``first`` on) among the best; equal ones (nine digits) in order of entry."""
        floor = self.least - 1e-9
        open_ = np.flatnonzero(self.least < 0)
        if len(open_) and scores.shape[1] > self.k:
            floor[open_] = np.partition(scores[open_], -self.k, axis=1)[:, -self.k] - 1e-9
        query, entry = np.nonzero((scores >= floor[:, None]) & (scores > 0))
        if not len(query):
            return
        query, entry, score = map(np.concatenate, zip(self.best, (query, entry + first, np.round(scores[query, entry], 9))))
        order = np.lexsort((entry, -score, query))
        begin = np.flatnonzero(np.diff(query[order], prepend=-1))
        rank = np.arange(len(order)) - np.repeat(begin, np.diff(begin, append=len(order)))
        order = order[rank < self.k]
        self.best = query[order], entry[order], score[order]
        last = order[rank[rank < self.k] == self.k - 1]
        self.least[query[last]] = score[last]


def build_text_index(counts: DataFrame, path: str | None = None, segment: int = SEGMENT) -> TextIndex:
    """The index of template counts (``file``, ``template``, ``count``) below ``path``, or a new folder.

    A term weighs its number in the template times ``ln((1 + n) / (1 + df)) + 1`` over the
    ``n`` distinct templates, ``df`` of which hold it; an entry's weights have length 1. Entries
    are numbered by file and template and cut into segments, each with its own lists of
    places by term, so that the list of a term that stands in every template is bounded and
    spread like the entries. Entries without a term are in no list; null templates are left out.
    """
    spark = counts.sparkSession
    path = path or new_table_path(spark, "text-index")
    entries = counts.where("template is not null").select("file", "template", F.col("count").alias("frequency"))
    number_rows(entries, ["file", "template"], name="entry").write.parquet(f"{path}/entries")
    index = TextIndex(spark, path, segment)
    distinct = index.table("entries").select("template").distinct()
    n = distinct.count()
    df = distinct.select(F.explode(F.array_distinct(terms(F.col("template")))).alias("term")).groupBy("term").count()
    df.select("term", (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("count"))) + 1).alias("idf")).write.parquet(f"{path}/weights")
    rows = index.table("entries").select(F.floor((F.col("entry") - 1) / segment).alias("segment"), ((F.col("entry") - 1) % segment).cast("int").alias("place"), "template")
    rows = rows.repartition("segment").sortWithinPartitions("segment", "place").select("segment", "place", terms(F.col("template")).alias("terms"))
    lists = rows.mapInArrow(_count_terms, "segment bigint, term string, places array<int>, counts array<bigint>").join(index.table("weights"), "term")
    lists = lists.repartition("segment").sortWithinPartitions("segment", "term").select("segment", "term", "idf", "places", "counts")
    lists.mapInArrow(_weigh_terms, "segment bigint, term string, places array<int>, weights array<double>").write.parquet(f"{path}/postings")
    return index


def _weighed(queries: DataFrame, index: TextIndex) -> DataFrame:
    """``query_id``, ``term``, ``w`` of queries (``query_id``, ``text``), at length 1; terms that no template holds do not count."""
    each = queries.select("query_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("query_id", "term").count()
    rows = each.join(index.table("weights"), "term").select("query_id", "term", (F.col("count") * F.col("idf")).alias("w"))
    sizes = rows.groupBy("query_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    return rows.join(sizes, "query_id").select("query_id", "term", (F.col("w") / F.col("size")).alias("w"))


def search_text(index: TextIndex, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` entries nearest to each query (``query_id``, ``text``) by cosine of tf-idf weights.

    Only lists of the queries' terms are read. They are dealt out by segment; a task adds up
    the scores of one segment in a table of its entries by ``TABLE_QUERIES`` queries after
    another, and sends on the best ``k`` of each query over all its segments: no pair of
    query and entry becomes a row, and its memory does not follow the number of queries of a
    block. All queries meet all entries that share a term with them, so the time of this part
    grows as their product. Entries that
    share no term with a query are no hits of it. Equal similarities (nine digits) are ordered
    by file and template. ``query_id`` must be its query's own; a null text has no hits.

    Returns ``query_id``, ``file``, ``template``, ``frequency``, ``similarity`` (four digits), ``rank``.
    """
    ship(index.spark)
    kind, segment = queries.schema["query_id"].dataType.simpleString(), index.segment

    def search(block: DataFrame) -> DataFrame:
        held = _weighed(block, index).toArrow().sort_by([("query_id", "ascending"), ("term", "ascending")])  # a block of queries
        names, coded = held.column("query_id").combine_chunks().unique(), held.column("term").combine_chunks().dictionary_encode()
        at, term, weight = pc.index_in(held.column("query_id"), value_set=names).to_numpy(), coded.indices.to_numpy(), held.column("w").to_numpy()
        order = np.lexsort((at, term, at // TABLE_QUERIES))
        known = index.spark.sparkContext.broadcast((names, at[order], term[order], weight[order]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, at, term, weight = known.value
            tables = []
            for first in range(0, len(names), TABLE_QUERIES):
                mine = slice(*np.searchsorted(at // TABLE_QUERIES, [first // TABLE_QUERIES, first // TABLE_QUERIES + 1]))
                tables.append(_Asked(first, min(TABLE_QUERIES, len(names) - first), term[mine], at[mine] - first, weight[mine], k))
            for number, rows in _segments(batches):
                place, lens = _flat(rows, "places")
                lists = rows.column("code").to_numpy(), np.cumsum(lens) - lens, lens, place, _flat(rows, "weights")[0]
                for table in tables:
                    table.keep(table.score(segment, *lists), number * segment + 1)
            for table in tables:
                query, entry, score = table.best
                if len(query):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(query + table.first)), pa.array(entry), pa.array(score)], ["query_id", "entry", "score"])

        lists = index.table("postings")
        if len(coded.dictionary) <= FILTER_TERMS:  # few enough for Parquet to skip by
            lists = lists.where(F.col("term").isin(coded.dictionary.to_pylist()))
        codes = index.spark.createDataFrame(pa.table({"term": coded.dictionary.cast(pa.string()), "code": pa.array(np.arange(len(coded.dictionary)))}))
        lists = lists.join(F.broadcast(codes), "term").repartition("segment").sortWithinPartitions("segment", "code").select("segment", "code", "places", "weights")
        found = lists.mapInArrow(run, f"query_id {kind}, entry bigint, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "entry")  # entries are numbered by file and template
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(index.table("entries"), "entry")
        return ranked.select("query_id", "file", "template", "frequency", F.round("score", 4).alias("similarity"), "rank")

    return by_blocks(queries.select("query_id", "text"), search, QUERY_BLOCK)


def search_text_lines(hits: DataFrame, parsed: DataFrame) -> DataFrame:
    """The parsed lines behind hits of ``search_text``, each once."""
    return drilldown_hits(hits, parsed)
