"""Searching and viewing lines: patterns, pages, context windows, entities."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.entities import ANY_LEVEL, ENTITIES, LEVELS, REQUIRED, may_hold
from ..functions.literals import required_texts
from ..functions.text import line_page
from ..session import new_table_path, ship
from ..sources.rules import pattern_problem

#: Quick searches by name. Fixed values.
QUICK = {
    "error": r"\b(ERROR|FATAL|CRITICAL|FAIL)\b",
    "warn": r"\b(WARNING|WARN|ALERT)\b",
    "ip": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "time": r"\b\d{2}:\d{2}:\d{2}\b",
}


def search_lines(lines: DataFrame, pattern: str, size: int = 1000) -> DataFrame:
    """Lines that a pattern matches in any case, with their page; none if the pattern does not compile."""
    if pattern_problem(lines.sparkSession, f"(?iu){pattern}"):
        matches = lines.where(F.lit(False))
    else:
        matches = lines.where(F.col("line").rlike(f"(?iu){pattern}"))
    return matches.select("file", "line_no", line_page(F.col("line_no"), size).alias("page"), "line")


#: Words of 64 bits of a page's signature.
SIGNATURE_WORDS = 128
#: Letters that match an ASCII letter when case is ignored, besides the two cases of that letter.
_FOLDED = ("ſıİK", "siik")


def _bits(text: np.ndarray) -> np.ndarray:
    """The bit of each three bytes that follow each other."""
    b = text.astype(np.uint32)
    return ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - (SIGNATURE_WORDS * 64 - 1).bit_length())


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``file``, ``page`` and ``signature`` of runs of lines of a page (``file``, ``page``, ``text``); runs go on from batch to batch."""
    at, held = None, np.zeros(0, np.uint32)  # the run at hand and its bits

    def rows(files: list, pages: list, words: list[np.ndarray], bits: list[np.ndarray]) -> pa.RecordBatch:
        ends = pa.array(np.cumsum([0, *map(len, words)]), pa.int32())
        maps = pa.MapArray.from_arrays(ends, pa.array(np.concatenate(words), pa.int32()), pa.array(np.concatenate(bits), pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(pages, pa.int64()), maps], ["file", "page", "signature"])

    def signature(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        word = found >> 6
        first = np.flatnonzero(np.diff(word, prepend=-1))
        bits = np.left_shift(np.uint64(1), (found & 63).astype(np.uint64))
        return word[first], (np.bitwise_or.reduceat(bits, first) if len(found) else bits).view(np.int64)

    for batch in batches:
        text = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"")
        size = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(size):
            continue
        flat = np.frombuffer(b"".join(text.to_pylist()), np.uint8)
        coded, page = batch.column("file").dictionary_encode(), batch.column("page").to_numpy()
        begin = np.flatnonzero((np.diff(coded.indices.fill_null(-1).to_numpy(), prepend=-2) != 0) | (np.diff(page, prepend=page[0] - 1) != 0))
        stop = np.cumsum(size)
        line = np.repeat(np.arange(len(size), dtype=np.int32), size)
        bits, whole = (_bits(flat), line[:-2] == line[2:]) if len(flat) > 2 else (held[:0], np.zeros(0, bool))
        files, out = batch.column("file").take(pa.array(begin)).to_pylist(), []
        for file, number, a, z in zip(files, page[begin].tolist(), (stop - size)[begin].tolist(), [*(stop - size)[begin[1:]].tolist(), len(flat)]):
            found = np.unique(bits[a:z][whole[a:z]])
            if at == (file, number):
                held = np.union1d(held, found)
                continue
            if at is not None and len(held):
                out.append((*at, *signature(held)))
            at, held = (file, number), found
        if out:
            yield rows(*map(list, zip(*out)))
    if at is not None and len(held):
        yield rows([at[0]], [at[1]], *([x] for x in signature(held)))


def build_search_pages(lines: DataFrame, path: str | None = None, size: int = 1000) -> str:
    """Lines (``file``, ``line_no``, ``line``) stored by page below ``path`` (or a new folder), with a signature of each page beside them.

    A signature has a bit for each three bytes that follow each other in a line of the page,
    case ignored. It is made where the page's lines lie stored; a page that two tasks read has
    one of each task's lines, which does for a match, as that lies in one line.
    """
    ship(lines.sparkSession)
    path = path or new_table_path(lines.sparkSession, "search-pages")
    rows = lines.select("file", "line_no", line_page(F.col("line_no"), size).alias("page"), "line")
    rows.repartitionByRange("file", "page").sortWithinPartitions("file", "line_no").write.parquet(f"{path}/lines")
    text = F.lower(F.translate("line", *_FOLDED))
    stored = lines.sparkSession.read.schema(rows.schema).parquet(f"{path}/lines").select("file", "page", text.alias("text"))
    signature = stored.mapInArrow(_signatures, "file string, page bigint, signature map<int, bigint>")
    signature.write.parquet(f"{path}/signatures")
    return path


def pages_for(spark: SparkSession, path: str, pattern: str) -> DataFrame | None:
    """``file`` and ``page`` of the stored pages on which a line may match; None if the pattern requires no text of three characters."""
    found = required_texts(f"(?i){pattern}")
    if found is None or min(map(len, found[0])) < 3:
        return None
    signatures = spark.read.parquet(f"{path}/signatures")

    def holds(text: str) -> Column:
        masks: dict[int, int] = {}
        for b in _bits(np.frombuffer(text.encode(), np.uint8)).tolist():
            masks[b >> 6] = masks.get(b >> 6, 0) | 1 << (b & 63)
        signed = {w: m - (1 << 64) if m >> 63 else m for w, m in masks.items()}
        each = [F.coalesce(F.try_element_at("signature", F.lit(w)), F.lit(0)).bitwiseAND(F.lit(m)) == F.lit(m) for w, m in signed.items()]
        return reduce(lambda a, b: a & b, each)

    return signatures.where(reduce(lambda a, b: a | b, map(holds, sorted(found[0])))).select("file", "page")


def search_pages(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``search_lines`` over lines stored by ``build_search_pages``: the same rows, but only of pages whose signature allows a match.

    Texts that every match holds are read from the pattern (``required_texts``); a pattern
    without any takes all pages.
    """
    lines = spark.read.parquet(f"{path}/lines")
    if pattern_problem(spark, f"(?iu){pattern}"):
        return lines.where(F.lit(False)).select("file", "line_no", "page", "line")
    pages = pages_for(spark, path, pattern)
    if pages is not None:
        lines = lines.join(pages, ["file", "page"], "left_semi")
    return lines.where(F.col("line").rlike(f"(?iu){pattern}")).select("file", "line_no", "page", "line")


def quick_search(lines: DataFrame, name: str) -> DataFrame:
    """``search_lines`` with the pattern of that name in ``QUICK``."""
    return search_lines(lines, QUICK[name])


def page(lines: DataFrame, file: str, number: int, size: int = 1000) -> DataFrame:
    """The lines of a file's page, by the stored line number."""
    return lines.where((F.col("file") == file) & F.col("line_no").between((number - 1) * size + 1, number * size))


def page_stats(lines: DataFrame, size: int = 1000) -> DataFrame:
    """Lines and pages of each file."""
    return lines.groupBy("file").agg(F.count("*").alias("total")).withColumn("total_pages", F.ceil(F.col("total") / size))


def context_window(parsed: DataFrame, anchors: DataFrame, seconds: int) -> DataFrame:
    """Lines of a file within ``seconds`` of an anchor, both ends included.

    anchors: ``anchor_id``, ``file``, ``anchor_ts``, ``template``. Lines and anchors meet by
    file and time bucket of the window's length (each anchor looks into three buckets), so
    the join is an equi-join of limited fan-out. ``is_selected`` marks the anchor's template.
    """
    width = max(2 * seconds, 1)
    bucket = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / width)
    span = F.expr(f"make_dt_interval(0, 0, 0, {seconds})")
    held = anchors.where("anchor_ts is not null").select("anchor_id", "file", "anchor_ts", F.col("template").alias("_selected"), F.explode(F.sequence(bucket(F.col("anchor_ts") - span), bucket(F.col("anchor_ts") + span))).alias("_bucket"))
    rows = parsed.where("timestamp is not null").withColumn("_bucket", bucket(F.col("timestamp")))
    joined = rows.join(held, ["file", "_bucket"]).where((F.col("timestamp") >= F.col("anchor_ts") - span) & (F.col("timestamp") <= F.col("anchor_ts") + span))
    return joined.withColumn("is_selected", F.coalesce(F.col("template") == F.col("_selected"), F.lit(False))).drop("_bucket", "_selected", "anchor_ts")


def entity_counts(lines: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Occurrences of entities by file, kind and text, with Spark's own functions.

    A pattern meets only lines with the texts that it requires, those of the log levels only
    lines that one pattern of all their words matches.
    """
    wanted = [(kind, pattern) for kind, pattern in ENTITIES if kinds is None or kind in kinds]
    rows = lines.select("file", "line", F.col("line").rlike(ANY_LEVEL).alias("_level")) if any(kind in LEVELS for kind, _ in wanted) else lines.select("file", "line")
    held = [may_hold(F.col("line"), pattern) if pattern in REQUIRED else F.col("_level") for _, pattern in wanted]

    def named(kind: str, pattern: str, may: Column) -> Column:
        texts = F.regexp_extract_all("line", F.lit(f"(?i)({pattern})"), 1)
        return F.when(may, F.transform(texts, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("text"))))

    parts = F.filter(F.array(*[named(*w, may) for w, may in zip(wanted, held)]), lambda x: x.isNotNull())
    found = rows.where(reduce(lambda a, b: a | b, held)).select("file", F.explode(F.flatten(parts)).alias("e"))
    return found.groupBy("file", F.col("e.kind").alias("kind"), F.col("e.text").alias("text")).agg(F.count("*").alias("count"))
