"""The operators over streams of log lines (``file``, ``line``, ``ts``, ..)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.text import MASKS, file_stem, mask_values, mining_prefix, tokenise
from ..functions.timestamps import message, parse_timestamp, raw_timestamp
from ..operators.rules import rule_matches
from ..operators.templates import cluster_into


def stream_log_lines(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Lines of the text files that appear below ``path``; the checkpoint remembers which were read."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(path)
    line = F.col("value")
    return lines.select(F.col("_metadata.file_name").alias("file"), line.alias("line"), parse_timestamp(raw_timestamp(line)).cast("timestamp").alias("ts"), message(line).alias("loglines"))


def stream_template_counts(lines: DataFrame, late: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """Lines per masked template and time window; a window is final, and sent once, when the watermark has passed it."""
    rows = lines.withColumn("template", mask_values(F.col("loglines"))).withWatermark("ts", late)
    counts = rows.groupBy(F.window("ts", window), "template").count()
    return counts.select(F.col("window.start").alias("start"), "template", "count")


#: The state store that keeps clusters.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Clusters(StatefulProcessor):
    """Clusters of one bucket of word lists; their ids stay, their words get more general."""

    def __init__(self, similarity: float, ttl_ms: int | None):
        self.similarity, self.ttl_ms = similarity, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        key = StructType([StructField("cluster", IntegerType())])
        value = StructType([StructField("words", ArrayType(StringType()))])
        number = StructType([StructField("next", IntegerType())])
        self.clusters = handle.getMapState("clusters", key, value, self.ttl_ms)
        self.next = handle.getValueState("next", number)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = sorted((k[0], list(v[0])) for k, v in self.clusters.iterator())
        names, state = [k for k, _ in held], [w for _, w in held]
        following = self.next.get()[0] if self.next.exists() else 0
        counts: Counter[int] = Counter()
        for pdf in rows:
            member, state = cluster_into([list(t) for t in pdf["tokens"]], state, self.similarity)
            names += range(following, following + len(state) - len(names))
            following = max(following, names[-1] + 1)
            counts.update(member)
        for k in counts:
            self.clusters.updateValue((names[k],), (state[k],))
        self.next.update((following,))
        yield pd.DataFrame({"bucket": [key[0]] * len(counts), "cluster": [names[k] for k in counts], "template": [" ".join(state[k]) for k in counts], "lines": list(counts.values())})

    def close(self) -> None:
        pass


def stream_mine_templates(lines: DataFrame, similarity: float = 0.5, depth: int = 8, ttl: timedelta | None = None) -> DataFrame:
    """Template mining with clusters kept as state: per batch and cluster its id, its template by now, its new lines.

    Cluster ids (with their bucket) never change and are never given twice, so counts are
    summed by id and the text is taken from the latest row. No line is forced into a cluster:
    with a ``ttl`` a cluster that no line has met for so long is forgotten, which bounds the
    state of an endless stream, and lines like its own begin a new one. Needs the RocksDB state store. With a
    ``ttl`` Spark makes batches as long as the query runs, so it does not end by itself
    (``availableNow``).
    """
    tokens = tokenise(mask_values(F.col("loglines"), MASKS))
    rows = lines.select(tokens.alias("tokens")).where("tokens is not null").select("tokens", F.concat_ws(" ", F.size("tokens").cast("string"), mining_prefix(F.col("tokens"), depth)).alias("bucket"))
    return rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_Clusters(similarity, None if ttl is None else int(ttl.total_seconds() * 1000)),
        outputStructType="bucket string, cluster int, template string, lines bigint", outputMode="append", timeMode="None" if ttl is None else "ProcessingTime",
    )


def clusters_so_far(mined: DataFrame) -> DataFrame:
    """Of the rows that ``stream_mine_templates`` has sent: each cluster's latest (most general) template, and all its lines."""
    wildcards = F.regexp_count("template", F.lit(r"(^| )<[*]>($| )"))
    latest = F.max(F.struct(wildcards.alias("n"), "template"))
    return mined.groupBy("bucket", "cluster").agg(latest.alias("t"), F.sum("lines").alias("lines")).select("bucket", "cluster", "t.template", "lines")


def stream_rule_hits(lines: DataFrame, rules: DataFrame, cap: int = 100) -> DataFrame:
    """Matching lines per file and rule so far, counted up to ``cap`` (update or complete mode).

    Patterns are literals of one projection, as in ``apply_rules``, so each compiles once a
    task; more than ``MAX_RULES`` rules are refused.
    """
    held, matched = rule_matches(rules)
    hits = lines.where(file_stem(F.col("file")).isin(sorted({r["file_key"] for r in held}))).select("file", F.explode(matched).alias("rule"))
    counts = hits.groupBy("file", "rule").agg(F.count("*").alias("n"))
    names = lines.sparkSession.createDataFrame([(k, r["title"], r["pattern"]) for k, r in enumerate(held)], "rule int, title string, pattern string")
    return counts.join(F.broadcast(names), "rule").select("file", "title", "pattern", F.least("n", F.lit(cap)).alias("Frequency"))


def stream_latest_status(telemetry: DataFrame) -> DataFrame:
    """Latest value per device and key so far (update mode)."""
    return telemetry.where("time is not null").groupBy("device", "key").agg(F.max("time").alias("time"), F.max_by("value", "time").alias("value"))


def stream_dedupe(lines: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Lines without repetitions inside the watermark's span."""
    return lines.withWatermark("ts", late).dropDuplicatesWithinWatermark(["file", "line"])
