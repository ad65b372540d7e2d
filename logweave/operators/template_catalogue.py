"""Template mining from run to run: a stored catalogue of clusters whose ids stay."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import MASKS
from ..session import discard, exists, materialise, ship
from .numbering import number_rows
from .templates import WILDCARD, cluster_into, cluster_lists, extract_parameters, word_lists

CLUSTERS = "cluster_id bigint, key string, words array<string>"
MEMBERS = "tokens array<string>, cluster_id bigint"
_FOUND = "key string, tokens array<string>, first string, cluster_id bigint, place int, words array<string>"


@dataclass
class TemplateCatalogue:
    """Clusters and the word lists that belong to them, a pair of tables a run below ``path``."""

    spark: SparkSession
    path: str

    def last_run(self) -> int:
        """The number of the last whole run; 0 before the first. A run counts once its clusters are written."""
        n = 0
        while exists(self.spark, f"{self.path}/clusters-{n + 1}/_SUCCESS"):
            n += 1
        return n

    def clusters(self) -> DataFrame:
        """``cluster_id``, ``key`` (of the bucket) and ``words`` by now."""
        n = self.last_run()
        return self.spark.read.schema(CLUSTERS).parquet(f"{self.path}/clusters-{n}") if n else self.spark.createDataFrame([], CLUSTERS)

    def members(self) -> DataFrame:
        """The cluster of each word list met so far."""
        paths = [f"{self.path}/members-{k}" for k in range(1, self.last_run() + 1)]
        return self.spark.read.schema(MEMBERS).parquet(*paths) if paths else self.spark.createDataFrame([], MEMBERS)


def _grow(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Each part of a bucket: its clusters, then its new lists in order. The part at hand is held in memory.

    Answers the cluster of each list (a known one's id, a new one's place in the bucket), and
    each cluster that has new members or is new. In a large bucket lists only join known clusters.
    """
    at, ids, state, lists, large = None, [], [], [], False

    def flush() -> pa.RecordBatch:
        member, clusters = cluster_into([w for w, _ in lists], state, similarity, grow=not large)
        founder: dict[int, str] = {}
        out = []
        for (words, first), k in zip(lists, member):
            founder.setdefault(k, first)
            out.append((at[0], words, first, ids[k] if 0 <= k < len(ids) else None, k if k >= len(ids) else None, None))
        for k, first in founder.items():
            if k >= 0:
                out.append((at[0], None, first, ids[k] if k < len(ids) else None, k if k >= len(ids) else None, clusters[k]))
        kinds = (pa.string(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate(kinds)], ["key", "tokens", "first", "cluster_id", "place", "words"])

    for batch in batches:
        for key, part, n, words, first, known in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "size", "words", "first", "cluster_id"))):
            if (key, part) != at:
                if lists:
                    yield flush()
                at, ids, state, lists = (key, part), [], [], []
            large = n is not None
            if known is not None:
                ids.append(known)
                state.append(words)
            else:
                lists.append((words, first))
    if lists:
        yield flush()


def mine_into(catalogue: TemplateCatalogue, lines: DataFrame, similarity: float = 0.5, depth: int = 8, max_clusters: int = 1024, masks: tuple[tuple[str, str], ...] = MASKS) -> DataFrame:
    """Parsed lines with ``cluster_id``, ``template`` and ``parameter_list``, mined on from what a catalogue holds.

    Word lists that the catalogue knows keep their cluster. New ones meet the clusters of
    their bucket (an equi-join on length and first words) and join or found clusters as
    ``cluster_into`` says, in order of file and line. A cluster that gets more general keeps
    its id; new ids follow the largest one in order of the clusters' first lines. So if each
    run's lines stand behind those of the runs before, runs give what one run over all lines
    gives, as long as no bucket gets more than ``max_clusters`` new lists in a run: such a
    bucket is matched with its known clusters in parts, and what is left is clustered by
    ``cluster_lists``. The run is written below the catalogue's path, members first; a run
    that breaks off leaves the catalogue as it was. One run at a time.
    """
    spark = catalogue.spark
    ship(spark)
    run, path = catalogue.last_run() + 1, catalogue.path
    rows, lists = word_lists(lines, depth, masks)
    before, held = catalogue.clusters(), catalogue.members()
    new = materialise(lists.join(held, "tokens", "left_anti"), "new-lists")
    large = materialise(new.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > max_clusters), "large")
    parts = F.coalesce(F.ceil(F.col("size") / max_clusters) * 2, F.lit(1)).cast("int")
    none = F.lit(None).cast("bigint")
    fresh = new.join(large, "key", "left").select("key", F.pmod(F.xxhash64("tokens"), parts).cast("int").alias("part"), "size", F.col("tokens").alias("words"), "first", none.alias("cluster_id"))
    known = before.join(new.select("key").distinct(), "key").join(large, "key", "left")
    known = known.select("key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "size", "words", F.lit("").alias("first"), "cluster_id")
    items = fresh.unionByName(known).repartition("key", "part").sortWithinPartitions("key", "part", F.asc_nulls_last("cluster_id"), "first", "words")
    found = materialise(items.mapInArrow(lambda b: _grow(b, similarity), _FOUND), "grown")
    # Known clusters, as general as all parts have made them.
    merge = F.aggregate("all", F.col("words"), lambda a, w: F.zip_with(a, w, lambda x, y: F.when(x == y, x).otherwise(WILDCARD)))
    wider = found.where("tokens is null and cluster_id is not null").groupBy("cluster_id").agg(F.collect_list("words").alias("all"))
    after = before.join(wider, "cluster_id", "left").select("cluster_id", "key", F.when(F.col("all").isNull(), F.col("words")).otherwise(merge).alias("words"))
    # New ones: founded in a small bucket, or left over in a large one.
    left = found.where("tokens is not null and cluster_id is null and place is null").select("tokens", "first", "key")
    left = materialise(left.join(cluster_lists(left, similarity, max_clusters), "tokens").select("key", "tokens", "first", F.col("template").alias("words")), "left-lists")
    founded = found.where("tokens is null and cluster_id is null").select("key", "place", "words", "first")
    founded = founded.unionByName(left.groupBy("key", "words").agg(F.min("first").alias("first")).withColumn("place", F.lit(-1)))
    last = before.agg(F.coalesce(F.max("cluster_id"), F.lit(0))).first()[0]
    numbered = number_rows(founded, ["first", "key", "place", "words"], name="cluster_id").withColumn("cluster_id", F.col("cluster_id") + last)
    by_place = found.where("tokens is not null and place is not null").join(numbered.where("place >= 0").select("key", "place", F.col("cluster_id").alias("id")), ["key", "place"]).select("tokens", F.col("id").alias("cluster_id"))
    by_words = left.join(numbered.where("place < 0").select("key", "words", "cluster_id"), ["key", "words"]).select("tokens", "cluster_id")
    joined = found.where("tokens is not null and cluster_id is not null").select("tokens", "cluster_id")
    joined.unionByName(by_place).unionByName(by_words).write.mode("overwrite").parquet(f"{path}/members-{run}")
    after.unionByName(numbered.select("cluster_id", "key", "words")).write.mode("overwrite").parquet(f"{path}/clusters-{run}")
    discard(new, large, found, left)
    named = catalogue.members().join(catalogue.clusters(), "cluster_id").select(F.col("tokens").alias("_tokens"), "cluster_id", F.array_join("words", " ").alias("template"))
    return rows.join(named, "_tokens", "left").drop("_tokens").withColumn("parameter_list", extract_parameters("template", "loglines"))
