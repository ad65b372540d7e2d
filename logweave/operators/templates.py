"""Templates of log lines: masking, mining, counts, profiles and histograms."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import DELIMITERS, MASKS, clean_template, mask_values, mining_prefix, tokenise
from ..session import discard, materialise
from .numbering import number_rows, with_next

#: Bins of a histogram by name. Fixed values.
BINS = {"1s": ("second", "1 second"), "1min": ("minute", "1 minute"), "1h": ("hour", "1 hour"), "1d": ("day", "1 day")}
#: Empty bins of a histogram that one row makes.
GAP_ROWS = 65_536
WILDCARD = "<*>"
_ID = {"bigint": pa.int64(), "binary": pa.binary()}
#: Masks whose values may hold blanks or delimiters.
_LOOSE = frozenset("DATETIME MAC MAC_CIDR IPv6 IPv6_PORT IP_PORT VERSION THREADID".split())


def mask_templates(lines: DataFrame, masks: tuple[tuple[str, str], ...] = MASKS) -> DataFrame:
    """Parsed lines with their masked text as ``template``."""
    return lines.withColumn("template", mask_values(F.col("loglines"), masks))


def cluster_into(lists: list[list[str]], state: list[list[str]], similarity: float, grow: bool = True) -> tuple[list[int], list[list[str]]]:
    """The cluster of each of some word lists of equal length, in the order given, and all clusters.

    Clusters begin as ``state``. Each list joins the one with the largest share of equal words
    (of several, the first), if that reaches ``similarity``; else it begins a new one, or with
    ``grow`` off belongs to none (-1). Words in which members differ are wildcards.
    """
    codes = {WILDCARD: 0}
    coded = [[codes.setdefault(w, len(codes)) for w in words] for words in (*state, *lists)]
    width = len(coded[0]) if coded else 0
    clusters, used, member = np.zeros((len(coded), width), np.int32), len(state), []
    for k, words in enumerate(np.array(coded, np.int32).reshape(len(coded), width)):
        if k < len(state):
            clusters[k] = words
            continue
        if used:
            equal = (clusters[:used] == words).sum(1)
            best = int(equal.argmax())
            if equal[best] / max(width, 1) >= similarity:
                member.append(best)
                clusters[best][clusters[best] != words] = 0
                continue
        if not grow:
            member.append(-1)
            continue
        member.append(used)
        clusters[used] = words
        used += 1
    names = list(codes)
    return member, [[names[c] for c in cluster] for cluster in clusters[:used].tolist()]


def cluster_words(lists: list[list[str]], similarity: float) -> list[list[str]]:
    """Templates of word lists of equal length, one a list, by ``cluster_into`` from nothing."""
    if len(lists) == 1:
        return [list(lists[0])]
    member, found = cluster_into(lists, [], similarity)
    return [found[k] for k in member]


def cluster_shapes(shapes: pd.DataFrame, similarity: float, max_clusters: int) -> pd.DataFrame:  # noqa: ARG001
    """``cluster_words`` of the lists in column ``tokens``, in order of ``first`` (then of the words).

    ``max_clusters`` forces no list into a cluster; ``mine_templates`` bounds its buckets by it.
    """
    shapes = shapes.assign(_words=shapes["tokens"].map(tuple)).sort_values(["first", "_words"])
    found = cluster_words([list(w) for w in shapes["_words"]], similarity) if len(shapes) else []
    return pd.DataFrame({"tokens": list(shapes["tokens"]), "template": [" ".join(t) for t in found]})


def _cluster_parts(items: DataFrame, similarity: float) -> DataFrame:
    """``template`` (as words) of the word lists of each part of a bucket (``id``, ``key``, ``part``, ``size``, ``words``, ``first``); only the part at hand is held in memory.

    ``first`` and ``key`` are passed on for lists of split buckets (those with a ``size``) alone. Words are not sent back.
    """
    schema = pa.schema([("id", _ID[items.schema["id"].dataType.simpleString()]), ("size", pa.int64()), ("first", pa.string()), ("key", pa.string()), ("template", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, held, firsts, size = None, [], [], [], None

        def flush() -> pa.RecordBatch:
            split = size is not None
            columns = [ids, [size] * len(held), firsts if split else [None] * len(held), [at[0] if split else None] * len(held), cluster_words(held, similarity)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            out = []
            for n, key, part, s, words, first in zip(*(batch.column(c).to_pylist() for c in ("id", "key", "part", "size", "words", "first"))):
                if (key, part) != at:
                    if held:
                        out.append(flush())
                    at, ids, held, firsts, size = (key, part), [], [], [], s
                ids.append(n)
                held.append(words)
                firsts.append(first)
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
        if held:
            yield flush()

    spread = items.repartition("key", "part").sortWithinPartitions("key", "part", "first", "words")
    kind = items.schema["id"].dataType.simpleString()
    return spread.select("id", "key", "part", "size", "words", "first").mapInArrow(run, f"id {kind}, size bigint, first string, key string, template array<string>")


def _split_key(rest: DataFrame) -> DataFrame:
    """``rest`` with longer keys for buckets of which clustering has left more than half: by the words at the position with the fewest different ones.

    Words with digits count alike, as in ``mining_prefix``, unless all lists are alike then.
    """
    lists = rest.select("key", "size", "words").distinct()
    full = lists.groupBy("key", "size").count().where(F.col("count") > F.col("size") / 2).select("key")
    plain = F.when(F.col("word").rlike(r"\d"), WILDCARD).otherwise(F.col("word"))
    at = lists.join(full, "key").select("key", F.posexplode("words").alias("pos", "word"))
    counts = at.groupBy("key", "pos").agg(F.count_distinct(plain).alias("plain"), F.count_distinct("word").alias("exact")).where("exact > 1")
    best = F.min(F.struct((F.col("plain") <= 1).alias("exact"), F.when(F.col("plain") > 1, F.col("plain")).otherwise(F.col("exact")).alias("n"), "pos"))
    chosen = counts.groupBy("key").agg(best.alias("_at"))
    rest = rest.join(chosen, "key", "left").withColumn("word", F.get("words", F.col("_at.pos")))
    longer = F.concat_ws("\x01", "key", F.col("_at.pos").cast("string"), F.when(F.col("_at.exact"), F.col("word")).otherwise(plain))
    return rest.withColumn("key", F.when(F.col("_at").isNull(), F.col("key")).otherwise(longer)).drop("_at", "word")


def word_lists(lines: DataFrame, depth: int, masks: tuple[tuple[str, str], ...]) -> tuple[DataFrame, DataFrame]:
    """The lines with their words (``_tokens``), and the distinct word lists: ``tokens``, ``first`` (where they stand first), ``key`` (of their bucket)."""
    rows = lines.withColumn("_tokens", tokenise(mask_values(F.col("loglines"), masks)))
    order = F.struct(F.col("file"), F.col("line_no"))
    shapes = rows.where("_tokens is not null").groupBy("_tokens").agg(F.min(order).alias("at"))
    first = F.concat_ws(" ", "at.file", F.lpad(F.col("at.line_no").cast("string"), 20, "0"))
    key = F.concat_ws(" ", F.size("_tokens").cast("string"), mining_prefix(F.col("_tokens"), depth))
    return rows, shapes.select(F.col("_tokens").alias("tokens"), first.alias("first"), key.alias("key"))


def _digest(words: Column, bucket: Column | None = None) -> Column:
    """128 bits that stand for a word list, or for a list of a bucket: of its text and of where that is cut. Null for null."""
    cuts = F.array_join(F.transform(words, lambda w: F.length(w).cast("string")), ",")
    parts = [F.length(bucket).cast("string"), bucket] if bucket is not None else []
    return F.when(words.isNotNull(), F.unhex(F.md5(F.concat_ws(" ", *parts, cuts, F.array_join(words, "")))))


def _cluster_known(known: DataFrame, similarity: float, max_clusters: int) -> DataFrame:
    """``id`` and ``template`` (as words) of distinct word lists (``id``, ``tokens``, ``first``, ``key``); see ``cluster_lists``.

    Lists are named by ``id``, so that a round sends words to their part alone. Lists of split
    buckets that have come to one template are one list of the next round; its number there
    (``item``) leads back to them.
    """
    open_, done = known.select("id", F.col("tokens").alias("words"), "first", "key"), []
    items, members = open_, None
    while True:
        large = materialise(items.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > max_clusters), "large")
        part = F.coalesce(F.pmod(F.xxhash64("words"), F.ceil(F.col("size") / max_clusters) * 2), F.lit(0))
        found = _cluster_parts(items.join(large, "key", "left").withColumn("part", part), similarity)
        last = large.isEmpty()
        if members is None and last:
            return found.select("id", "template")
        found = materialise(found, "clustered")
        settled, rest = found.where("size is null").select("id", "template"), found.where("size is not null")
        if members is None:
            done.append(settled)
        else:
            done.append(members.join(settled.withColumnRenamed("id", "item"), "item").select("id", "template"))
            if last:
                break
            rest = rest.withColumnRenamed("id", "item")
        discard(large)
        keyed = _split_key(rest.withColumnRenamed("template", "words")).drop("size")
        name = "id" if members is None else "item"
        keyed = materialise(keyed.select(name, "words", "first", "key"), "open")
        named = keyed.withColumn("_item", _digest(F.col("words"), F.col("key")))
        if members is None:
            members = named.select("id", F.col("_item").alias("item"))
        else:
            members = members.join(named.select("item", "_item"), "item").select("id", F.col("_item").alias("item"))
        members = materialise(members, "members")
        items = materialise(named.groupBy(F.col("_item").alias("id")).agg(F.min("first").alias("first"), F.first("words").alias("words"), F.first("key").alias("key")), "items")
        discard(keyed)
    return reduce(DataFrame.unionByName, done)


def cluster_lists(lists: DataFrame, similarity: float, max_clusters: int) -> DataFrame:
    """``tokens`` and ``template`` (as words) of distinct word lists (``tokens``, ``first``, ``key``), clustered in their buckets.

    A bucket of more than ``max_clusters`` lists is dealt by hash into parts, which are
    clustered apart; their templates are clustered again, until so few are left. Where that
    leaves more than half, the bucket is split by one more word. No list is forced into a cluster.
    """
    known = materialise(lists.select(F.monotonically_increasing_id().alias("id"), "tokens", "first", "key"), "shapes")
    return _cluster_known(known, similarity, max_clusters).join(known.select("id", "tokens"), "id").select("tokens", "template")


def mine_templates(lines: DataFrame, similarity: float = 0.5, depth: int = 8, max_clusters: int = 1024, masks: tuple[tuple[str, str], ...] = MASKS) -> DataFrame:
    """Parsed lines (``file``, ``line_no``, ``loglines``, ..) with ``template`` and ``parameter_list``.

    Lines are masked and split into words; only distinct word lists go on. They are put into
    buckets by length and first words (``mining_prefix``), clustered inside each bucket
    (``cluster_lists``), and joined back by a digest of 128 bits, so that no text is shuffled for that. All lines of a cluster get its final template,
    whatever the partitioning. ``template_catalogue`` keeps clusters from run to run.
    """
    rows, lists = word_lists(lines, depth, masks)
    known = materialise(lists.select(_digest(F.col("tokens")).alias("id"), "tokens", "first", "key"), "shapes")
    templates = _cluster_known(known, similarity, max_clusters).select(F.col("id").alias("_list"), F.array_join("template", " ").alias("template"))
    found = rows.withColumn("_list", _digest(F.col("_tokens"))).drop("_tokens").join(templates, "_list", "left").drop("_list")
    return found.withColumn("parameter_list", extract_parameters("template", "loglines"))


@F.pandas_udf(ArrayType(StringType()))
def extract_parameters(templates: pd.Series, lines: pd.Series) -> pd.Series:
    """Values in a line at its template's wildcards and masks, from left to right; none if it does not fit."""
    compiled: dict[str, re.Pattern] = {}
    gap = f"[\\s{re.escape(DELIMITERS)}]+"
    # A wildcard stands for one word, so that a line that does not fit fails fast.
    value = lambda m: "(.+?)" if m[1] in _LOOSE else f"([^\\s{re.escape(DELIMITERS)}]+?)"

    def one(template: str | None, line: str | None) -> list[str]:
        if template is None or line is None:
            return []
        if template not in compiled:
            words = [re.sub(r"<(\\\*|[A-Za-z0-9_]+)>", value, re.escape(w)) for w in template.split(" ")]
            edge = f"[\\s{re.escape(DELIMITERS)}]*"
            compiled[template] = re.compile(f"^{edge}{gap.join(words)}{edge}$", re.S)
        m = compiled[template].match(line)
        return list(m.groups()) if m else []

    return pd.Series([one(t, x) for t, x in zip(templates, lines)])


def template_counts(parsed: DataFrame) -> DataFrame:
    """Lines per file and template; lines without template are left out."""
    return parsed.where("template is not null").groupBy("file", "template").agg(F.count("*").alias("count"))


def template_summary(parsed: DataFrame) -> DataFrame:
    """Lines and distinct templates of all rows."""
    return parsed.agg(F.count("*").alias("total_lines"), F.count_distinct("template").alias("templates"))


def template_sketches(parsed: DataFrame, log2_size: int = 12) -> DataFrame:
    """Per file and day, lines and a mergeable sketch of the distinct templates (2**``log2_size`` registers at most).

    Stored once, sketches answer any range of files and days by ``roll_up_sketches`` without the lines.
    """
    rows = parsed.where("template is not null").groupBy("file", F.to_date("timestamp").alias("day"))
    return rows.agg(F.count("*").alias("lines"), F.hll_sketch_agg("template", log2_size).alias("sketch"))


def roll_up_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Lines and about how many distinct templates of each group of ``by`` (none: of all)."""
    return sketches.groupBy(*by).agg(F.sum("lines").alias("lines"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("templates"))


def template_rank(counts: DataFrame) -> DataFrame:
    """Templates by falling count (then by text): ``count``, ``ratio`` of the sum, ``order`` from 0."""
    totals = counts.groupBy("template").agg(F.sum("count").alias("count"))
    ranked = number_rows(totals, [F.desc("count"), "template"])
    whole = ranked.agg(F.sum("count").alias("_sum"))
    ratio = F.col("count") / F.col("_sum")
    return ranked.crossJoin(F.broadcast(whole)).select("template", "count", ratio.alias("ratio"), (F.col("seq") - 1).alias("order"))


def parameter_profile(parsed: DataFrame, template: str | None = None, distinct_values: int | None = None) -> DataFrame:
    """Per template and parameter position: non-empty values, and the distinct ones joined by ``, ``.

    ``distinct_values`` keeps that many of the smallest distinct values of a position.
    """
    rows = parsed if template is None else parsed.where(F.col("template") == template)
    values = rows.select("template", F.posexplode("parameter_list").alias("pos", "value")).where("value <> ''")
    values = values.groupBy("template", "pos", "value").agg(F.count("*").alias("n"))
    joined = F.array_sort(F.collect_list("value"))
    if distinct_values is not None:
        joined = F.slice(joined, 1, distinct_values)
    found = values.groupBy("template", "pos").agg(F.sum("n").alias("count"), F.array_join(joined, ", ").alias("values"))
    return found.select("template", F.concat(F.lit("POSITION_"), F.col("pos") + 1).alias("position"), "count", "values")


def template_histogram(parsed: DataFrame, freq: str = "1min", template: str | None = None, gap_rows: int = GAP_ROWS) -> DataFrame:
    """Lines per time bin (``1s``, ``1min``, ``1h``, ``1d``; else ``1min``), empty bins between the first and the last included.

    Each bin with lines fills the gap up to the next one, which it knows by ``with_next``; a
    gap is dealt out to tasks in stretches of ``gap_rows`` bins. So one stray date makes many
    rows, but no long array, and nothing is joined with the empty bins.
    """
    unit, step = BINS.get(freq, BINS["1min"])
    rows = parsed.where("timestamp is not null")
    if template is not None:
        rows = rows.where(F.col("template") == template)
    counts = rows.groupBy(F.date_trunc(unit, "timestamp").cast("timestamp_ntz").alias("timestamp")).agg(F.count("*").alias("count"))
    seconds = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit]
    at = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))  # noqa: E731  of session time zone UTC
    known = with_next(counts, ["timestamp"], ["timestamp"])
    gaps = known.select(at("timestamp").alias("_at"), F.floor((at("next_timestamp") - at("timestamp")) / seconds - 1).alias("_n")).where("_n > 0")
    parts = gaps.select("_at", "_n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / gap_rows))).alias("_part")).repartition("_at", "_part")
    first = F.col("_part") * gap_rows + 1
    empty = parts.select("_at", F.explode(F.sequence(first, F.least(first + gap_rows - 1, F.col("_n")))).alias("_k"))
    bins = empty.select(F.timestamp_seconds(F.col("_at") + F.col("_k") * seconds).cast("timestamp_ntz").alias("timestamp"), F.lit(0).cast("bigint").alias("count"))
    return known.select("timestamp", "count").unionByName(bins)


def stride_downsample(histogram: DataFrame, max_points: int = 5000) -> DataFrame:
    """Of more than ``max_points`` bins, every (n // max_points + 1)-th from the first on."""
    numbered = number_rows(histogram, ["timestamp"], name="_seq")
    n = numbered.count()
    step = n // max_points + 1 if n > max_points else 1
    return numbered.where((F.col("_seq") - 1) % step == 0).drop("_seq")


def unique_patterns(parsed: DataFrame) -> DataFrame:
    """Cleaned templates per file with their counts: ``filename``, ``count``, ``template``."""
    rows = parsed.where("template is not null").select(F.col("file").alias("filename"), clean_template(F.col("template")).alias("template"))
    return rows.groupBy("filename", "template").agg(F.count("*").alias("count")).select("filename", "count", "template")


def lines_for_template(parsed: DataFrame, template: str) -> DataFrame:
    """The lines of a template, without template columns."""
    return parsed.where(F.col("template") == template).drop("template", "parameter_list")
