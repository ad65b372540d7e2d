"""Rule hits and reports."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.literals import required_texts
from ..functions.text import file_stem
from ..session import ship

#: Rules of a catalogue at most, of those that one projection holds, and characters of the texts that they require.
MAX_RULES, PLAIN_RULES, MAX_TEXT_CHARS = 100_000, 200, 8_000_000


def _matched(held: list[Row]) -> Column:
    """The positions of the rules that match a line (``file``, ``line``); each pattern is a literal of one projection."""
    by_key: dict[str, list[int]] = {}
    for k, r in enumerate(held):
        by_key.setdefault(r["file_key"], []).append(k)
    none = F.lit(None).cast("array<int>")
    stem = file_stem(F.col("file"))
    return reduce(lambda rest, key: F.when(stem == key, F.array_compact(F.array(*[F.when(F.col("line").rlike(held[k]["pattern"]), F.lit(k)) for k in by_key[key]]))).otherwise(rest), by_key, none)


def rule_matches(rules: DataFrame) -> tuple[list[Row], Column]:
    """The rules with a pattern, and the positions in them of those that match a line (``file``, ``line``).

    The catalogue is collected; more than ``PLAIN_RULES`` rules are refused.
    """
    held = rules.where("pattern is not null").select("category", "title", "cause", "file_key", "pattern", "description").limit(PLAIN_RULES + 1).collect()
    if len(held) > PLAIN_RULES:
        raise ValueError(f"more than {PLAIN_RULES} rules")
    return held, _matched(held)


def _sifted(lines: DataFrame, held: list[Row]) -> DataFrame:
    """``lines`` (``file``, ``line_no``, ``line``) with ``rule``: each rule for the line's file that the line matches.

    An automaton of the texts that patterns require (``required_texts``) walks once over each
    line; only rules with a text in the line, and those that require none, meet the line with
    their pattern. The automaton goes to the tasks as a list of texts of a checked size and
    is built once a worker.
    """
    spark = lines.sparkSession
    ship(spark)
    texts: dict[tuple[bool, str], set[int]] = {}
    always: dict[str, list[int]] = {}
    for k, r in enumerate(held):
        found = required_texts(r["pattern"])
        if found is None:
            always.setdefault(r["file_key"], []).append(k)
        for t in found[0] if found else ():
            texts.setdefault((found[1], t), set()).add(k)
    if sum(len(t) for _, t in texts) > MAX_TEXT_CHARS:
        raise ValueError(f"patterns require more than {MAX_TEXT_CHARS} characters")
    keys = [r["file_key"] for r in held]
    known = spark.sparkContext.broadcast(([(lower, t, sorted(ks)) for (lower, t), ks in texts.items()], always, keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        words, rest, key_of = known.value
        walks = []
        for lower in (False, True):
            walk = ahocorasick.Automaton()
            for low, t, ks in words:
                if low == lower:
                    walk.add_word(t, ks)
            if len(walk):
                walk.make_automaton()
                walks.append((lower, walk))
        for batch in batches:
            at, rules = [], []
            for k, (line, key) in enumerate(zip(batch.column("line").to_pylist(), batch.column("key").to_pylist())):
                if line is None:
                    continue
                hits = {r for lower, walk in walks for _, ks in walk.iter(line.lower() if lower else line) for r in ks if key_of[r] == key}
                hits.update(rest.get(key, ()))
                at += [k] * len(hits)
                rules += hits
            rows = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(rules, pa.int32())], ["file", "line_no", "line", "rule"])

    schema = f"file string, line_no {lines.schema['line_no'].dataType.simpleString()}, line string, rule int"
    may = lines.select("file", "line_no", "line", file_stem(F.col("file")).alias("key")).where(F.col("key").isin(sorted(set(keys))))
    patterns = spark.createDataFrame([(k, r["pattern"]) for k, r in enumerate(held)], "rule int, pattern string")
    return may.mapInArrow(run, schema).join(F.broadcast(patterns), "rule").where(F.expr("line rlike pattern")).drop("pattern")


def apply_rules(lines: DataFrame, rules: DataFrame, cap: int = 100, samples: int = 5) -> DataFrame:
    """Hits of the rules on the lines (``file``, ``line_no``, ``line``) of the files they are for.

    A rule is for files whose stem is its ``file_key``. Each line passes once. Up to
    ``PLAIN_RULES`` patterns are literals of one projection, so each compiles once a task;
    more are sifted by an automaton of the texts that they require (``_sifted``), with the
    same result. More than ``MAX_RULES`` are refused.
    ``Frequency`` counts up to ``cap`` matching lines of a file, ``SampleLogs`` are the first
    ``samples`` of them. Spark cuts each task's rows of a group to ``cap`` before the shuffle,
    so a rule may hit any share of the lines.

    Rules without pattern are passed over; patterns that do not compile fail (see ``validate_rules``).
    """
    held = rules.where("pattern is not null").select("category", "title", "cause", "file_key", "pattern", "description").limit(MAX_RULES + 1).collect()
    if len(held) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    if len(held) > PLAIN_RULES:
        hits = _sifted(lines, held)
    else:
        stem, keys = file_stem(F.col("file")), sorted({r["file_key"] for r in held})
        hits = lines.where(stem.isin(keys)).select("file", "line_no", "line", F.explode(_matched(held)).alias("rule"))
    ranked = hits.withColumn("rn", F.row_number().over(Window.partitionBy("file", "rule").orderBy("line_no"))).where(F.col("rn") <= cap)
    first = F.array_sort(F.collect_list(F.when(F.col("rn") <= samples, F.struct("rn", "line"))))
    counts = ranked.groupBy("file", "rule").agg(F.count("*").cast("int").alias("Frequency"), F.transform(first, lambda x: x["line"]).alias("SampleLogs"))
    rows = [(k, r["category"], r["title"], r["cause"], r["description"]) for k, r in enumerate(held)]
    names = lines.sparkSession.createDataFrame(rows, "rule int, Category string, Title string, Cause string, Description string")
    return counts.join(F.broadcast(names), "rule").select("Category", "Title", "Cause", "Description", "Frequency", "SampleLogs", F.col("file").alias("FileName"))


def rule_summary(hits: DataFrame) -> DataFrame:
    """Number of hits and the distinct categories."""
    return hits.agg(F.count("*").alias("total_issues"), F.array_join(F.array_sort(F.collect_set("Category")), ", ").alias("categories"))


def rule_bars(hits: DataFrame) -> DataFrame:
    """Frequency by title and category."""
    return hits.groupBy("Title", "Category").agg(F.sum("Frequency").alias("Frequency"))


def rule_report(hits: DataFrame, highlight: int = 10) -> DataFrame:
    """Numbered records per category, title, cause and file; those above ``highlight`` are marked."""
    record = F.struct("Description", "Frequency", F.array_join("SampleLogs", "\n").alias("Samples"), (F.col("Frequency") > highlight).alias("Highlight"))
    groups = hits.groupBy("Category", "Title", "Cause", "FileName").agg(F.array_sort(F.collect_list(record)).alias("records"))
    return groups.select("Category", "Title", "Cause", "FileName", F.posexplode("records").alias("pos", "r")).select(
        "Category", "Title", "Cause", "FileName", (F.col("pos") + 1).alias("Number"), "r.Description", "r.Frequency", "r.Samples", "r.Highlight"
    )


def rule_catalog_summary(rules: DataFrame) -> DataFrame:
    """Patterns per category, title and file."""
    return rules.groupBy(F.col("category").alias("Category"), F.col("title").alias("Title"), F.col("file_name").alias("FileName")).agg(F.count("pattern").alias("PatternCount"))
