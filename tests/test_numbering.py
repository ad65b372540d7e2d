"""Running numbers, gap filling and carving in parallel, against plain loops."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from logweave.operators import ingest, telemetry, templates
from logweave.operators.numbering import number_rows, with_next
from logweave.plans.queries import QUERIES


def test_numbers_and_neighbours(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None, "hot", "hot", "hot"]), k, r.randrange(50)) for k in range(2000)]
    df = spark.createDataFrame(rows, "g string, k bigint, v int").repartition(7)
    want = {k: n for n, (_, k, _) in enumerate(sorted(rows, key=lambda x: (-x[2], x[1])), 1)}
    assert {x.k: x.seq for x in number_rows(df, [F.desc("v"), "k"]).collect()} == want
    found = number_rows(df, ["v", "k"], ["g"], "n")
    assert found.columns == ["g", "k", "v", "n"]
    for g in ("a", "b", None, "hot"):
        of = sorted((v, k) for h, k, v in rows if h == g)
        assert sorted((x.n, x.v, x.k) for x in found.where(F.col("g").eqNullSafe(g)).collect()) == [(n, v, k) for n, (v, k) in enumerate(of, 1)]
    after = sorted((v, k) for _, k, v in rows)
    assert sorted(((x.v, x.k), x.next_k) for x in with_next(df, ["v", "k"], ["k"]).collect()) == [(a, b and b[1]) for a, b in zip(after, [*after[1:], None])]
    assert number_rows(df.limit(0), ["k"]).count() == 0


@pytest.mark.parametrize("name", ["merge_rotated", "top_templates", "histogram_downsample", "template_histogram_1s", "carve_json"])
def test_no_window_without_key(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert sum("SinglePartition" in x for x in plan.splitlines()) <= (name == "top_templates")  # the sum of all counts, one row a task


def times(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").cast("timestamp_ntz").alias("timestamp"))


def test_gaps_are_filled_in_stretches(spark):
    rows = times(spark, "2024-01-01 00:00:00.5", "2024-01-01 00:00:00.9", "2024-01-01 00:00:01", "2024-01-01 00:05:00", "2023-12-31 23:59:58", None)
    for step in (1, 7, 100_000):
        got = sorted(map(tuple, templates.template_histogram(rows, "1s", gap_rows=step).collect()))
        assert [t for t, _ in got] == [datetime.datetime(2023, 12, 31, 23, 59, 58) + datetime.timedelta(seconds=k) for k in range(303)]
        assert [n for _, n in got if n] == [1, 2, 1, 1]
    assert templates.template_histogram(rows.limit(0), "1s").count() == 0
    assert templates.template_histogram(times(spark, "2024-02-29 13:00:00"), "1d").collect() == [(datetime.datetime(2024, 2, 29), 1)]


def test_a_stray_date_makes_rows_not_arrays(spark):
    rows = times(spark, "2023-01-01 00:00:00", "2024-01-01 00:00:00")
    filled = templates.template_histogram(rows, "1s")
    assert filled.agg(F.count("*"), F.sum("count"), F.count_distinct(F.date_trunc("day", "timestamp"))).first() == (365 * 86400 + 1, 2, 366)


def carved(lines):
    """(report, text) of lines, by the loop."""
    out, parts, depth = [], None, 0
    for line in lines:
        line = (line or "").strip()
        if parts is None:
            at = line.find("{")
            if at < 0:
                continue
            parts, depth, line = [], 0, line[at:]
        parts.append(line)
        depth += line.count("{") - line.count("}")
        if depth == 0:
            out.append((len(out) + 1, "".join(parts).rstrip("% ")))
            parts = None
    return out


@pytest.mark.parametrize("block", [1, 3, 64, 50_000])
def test_carving_equals_the_loop(spark, block):
    r = random.Random(block)
    files = {}
    for f in ("one", "two", "three", "long"):
        n = 1500 if f == "long" else 200
        files[f] = [r.choice(["{", "}", "{a", "b}", "x", "}{", "{}", "{{", "}}", "", " y ", "z } {", "{q} %"]) if r.random() < 0.7 else None for _ in range(n)]
    files["open"] = ["{a}", "{", "{", "b", "}"] + ["c"] * 100
    files["empty"] = ["x", "y"]
    files["closed late"] = ["{"] * 30 + ["x"] * 30 + ["}"] * 30 + ["{", "}", "}", "{"]
    rows = [(f, k * 2, x) for f, lines in files.items() for k, x in enumerate(lines)]
    df = spark.createDataFrame(rows, "file string, line_no bigint, line string").repartition(5)
    got = {}
    for x in telemetry.carve_json(df, block).collect():
        got.setdefault(x.file, []).append((x.report_id, x.json))
    assert {f: sorted(x) for f, x in got.items()} == {f: want for f, lines in files.items() if (want := carved(lines))}


def test_one_file_is_carved_by_many_tasks(spark):
    lines = spark.range(200_000).select(F.lit("hot").alias("file"), F.col("id").alias("line_no"), F.when(F.col("id") % 4 == 1, "{").when(F.col("id") % 4 == 3, "}").otherwise("x").alias("line"))
    assert telemetry.carve_json(lines, 1000).agg(F.count("*"), F.max("report_id"), F.max(F.length("json"))).first() == (50_000, 50_000, 3)
    plan = telemetry.carve_json(lines, 1000)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(file#\d+, block#", plan)


def test_rotated_files_of_one_base(spark):
    rows = [("a", "x.txt", k, f"{(k * 7) % 10} {k}") for k in range(100)] + [("b", "x.txt.1", k, f"{k % 3} r{k}") for k in range(50)] + [("a", "y.txt", 1, "z"), ("a", "y.txt", 2, "a")]
    got = sorted(map(tuple, ingest.merge_rotated(spark.createDataFrame(rows, "archive string, member string, line_no bigint, line string")).collect()))
    x = [r[3] for r in sorted(rows[:150], key=lambda r: (r[3].split()[0], r[1], r[0], r[2]))]
    assert got == [("x.txt", k, t) for k, t in enumerate(x, 1)] + [("y.txt", 1, "z"), ("y.txt", 2, "a")]
