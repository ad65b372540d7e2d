import datetime

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from logweave.functions.entities import entity_spans
from logweave.functions.text import similarity_band, size_mb
from logweave.operators import rules as R
from logweave.operators import search, templates
from logweave.operators.templates import WILDCARD, cluster_shapes
from logweave.plans.inputs import CATALOGUE
from logweave.sources import sinks
from logweave.sources.rules import flatten_rules, pattern_problem, read_rules, validate_catalogue, validate_rules

PARSED = "file string, line_no bigint, timestamp timestamp_ntz, loglines string"


def parsed(spark, lines, file="a"):
    t = datetime.datetime(2024, 3, 1, 10)
    return spark.createDataFrame([(file, k, t + datetime.timedelta(seconds=k), x) for k, x in enumerate(lines)], PARSED)


def test_mining_and_parameters(spark):
    rows = templates.mine_templates(parsed(spark, ["user alice in", "user bob in", "user carol in", "disk 7 full", "disk 9 full"])).orderBy("line_no").collect()
    assert [r.template for r in rows] == [f"user {WILDCARD} in"] * 3 + ["disk <NUM> full"] * 2
    assert [r.parameter_list for r in rows] == [["alice"], ["bob"], ["carol"], ["7"], ["9"]]


def test_mining_does_not_depend_on_partitions(spark):
    lines = [f"svc {a} state {b} code {k % 5}" for k, (a, b) in enumerate((x, y) for x in ("up", "down", "idle") for y in ("ok", "bad", "old", "new"))]
    one = {r.line_no: r.template for r in templates.mine_templates(parsed(spark, lines).coalesce(1)).collect()}
    assert one == {r.line_no: r.template for r in templates.mine_templates(parsed(spark, lines).repartition(7)).collect()}
    assert templates.mine_templates(parsed(spark, ["x"]).limit(0)).count() == 0


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.lists(st.sampled_from("abcd"), min_size=4, max_size=4), min_size=1, max_size=12))
def test_cluster_invariants(words):
    import pandas as pd

    shapes = pd.DataFrame({"tokens": words, "first": [f"{k:03d}" for k in range(len(words))]})
    out = cluster_shapes(shapes.drop_duplicates("first"), 0.5, 1024)
    for tokens, template in zip(out["tokens"], out["template"]):
        parts = template.split(" ")
        assert len(parts) == len(tokens) and all(p in (WILDCARD, t) for p, t in zip(parts, tokens))


def test_histogram_fills_gaps(spark):
    rows = spark.createDataFrame([("2024-01-01 10:00:10", "x"), ("2024-01-01 10:03:59", "x"), (None, "x")], "t string, template string").select(F.col("t").cast("timestamp_ntz").alias("timestamp"), "template")
    got = [(r["timestamp"].minute, r["count"]) for r in templates.template_histogram(rows, "1min").orderBy("timestamp").collect()]
    assert got == [(0, 1), (1, 0), (2, 0), (3, 1)]
    assert templates.template_histogram(rows, "other", "y").count() == 0
    points = spark.range(11).select(F.timestamp_seconds("id").alias("timestamp"), F.lit(1).alias("count"))
    assert templates.stride_downsample(points, 5).count() == 4


def test_counts_and_profile(spark):
    rows = spark.createDataFrame([("f", "t", ["a", ""]), ("f", "t", ["b", "x"]), ("f", None, [])], "file string, template string, parameter_list array<string>")
    assert [tuple(r) for r in templates.template_counts(rows).collect()] == [("f", "t", 2)]
    got = {r.position: (r["count"], r["values"]) for r in templates.parameter_profile(rows, "t").collect()}
    assert got == {"POSITION_1": (2, "a, b"), "POSITION_2": (1, "x")}
    assert templates.parameter_profile(rows, distinct_values=1).where("position = 'POSITION_1'").first()["values"] == "a"
    assert templates.lines_for_template(rows, "t").columns == ["file"]


def catalogue(spark, text=CATALOGUE):
    return flatten_rules(spark.createDataFrame([(text,)], "text string"))


def test_rules(spark, tmp_path):
    rules = catalogue(spark)
    assert rules.where("pattern is not null").count() == 6
    assert {r.category for r in rules.collect()} == {"Legal", "Noise", "Empty"}
    assert {(r.Title, r.FileName): r.PatternCount for r in R.rule_catalog_summary(rules).collect()}[("License notice", " SRC0 ")] == 2
    n = {"src0.log": 101, "src1.x": 5, "SRC2.txt": 1, "src0.txt": 100, "other.log": 50}
    lines = spark.createDataFrame([(f, k, f"{k} LOUD!! Licensed under") for f, m in n.items() for k in range(m)], "file string, line_no bigint, line string")
    hits = R.apply_rules(lines, rules).collect()
    got = {(h.FileName, h.Description): (h.Frequency, h.SampleLogs) for h in hits}
    assert got[("src0.log", "license line")][0] == 100 and got[("src0.txt", "license line")][0] == 100
    assert got[("src0.log", "capitals")][1] == [f"{k} LOUD!! Licensed under" for k in range(5)]
    assert got[("src1.x", "license line")][0] == 5 and got[("SRC2.txt", "capitals")][0] == 1
    assert not any(h.FileName == "other.log" for h in hits)
    assert {h.Cause for h in hits if h.Category == "Noise"} == {""}
    report = R.rule_report(R.apply_rules(lines, rules)).where("FileName = 'src0.log' and Category = 'Legal'").collect()
    assert [(r.Number, r.Highlight) for r in report] == [(1, True)]
    sinks.export_rules(rules, str(tmp_path / "rules"))
    again = read_rules(spark, str(tmp_path / "rules"))
    order = ["category", "title", "file_name", "pattern"]
    assert again.where("pattern is not null").orderBy(order).collect() == rules.where("pattern is not null").orderBy(order).collect()


def test_bad_rules(spark):
    assert catalogue(spark, "{nonsense").count() == 0
    bad = catalogue(spark, '{"A": [{"Title": "t", "CPELogs": [{"FileName": "f", "Regex": [{"pattern": "(("}, {"pattern": "ok"}]}]}]}')
    assert [r.pattern for r in validate_rules(bad).collect()] == ["(("]
    texts = spark.createDataFrame([("[]",), ('{"a": 1}',), ("x",), ('{"a": []}',)], "text string")
    assert {r.text: r.problem for r in validate_catalogue(texts).collect()} == {"[]": "no object", '{"a": 1}': "a category is no list", "x": "no JSON"}
    assert pattern_problem(spark, "a+") is None


def test_search(spark):
    lines = spark.createDataFrame([("f", k, x) for k, x in [(1, "an Error here"), (1000, "error"), (1001, "ERRORS"), (1002, "10.0.0.1 at 10:11:12")]], "file string, line_no bigint, line string")
    assert [(r.line_no, r.page) for r in search.search_lines(lines, "error").orderBy("line_no").collect()] == [(1, 1), (1000, 1), (1001, 2)]
    assert search.search_lines(lines, "((").count() == 0
    assert [search.quick_search(lines, n).count() for n in ("error", "warn", "ip", "time")] == [2, 0, 1, 1]
    assert [r.line_no for r in search.page(lines, "f", 2).orderBy("line_no").collect()] == [1001, 1002]
    assert search.page_stats(lines).first().total_pages == 1


@pytest.mark.parametrize("seconds", [0, 3, 60])
def test_context_window(spark, seconds):
    rows = templates.mask_templates(parsed(spark, [f"m {k % 2}x" for k in range(50)]))
    anchors = rows.where("line_no in (0, 10, 11)").select(F.col("line_no").alias("anchor_id"), "file", F.col("timestamp").alias("anchor_ts"), "template")
    got = {(r.anchor_id, r.line_no, r.is_selected) for r in search.context_window(rows, anchors, seconds).collect()}
    assert got == {(a, k, a % 2 == k % 2) for a in (0, 10, 11) for k in range(50) if abs(a - k) <= seconds}


def test_entities(spark):
    line = "2024-01-02 03:04:05 [mod-1] ERROR 10.0.0.1 /var/log/x --flag=1 aa:bb:cc:dd:ee:ff"
    rows = spark.createDataFrame([("f", line), ("f", None)], "file string, line string")
    spans = rows.select(entity_spans("line").alias("s")).collect()
    assert [x.kind for x in spans[0].s] == ["timestamp", "module", "error", "ip", "path", "cli", "mac"] and spans[1].s == []
    assert all(line[x.start : x.end] == x.text for x in spans[0].s)
    counts = {(r.kind, r.text): r["count"] for r in search.entity_counts(rows).collect()}
    assert counts[("ip", "10.0.0.1")] == 1 and counts[("error", "ERROR")] == 1


def test_small_functions(spark):
    r = spark.range(1).select(size_mb(F.lit(1572864)).alias("m"), *[similarity_band(F.lit(x)).alias(f"b{k}") for k, x in enumerate((0.8, 0.5, 0.49))]).first()
    assert tuple(r) == (1.5, "high", "medium", "low")
