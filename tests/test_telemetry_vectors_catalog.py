import datetime

import numpy as np
from pyspark.sql import functions as F

from logweave.functions.telemetry import flatten_json, kv_split, parse_size
from logweave.operators import catalog, telemetry as T, vectors as V
from logweave.operators.vector_index import approx_topk

LOG = [
    "2024-03-01T10:00:00 host T2.INFO [tid=9] stray } here",
    '2024-03-01T10:00:00 host T2.INFO [tid=9] cJSON Report : {"Report":[{"Time":"2024-03-01 10:00:00"},',
    '2024-03-01T10:00:00 host T2.INFO [tid=9] {"Device.mac":"AA:BB"},{"Device.ccsp_memory_usage_split":',
    '"NAME=wifi|RSS=12;NAME=wan|RSS=7;"},{"x.meminfoavailable_split":"2m"},{"y":""},{"z":"null"}]} %',
    "plain line",
    '{"Report":[{"Time":"2024-03-01 11:00:00"},{"Device.mac":"CC"},{"a":{"b":1}}]}',
    '{"Report":[{"Time":"never closed"}',
]


def reports(spark):
    lines = spark.createDataFrame([("d", k, x) for k, x in enumerate(LOG)], "file string, line_no bigint, line string")
    return T.carve_json(lines)


def test_carve_and_table(spark):
    found = reports(spark).orderBy("report_id").collect()
    assert [r.report_id for r in found] == [1, 2]
    assert found[0].json.startswith('{"Report"') and found[0].json.endswith("}]}")
    table = T.telemetry_table(reports(spark))
    rows = {(r.report_id, r.key): r.value for r in table.collect()}
    assert rows[(1, "Report.Device.mac")] == "AA:BB" and not any(k.endswith((".y", ".z")) for _, k in rows)
    assert {r.time for r in table.where("report_id = 1").collect()} == {datetime.datetime(2024, 3, 1, 10)}
    assert T.latest_value(table, ["MAC"]).first().value == "CC"
    assert T.device_info(table).first().MAC == "CC"
    assert {(r.NAME, r.fields["RSS"]) for r in T.process_memory(table).collect()} == {("wifi", "12"), ("wan", "7")}
    assert T.process_names(T.process_memory(table)).count() == 2 and T.process_rows(T.process_memory(table), "wan").count() == 1
    assert T.metric_series(table, "memory").first().MEM_AVAILABLE == 2048.0
    wide = T.telemetry_wide(table, ["MAC", "MEM_AVAILABLE", "VERSION"])
    assert wide.columns[-3:] == ["MAC", "MEM_AVAILABLE", "VERSION"]
    assert "VERSION" not in T.drop_empty_columns(wide).columns
    assert T.metric(table, ".mac").count() == 2 and T.metric(table, ".mac", 1).count() == 0


def test_flatten_and_sizes(spark):
    rows = spark.createDataFrame([('{"a": {"b": 1, "c": [1, {"d": "x"}]}}',), ("{bad",), (None,), ("[1]",)], "j string")
    assert [r[0] for r in rows.select(flatten_json("j")).collect()] == [{"a.b": "1", "a.c": "1", "a.c.d": "x"}, None, None, None]
    sizes = spark.createDataFrame([(x,) for x in ("2m", "5 kB", "x", "12", None)], "s string").select(parse_size(F.col("s")).alias("v")).collect()
    assert [r.v for r in sizes] == [2048.0, 5.0, None, 12.0, None]
    packed = spark.createDataFrame([("a=1|b = 2; ;a=1|a=3",)], "s string").select(kv_split(F.col("s")).alias("m")).first().m
    assert packed == [{"a": "1", "b": "2"}, {"a": "3"}]
    one, two = spark.range(1).select(F.lit(1).alias("x")), spark.range(1).select(F.lit(2).alias("y"))
    assert sorted(map(tuple, T.union_reports(one, two).collect()), key=str) == [(1, None), (None, 2)]


def test_vectors(spark):
    counts = spark.createDataFrame([("f", "disk full", 3), ("g", "disk full", 1), ("f", "link up", 2)], "file string, template string, count bigint")
    v = V.embed_templates(counts)
    assert all(abs(np.linalg.norm(r.embedding) - 1) < 1e-5 for r in v.collect())
    q = v.where("template = 'link up'").select(F.lit(1).alias("query_id"), F.col("embedding").alias("query"))
    best = V.vector_topk(v.select("file", "template", "embedding"), q, 10).orderBy("rank").collect()
    assert len(best) == 3 and best[0].template == "link up" and best[0].similarity == 1.0
    assert [(r.file, r.template) for r in best[1:]] == [("f", "disk full"), ("g", "disk full")]
    assert V.vector_topk(v.limit(0).select("file", "template", "embedding"), q).count() == 0
    prompt = {r.file: r.prompt for r in V.prompt_rows(v).collect()}
    assert prompt["f"].split("\n")[0] == '{"filename":"f","template":"disk full","frequency":3}'
    near = approx_topk(v.select("file", "template", "embedding"), q.first().query, 1).first()
    assert near.template == "link up"


def test_catalog(spark):
    files = spark.createDataFrame(
        [(1, "p", "a.log", "a.log", 10), (2, "p", "b.ZIP", "x.ZIP", 5), (3, "p", "c.txt", "Telemetry2_0.log", 5), (4, "q", "d.txt", "SelfHeal.txt", 5), (5, "q", "e.log", "e", 0), (6, "q", "f.log", "f", None)],
        "id int, project_id string, file string, original_name string, file_size bigint",
    )
    assert [r.id for r in catalog.eligible_files(files).orderBy("id").collect()] == [1, 2]
    assert {r.id: r.is_viewable for r in catalog.viewable_files(files).collect()} == {1: True, 2: False, 3: True, 4: True}
    manifest = spark.createDataFrame([("a.log", "parsed"), ("c.txt", "error")], "file string, state string")
    assert {r.id for r in catalog.unprocessed_files(files, manifest).collect()} == {2, 3, 4, 5, 6}
    assert {r.state: r.all_done for r in catalog.pipeline_status(manifest).collect()} == {"parsed": False, "error": False}
    projects = spark.createDataFrame([("p", 1, 1), ("q", 1, 2), ("r", 2, 3)], "id string, user_id int, last_accessed int")
    rolled = catalog.project_rollup(projects, files).collect()
    assert [(r.id, r.file_count, r.total_size) for r in rolled] == [("r", 0, 0), ("q", 3, 5), ("p", 3, 20)]
    users = spark.createDataFrame([(1, True, 1), (2, False, 2), (3, False, 3)], "id int, is_admin boolean, created_at int")
    u = catalog.user_rollup(users, projects, files)
    assert [(r.id, r.project_count, r.file_count) for r in u.collect()] == [(3, 0, 0), (2, 1, 0), (1, 2, 6)]
    assert tuple(catalog.system_stats(u).first()) == (3, 1, 3, 6)
    index = spark.createDataFrame([(0, "heal", "h"), (1, "self", "s")], "position int, supported string, config string")
    routed = catalog.route_by_name(files.select(F.col("original_name").alias("file")), index).collect()
    assert {r.file: r.config for r in routed}["SelfHeal.txt"] == "h" and {r.file: r.config for r in routed}["e"] is None


def test_latest_value_takes_the_key_asked_for(spark):
    rows = [("d", 1, 10, "A.manufacturer", "first"), ("d", 1, 10, "B.manufacturer", "second"), ("d", 2, 11, "B.manufacturer", "later"), ("d", 2, 11, "A.manufacturer", "now"), ("e", 1, 10, "A.manufacturer", "alone"), ("e", 2, None, "A.manufacturer", "no time")]
    table = spark.createDataFrame(rows, "device string, report_id int, t int, key string, value string")
    table = table.select("device", "report_id", F.timestamp_seconds("t").cast("timestamp_ntz").alias("time"), "key", "value")
    assert {r.device: r.value for r in T.latest_value(table, ["MANUFACTURER"]).collect()} == {"d": "now", "e": "alone"}
    assert {r.device: r.MANUFACTURER for r in T.device_info(table).collect()} == {"d": "later", "e": None}


def test_reports_keep_the_order_of_their_list(spark):
    from logweave.sources.logs import reports_of

    texts = spark.createDataFrame([("f", '[{"z": 1}, {"a": 2}, 7, {"m": 3}]'), ("g", '{"b": 1}'), ("h", "no json"), ("i", None)], "file string, text string")
    got = sorted((r.file, r.report_id, r.json) for r in reports_of(texts).collect())
    assert got == [("f", 1, '{"z":1}'), ("f", 2, '{"a":2}'), ("f", 3, '{"m":3}'), ("g", 1, '{"b":1}')]
