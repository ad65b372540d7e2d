"""What tasks send on: no word lists for a join, no vectors with the nearest rows, one signature a page."""

import pyarrow as pa
from pyspark.sql import functions as F

from logweave.operators import search, templates, vectors


def test_lines_meet_their_templates_by_digest(spark):
    lines = spark.createDataFrame([("f", k, f"user {k} logged in") for k in range(20)] + [("f", 99, None)], "file string, line_no bigint, loglines string")
    found = templates.mine_templates(lines).select("line_no", "template")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join [_tokens" not in plan and "Join [_list" in plan
    assert {r.template for r in found.collect()} == {"user <NUM> logged in", None}


def test_digests_tell_lists_apart(spark):
    lists = [["a", "b"], ["ab"], ["a\x01b", "c"], ["a", "b\x01c"], ["", "ab"], ["ab", ""], [], [""], ["a b"], ["a", " b"]]
    rows = spark.createDataFrame([(x,) for x in lists], "words array<string>")
    assert rows.select(templates._digest(F.col("words")).alias("d")).distinct().count() == len(lists)
    assert spark.createDataFrame([(None,)], "words array<string>").select(templates._digest(F.col("words")).alias("d")).first().d is None


def test_nearest_rows_leave_their_vectors(spark):
    table = spark.createDataFrame([(k, "f", [1.0, float(k)]) for k in range(9)], "vec_id bigint, file string, embedding array<float>")
    queries = spark.createDataFrame([(1, [0.0, 1.0])], "query_id int, query array<double>")
    found = vectors.vector_topk(table, queries, 3)
    assert sorted(found.columns) == ["file", "query_id", "rank", "similarity", "vec_id"]
    assert [r.vec_id for r in found.orderBy("rank").collect()] == [8, 7, 6]


def test_one_signature_a_page():
    rows = [("f" if k < 300 else None, k // 100, f"line {k}") for k in range(500)] + [("g", 9, None), ("g", 9, ""), ("g", 9, "ab")]
    table = pa.table({"file": pa.array([r[0] for r in rows], pa.string()), "page": pa.array([r[1] for r in rows], pa.int64()), "text": pa.array([r[2] for r in rows], pa.string())})
    want = [r for b in search._signatures(iter(table.to_batches(1000))) for r in b.to_pylist()]
    assert [(r["file"], r["page"]) for r in want] == [("f", 0), ("f", 1), ("f", 2), (None, 3), (None, 4)]
    for size in (1, 7, 150):
        assert [r for b in search._signatures(iter(table.to_batches(size))) for r in b.to_pylist()] == want
