import datetime

import pytest
from pyspark.sql import functions as F

from logweave.functions.text import mask_values
from logweave.plans.inputs import CATALOGUE
from logweave.plans.queries import QUERIES
from logweave.sources.rules import flatten_rules
from logweave.streaming import streams


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    for f in range(3):
        t = datetime.datetime(2024, 1, 1, 10, f)
        lines = [f"{t:%Y-%m-%d %H:%M:%S} user u{k} code {k} Licensed under" for k in range(10)]
        (tmp_path / "in" / f"src{f}.log").write_text("\n".join([*lines, lines[0]]) + "\n")
    return tmp_path


def run(df, folder, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_lines_and_dedupe(spark, folder):
    lines = streams.stream_log_lines(spark, str(folder / "in"))
    assert run(lines, folder, "s_lines").count() == 33
    assert run(streams.stream_dedupe(lines), folder, "s_dedupe").count() == 30


def test_counts_equal_batch(spark, folder):
    lines = streams.stream_log_lines(spark, str(folder / "in"))
    got = run(streams.stream_template_counts(lines, late="0 seconds"), folder, "s_counts")
    batch = run(lines, folder, "s_all").groupBy(F.date_trunc("minute", "ts").alias("start"), mask_values(F.col("loglines")).alias("template")).count()
    final = {(r.start, r.template, r["count"]) for r in got.collect()}
    assert final and final <= {(r.start, r.template, r["count"]) for r in batch.collect()}


def test_mining_keeps_clusters(spark, folder):
    mined = run(streams.stream_mine_templates(streams.stream_log_lines(spark, str(folder / "in"), max_files=1)), folder, "s_mined")
    assert mined.agg(F.sum("lines")).first()[0] == 33
    assert any("<*>" in r.template for r in mined.collect())


def test_rule_hits(spark, folder):
    rules = flatten_rules(spark.createDataFrame([(CATALOGUE,)], "text string"))
    got = run(streams.stream_rule_hits(streams.stream_log_lines(spark, str(folder / "in")), rules, cap=10), folder, "s_hits", "update")
    assert {(r.file, r.Frequency) for r in got.collect()} == {("src0.log", 10), ("src1.log", 10)}


def test_latest_status(spark, tmp_path):
    rows = [("d", "k", datetime.datetime(2024, 1, 1, h), str(h)) for h in (1, 3, 2)]
    spark.createDataFrame(rows, "device string, key string, time timestamp, value string").write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema("device string, key string, time timestamp, value string").parquet(str(tmp_path / "t"))
    assert run(streams.stream_latest_status(stream), tmp_path, "s_latest", "complete").first().value == "3"


@pytest.mark.parametrize("value", [streams.ROCKSDB, None])
def test_mining_query_leaves_the_state_store_setting(spark, sf_dir, value):
    """The session's own setting is back afterwards, so that later streams keep their state store."""
    key = "spark.sql.streaming.stateStore.providerClass"
    own = spark.conf.get(key)
    try:
        spark.conf.set(key, value) if value else spark.conf.unset(key)
        before = spark.conf.get(key)
        assert QUERIES["stream_mine_templates"](spark, sf_dir).count() > 0
        assert spark.conf.get(key) == before
    finally:
        spark.conf.set(key, own)
