import datetime
import io
import tarfile

from pyspark.sql import functions as F

from logweave.functions.text import file_stem, mask_values, normalise_member_name, rotation_base, rotation_number, tokenise
from logweave.operators import ingest
from logweave.sources.logs import read_json_reports, read_log_archive, read_log_lines, read_parsed_logs
from logweave.sources import sinks

LINES = [
    "orphan before any date",
    "2024-03-01T10:00:00 wifid: started pid=311",
    "2024-03-01-10-00-01: link up",
    "240301-10:00:02.987 rx 12 pkts",
    "Mar  1 10:00:03 host dropbear: login",
    "2024-03-01 10:00:04 ERROR code=7",
    "15.250000: hostapd assoc aa:bb:cc:dd:ee:ff",
    "  continuation of the line above",
    "2024-13-01 10:00:05 bad month",
    "2024-03-01T10:00:06.500Z frac",
    "",
    "\\n",
    "690301-10:00:02.1 old",
]


def frame(spark, lines, file="a.log"):
    return spark.createDataFrame([(file, k + 1, x) for k, x in enumerate(lines)], "file string, line_no bigint, line string")


def test_parse_logs(spark):
    rows = {r.line_no: (r.timestamp, r.loglines) for r in ingest.parse_logs(frame(spark, LINES)).collect()}
    at = lambda s, micro=0: datetime.datetime(2024, 3, 1, 10, 0, s, micro)
    first = datetime.datetime(1969, 3, 1, 10, 0, 2)
    assert rows[1] == (None, "orphan before any date")
    assert rows[2] == (at(0), "wifid: started pid=311")
    assert rows[3] == (at(1), "link up")
    assert rows[4] == (at(2), "rx 12 pkts")
    assert rows[5][0].year == 1969 and rows[5][1] == "host dropbear: login"  # the year of the earliest dated line
    assert rows[6] == (at(4), "ERROR code=7")
    assert rows[7] == (first + datetime.timedelta(seconds=15.25), "hostapd assoc aa:bb:cc:dd:ee:ff")
    assert rows[8] == (rows[7][0], "continuation of the line above")
    assert rows[9] == (rows[7][0], "bad month")
    assert rows[10] == (rows[7][0], "2024-03-01T10:00:06.500Z frac")
    assert 11 not in rows and 12 not in rows
    assert rows[13] == (first, "old")


def test_syslog_year_and_default_base(spark):
    lines = frame(spark, ["Mar  1 10:00:03 x", "2.5: y"])
    rows = {r.line_no: r.timestamp for r in ingest.parse_logs(lines, syslog_year=2021).collect()}
    assert rows[1] == datetime.datetime(2021, 3, 1, 10, 0, 3) and rows[2] == rows[1] + datetime.timedelta(seconds=2.5)
    only = ingest.parse_logs(frame(spark, ["2.5: y"]), default_base=datetime.datetime(2020, 1, 1)).first()
    assert only.timestamp == datetime.datetime(2020, 1, 1, 0, 0, 2, 500000)
    assert ingest.parse_logs(frame(spark, ["2.5: y"])).first().timestamp is None
    assert ingest.parse_logs(frame(spark, LINES).limit(0)).count() == 0


def test_forward_fill_blocks_agree(spark):
    rows = spark.createDataFrame([("f", k, k if k % 7 == 3 else None) for k in range(200)], "file string, line_no bigint, v bigint")
    one = ingest.forward_fill(rows, "v", block=1000).orderBy("line_no").collect()
    assert one == ingest.forward_fill(rows, "v", block=10).orderBy("line_no").collect()
    assert one[0].v is None and one[9].v == 3 and one[10].v == 10


def test_coverage_and_sort(spark):
    c = ingest.parse_coverage(frame(spark, LINES[:7])).first()
    assert (c.total, c.dated, c.parsed, c.without_time) == (7, 5, 6, 1)
    assert ingest.sort_parsed(ingest.parse_logs(frame(spark, LINES[:3]))).collect()[-1].timestamp is None


def test_masks_and_words(spark):
    cases = {
        "a 10.0.0.1:80": "a <IP>:<NUM>", "10.0.0.1/24": "<IP>/<NUM>", "aa:bb:cc:dd:ee:ff up": "<MAC> up", "[tid=12] x": "<THREADID> x", "VERSION=1.2.3": "<VERSION>",
        "at 2024-03-01T10:00:00 now": "at <DATETIME> now", "n=5": "n=<NUM>",
    }
    got = spark.createDataFrame([(k,) for k in cases], "x string").select("x", mask_values(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in got} == cases
    words = spark.createDataFrame([(" a=b:  c-d ",), ("",)], "x string").select(tokenise(F.col("x")).alias("w")).collect()
    assert [r.w for r in words] == [["a", "b", "c", "d"], [""]]


def test_names(spark):
    rows = spark.createDataFrame([("WiFi.Log.txt",), (".hidden",), ("none",)], "n string").select(file_stem(F.col("n")).alias("s")).collect()
    assert [r.s for r in rows] == ["wifi.log", ".hidden", "none"]
    rows = spark.createDataFrame([("x.txt.12",), ("x.txt",)], "n string").select(rotation_base(F.col("n")).alias("b"), rotation_number(F.col("n")).alias("k")).collect()
    assert [tuple(r) for r in rows] == [("x.txt", 12), ("x.txt", -1)]
    rows = spark.createDataFrame([("2024-03-01-10-00-0_Core.txt",), ("2029-03-01-10-00-0_Core.txt",)], "n string")
    assert [r[0] for r in rows.select(normalise_member_name(F.col("n"))).collect()] == ["Core.txt", "2029-03-01-10-00-0_Core.txt"]
    assert [r[0] for r in rows.select(normalise_member_name(F.col("n"), any_year=True)).collect()] == ["Core.txt", "Core.txt"]


def test_merge_rotated(spark):
    rows = [("a1", "WiFi.txt", 1, "b two"), ("a1", "WiFi.txt.1", 1, "a one"), ("a2", "WiFi.txt", 1, "b three"), ("a2", "single.txt", 1, "z"), ("a2", "single.txt", 2, "y")]
    merged = ingest.merge_rotated(spark.createDataFrame(rows, "archive string, member string, line_no bigint, line string")).orderBy("base", "seq").collect()
    assert [tuple(r) for r in merged] == [("WiFi.txt", 1, "a one"), ("WiFi.txt", 2, "b two"), ("WiFi.txt", 3, "b three"), ("single.txt", 1, "z"), ("single.txt", 2, "y")]


def test_files_and_archives(spark, tmp_path):
    (tmp_path / "x.log").write_bytes(b"one\r\ntwo\n\xff three\n" + b"l\n" * 500)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        lines = {r.line_no: r.line for r in read_log_lines(spark, str(tmp_path / "x.log")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(lines) == 503 and lines[1] == "one" and lines[2] == "two" and lines[503] == "l"
    with tarfile.open(tmp_path / "b.tgz", "w:gz") as tar:
        for name, data in (("root/WiFi.txt", b"b\na\n"), ("root/sub/mesh.txt", b"m\n")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    got = {(r.archive, r.member, r.line_no, r.line) for r in read_log_archive(spark, str(tmp_path / "b.tgz")).collect()}
    assert got == {("b.tgz", "WiFi.txt", 1, "b"), ("b.tgz", "WiFi.txt", 2, "a"), ("b.tgz", "sub/mesh.txt", 1, "m")}
    assert read_log_archive(spark, str(tmp_path / "x.log")).count() == 503
    assert read_parsed_logs(spark, str(tmp_path / "absent")).count() == 0


def test_json_reports(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\x01')
    (tmp_path / "b.json").write_text('[{"a": 1}, {"b": 2}]')
    (tmp_path / "c.json").write_text("{broken")
    got = sorted((r.file, r.report_id, r.json) for r in read_json_reports(spark, str(tmp_path)).collect())
    assert got == [("a.json", 1, '{"a":1}'), ("b.json", 1, '{"a":1}'), ("b.json", 2, '{"b":2}')]


def test_sinks(spark, tmp_path):
    parsed = ingest.parse_logs(frame(spark, LINES)).withColumns({"template": F.col("loglines"), "parameter_list": F.array()})
    sinks.write_parsed(parsed, str(tmp_path / "parsed"))
    assert read_parsed_logs(spark, str(tmp_path / "parsed")).where("file = 'a.log'").count() == parsed.count()
    v = spark.createDataFrame([("f", "t", 2, [1.0]), ("f", "t", 2, [1.0])], "file string, template string, frequency bigint, embedding array<float>")
    sinks.write_vectors(v, str(tmp_path / "v"))
    sinks.write_vectors(v, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == 1
    merged = spark.createDataFrame([("b", k, f"line {k}") for k in range(20)], "base string, seq bigint, line string")
    sinks.write_merged_logs(merged, str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m" / "base=b")).count() == 20
    sinks.export_unique_patterns(spark.createDataFrame([("f", 1, "t")], "filename string, count bigint, template string"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["filename", "count", "template"]
    sinks.write_rule_hits(v.select("file"), str(tmp_path / "hits"))
    sinks.write_json_reports(spark.createDataFrame([("f", 1, "{}")], "file string, report_id int, json string"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first().value == "{}"
    sinks.export_telemetry(spark.createDataFrame([("d", "2024-01-01", "k", "v")], "device string, time string, key string, value string"), str(tmp_path / "t"))
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).count() == 1
