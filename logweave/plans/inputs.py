"""Views of the driver's tables as log lines, telemetry, rules and catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stamp(ts: Column, pattern: str) -> Column:
    return F.date_format(ts.cast("timestamp"), pattern)


def event_line(events: DataFrame) -> Column:
    """An event as a log line's message."""
    return F.concat_ws(" ", F.concat(F.lit("["), F.col("event_type"), F.lit("]")), F.concat(F.lit("user="), F.col("user_id").cast("string")), F.concat(F.lit("props "), F.col("props")))


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw log lines with ISO time stamps: eight files, by user."""
    e = table(spark, sf_dir, "events")
    line = F.concat(_stamp(F.col("ts"), "yyyy-MM-dd HH:mm:ss"), F.lit(" "), event_line(e))
    return e.select(F.concat(F.lit("dev"), (F.col("user_id") % 8).cast("string"), F.lit(".log")).alias("file"), F.col("event_id").alias("line_no"), line.alias("line"))


def dialect_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw log lines in all time-stamp dialects, with continuation and blank lines between."""
    e = table(spark, sf_dir, "events")
    ts, k = F.col("ts"), F.col("event_id") % 9
    line = (
        F.when(k == 0, F.concat(_stamp(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" iso "), F.col("event_type")))
        .when(k == 1, F.concat(_stamp(ts, "yyyy-MM-dd-HH-mm-ss"), F.lit(": dashes "), F.col("event_type")))
        .when(k == 2, F.concat(_stamp(ts, "yyMMdd-HH:mm:ss"), F.lit(".123 compact "), F.col("event_type")))
        .when(k == 3, F.concat(_stamp(ts, "MMM d HH:mm:ss"), F.lit(" syslog "), F.col("event_type")))
        .when(k == 4, F.concat(_stamp(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" space "), F.col("event_type")))
        .when(k == 5, F.concat((F.col("event_id") % 5000).cast("string"), F.lit(".250000: uptime "), F.col("event_type")))
        .when(k == 6, F.concat(F.lit("  continued "), F.col("event_type"), F.lit("  ")))
        .when(k == 7, F.lit("2024-13-01 10:00:05 bad month"))
        .otherwise(F.lit("  "))
    )
    return e.select(F.concat(F.lit("dev"), (F.col("user_id") % 8).cast("string"), F.lit(".log")).alias("file"), F.col("event_id").alias("line_no"), line.alias("line"))


def parsed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as parsed lines."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("dev"), (F.col("user_id") % 8).cast("string"), F.lit(".log")).alias("file"), F.col("event_id").alias("line_no"), F.col("ts").alias("timestamp"), event_line(e).alias("loglines"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as log lines: a file a source, lines in order of document and position."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    lines = d.select(F.concat("source", F.lit(".log")).alias("file"), "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("file", (F.col("doc_id") * 1_000_000 + F.col("pos") + 1).alias("line_no"), "line")


def order_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as log lines with a level by their status."""
    o = table(spark, sf_dir, "orders")
    level = F.when(F.col("o_orderstatus") == "F", "ERROR").when(F.col("o_orderstatus") == "P", "warning").otherwise("info")
    line = F.concat(F.lit("08:15:30 "), level, F.lit(": order of 10.0."), (F.col("o_custkey") % 200).cast("string"), F.lit(".7"))
    return o.select(F.lit("orders.log").alias("file"), (F.col("o_orderkey") + 1).alias("line_no"), line.alias("line"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the long telemetry table: a device a user, a key an event type."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("device"), F.col("event_id").cast("int").alias("report_id"), F.col("ts").alias("time"), F.concat(F.lit("Report."), F.col("event_type")).alias("key"), F.round("value", 2).cast("string").alias("value"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files of the projects of customers."""
    o = table(spark, sf_dir, "orders")
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".log", ".txt", ".ZIP", ".zip", ".xls")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    name = F.element_at(F.array(*[F.lit(x) for x in ("WiFi", "SelfHeal", "Telemetry2_0", "snapshot", "mesh", "wan", "core")]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("project_id"), F.concat(F.col("o_orderkey").cast("string"), suffix).alias("file"),
        F.concat(name, suffix).alias("original_name"), (F.floor("o_totalprice") * (F.col("o_orderkey") % 11)).cast("bigint").alias("file_size"),
    )


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as projects of the users of their nation."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_nationkey").alias("user_id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("last_accessed"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as users; those of even number are administrators."""
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("username"), (F.col("n_nationkey") % 2 == 0).alias("is_admin"), F.col("n_nationkey").alias("created_at"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status for two of three files."""
    f = files(spark, sf_dir).where("id % 3 <> 0")
    state = F.element_at(F.array(*[F.lit(x) for x in ("queued", "parsed", "indexed", "error")]), (F.col("id") % 4 + 1).cast("int"))
    return f.select("file", state.alias("state"))


#: A rule catalogue for the documents' sources.
CATALOGUE = """{
 "Legal": [
  {"Title": "License notice", "Cause": "copied text", "CPELogs": [
    {"FileName": " SRC0 ", "Regex": [{"type": "STD", "pattern": "[Ll]icensed under", "description": "license line"},
                                      {"type": "STD", "pattern": "MIT License", "description": "MIT"}]},
    {"FileName": "src1", "Regex": [{"type": "STD", "pattern": "[Ll]icensed under", "description": "license line"}]}]}],
 "Noise": [
  {"Title": "Shouting", "CPELogs": [
    {"FileName": "src0", "Regex": [{"type": "CTR", "pattern": "[A-Z][A-Z][A-Z]+!!", "description": "capitals"}]},
    {"FileName": "src2", "Regex": [{"type": "CTR", "pattern": "[A-Z][A-Z][A-Z]+!!", "description": "capitals"},
                                    {"type": "CTR", "pattern": "[|] [a-z]+ [|]", "description": "table row"}]}]}],
 "Empty": []
}"""


def rules(spark: SparkSession) -> DataFrame:
    from ..sources.rules import flatten_rules

    return flatten_rules(spark.createDataFrame([(CATALOGUE,)], "text string"))
