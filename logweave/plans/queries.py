"""The log operators bound to the driver's tables, one query each; ``oracles`` holds their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timestamps
from ..functions.entities import entity_spans as spans_of
from ..functions.telemetry import flatten_json as flatten, kv_split as split_packed, parse_size as size_of
from ..functions.text import MASKS, file_stem, line_page, mask_values as mask, normalise_member_name as member_name, render_line, similarity_band, size_mb, tokenise
from ..operators import catalog, ingest, search, template_catalogue, templates, text_search as by_text, vector_index, vectors
from ..operators import rules as rule_ops
from ..operators import telemetry as tel
from ..sources import catalog as catalog_source, logs, sinks
from ..sources.logs import reports_of
from ..sources.rules import FLAT, read_rules, validate_rules as validate
from ..sources.sinks import export_rules as rules_sink
from ..session import configure, new_table_path
from ..streaming import streams
from . import inputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(configure(spark), sf_dir)

    QUERIES[f.__name__] = run
    return run


def _masked(spark, sf_dir) -> DataFrame:
    return templates.mask_templates(inputs.parsed_events(spark, sf_dir))


def _text(spark, sf_dir, name: str) -> DataFrame:
    """Documents, or turns of conversations, as numbered lines."""
    if name == "documents":
        return inputs.document_lines(spark, sf_dir)
    c = inputs.table(spark, sf_dir, "conversations")
    return c.select(F.col("role").alias("file"), (F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"), F.col("text").alias("line"))


@query
def top_templates(spark, sf_dir):
    """The flagship: raw lines, parsed, masked, counted."""
    parsed = templates.mask_templates(ingest.parse_logs(inputs.event_logs(spark, sf_dir)))
    return templates.template_rank(templates.template_counts(parsed)).select("template", "count", F.round("ratio", 6).alias("ratio"), "order")


@query
def template_counts(spark, sf_dir):
    return templates.template_counts(_masked(spark, sf_dir))


@query
def template_summary(spark, sf_dir):
    return templates.template_summary(_masked(spark, sf_dir))


@query
def mask_values(spark, sf_dir):
    return inputs.document_lines(spark, sf_dir).select("file", "line_no", mask(F.col("line"), MASKS[:15]).alias("masked"))


@query
def mask_all_values(spark, sf_dir):
    """``mask_values`` with every mask; DuckDB's word boundaries differ, so it has no SQL."""
    return inputs.document_lines(spark, sf_dir).select("file", "line_no", mask(F.col("line")).alias("masked"))


@query
def tokenise_lines(spark, sf_dir):
    e = inputs.parsed_events(spark, sf_dir)
    return e.select("line_no", F.array_join(tokenise(F.col("loglines")), "|").alias("words"), F.size(tokenise(F.col("loglines"))).alias("n_words"))


def _histogram(freq: str) -> Query:
    def run(spark, sf_dir):
        return templates.template_histogram(inputs.parsed_events(spark, sf_dir), freq)

    run.__name__ = f"template_histogram_{freq}"
    return run


for _freq in ("1s", "1min", "1h", "1d"):
    query(_histogram(_freq))


@query
def histogram_downsample(spark, sf_dir):
    return templates.stride_downsample(templates.template_histogram(inputs.parsed_events(spark, sf_dir), "1min"))


@query
def parameter_profile(spark, sf_dir):
    e = inputs.table(spark, sf_dir, "events")
    parsed = e.select(F.col("event_type").alias("template"), F.array((F.col("user_id") % 20).cast("string"), F.when(F.col("event_id") % 3 == 0, "").otherwise((F.col("event_id") % 7).cast("string"))).alias("parameter_list"))
    return templates.parameter_profile(parsed)


@query
def unique_patterns(spark, sf_dir):
    marked = _masked(spark, sf_dir).withColumn("template", F.concat(F.lit("\x1b[31m"), F.col("template"), F.lit("\x07\x1b[0m")))
    return templates.unique_patterns(marked)


@query
def lines_for_template(spark, sf_dir):
    return templates.lines_for_template(_masked(spark, sf_dir), "[click] user=<NUM> props {\"k\": <NUM>}").select("file", "line_no", "loglines")


@query
def mine_templates(spark, sf_dir):
    mined = templates.mine_templates(inputs.parsed_events(spark, sf_dir))
    return mined.select("file", "line_no", "template", "parameter_list")


@query
def mine_document_templates(spark, sf_dir):
    lines = inputs.document_lines(spark, sf_dir).withColumnRenamed("line", "loglines")
    return templates.mine_templates(lines).select("file", "line_no", "template")


@query
def mine_in_two_runs(spark, sf_dir):
    """Half the files, then the others, mined into one catalogue."""
    lines = inputs.parsed_events(spark, sf_dir)
    held = template_catalogue.TemplateCatalogue(spark, new_table_path(spark, "catalogue"))
    first = template_catalogue.mine_into(held, lines.where("file < 'dev4.log'"))
    second = template_catalogue.mine_into(held, lines.where("file >= 'dev4.log'"))
    return first.unionByName(second).select("file", "line_no", "cluster_id", "template")


@query
def template_sketches(spark, sf_dir):
    """Distinct templates of each day by sketches of each file and day."""
    return templates.roll_up_sketches(templates.template_sketches(_masked(spark, sf_dir)), ["day"])


@query
def to_utc_naive(spark, sf_dir):
    e = inputs.table(spark, sf_dir, "events")
    zone = F.element_at(F.array(*[F.lit(z) for z in ("", "Z", "+02:00", "-09:30", " nonsense")]), (F.col("event_id") % 5 + 1).cast("int"))
    text = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), zone)
    return e.select("event_id", text.alias("text"), timestamps.to_utc_naive(text).alias("utc"))


@query
def parse_timestamp(spark, sf_dir):
    rows = ingest.parse_lines(inputs.dialect_logs(spark, sf_dir), syslog_year=2024)
    return rows.where("raw is null or not raw rlike '^[0-9]+[.][0-9]+$'").select("file", "line_no", "raw", "timestamp", "loglines")


@query
def rebase_uptime(spark, sf_dir):
    rows = ingest.parse_lines(inputs.dialect_logs(spark, sf_dir), syslog_year=2024)
    return rows.where("raw rlike '^[0-9]+[.][0-9]+$'").select("file", "line_no", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("micros"))


@query
def forward_fill_ts(spark, sf_dir):
    e = inputs.table(spark, sf_dir, "events")
    rows = e.select((F.col("user_id") % 8).alias("file"), F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 4 == 1, F.col("ts")).alias("timestamp"))
    return ingest.forward_fill(rows, "timestamp", block=1000)


@query
def parse_logs(spark, sf_dir):
    rows = ingest.parse_logs(inputs.dialect_logs(spark, sf_dir), syslog_year=2024)
    return rows.select("file", "line_no", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("micros"), "loglines")


@query
def parse_coverage(spark, sf_dir):
    return ingest.parse_coverage(inputs.dialect_logs(spark, sf_dir), syslog_year=2024)


@query
def drop_blank_lines(spark, sf_dir):
    lines = inputs.document_lines(spark, sf_dir)
    marked = F.when(F.col("line_no") % 7 == 0, "\\n").when(F.col("line_no") % 5 == 0, "   ").otherwise(F.concat(F.lit("  "), F.col("line"), F.lit(" ")))
    return ingest.drop_blank_lines(lines.select("file", "line_no", marked.alias("loglines")))


@query
def sort_parsed(spark, sf_dir):
    rows = inputs.parsed_events(spark, sf_dir).withColumn("timestamp", F.when(F.col("line_no") % 10 != 0, F.col("timestamp")))
    return ingest.sort_parsed(rows).select("file", "line_no", "timestamp")


@query
def search_lines(spark, sf_dir):
    return search.search_lines(_text(spark, sf_dir, "documents"), "licensed?\\s+under").select("file", "line_no", "page", "line")


@query
def search_stored_pages(spark, sf_dir):
    """``search_lines`` twice over lines stored once, by the signatures of their pages."""
    path = search.build_search_pages(_text(spark, sf_dir, "documents"))
    found = [search.search_pages(spark, path, p).withColumn("pattern", F.lit(p)) for p in ("licensed?\\s+under", "mit license|apache")]
    return found[0].unionByName(found[1])


def _quick(name: str) -> Query:
    def run(spark, sf_dir):
        both = _text(spark, sf_dir, "documents").unionByName(_text(spark, sf_dir, "conversations")).unionByName(inputs.order_logs(spark, sf_dir))
        return search.quick_search(both, name)

    run.__name__ = f"quick_{name}"
    return run


for _name in search.QUICK:
    query(_quick(_name))


@query
def search_count(spark, sf_dir):
    return search.search_lines(_text(spark, sf_dir, "documents"), "the").agg(F.count("*").alias("matches"))


@query
def page_of_lines(spark, sf_dir):
    return search.page(inputs.event_logs(spark, sf_dir), "dev1.log", 2)


@query
def page_stats(spark, sf_dir):
    return search.page_stats(_text(spark, sf_dir, "documents"))


@query
def context_window(spark, sf_dir):
    parsed = _masked(spark, sf_dir)
    anchors = parsed.where("line_no % 100 = 0").select(F.col("line_no").alias("anchor_id"), "file", F.col("timestamp").alias("anchor_ts"), "template")
    return search.context_window(parsed, anchors, 300).select("anchor_id", "file", "line_no", "is_selected")


@query
def entity_counts(spark, sf_dir):
    both = _text(spark, sf_dir, "documents").unionByName(inputs.event_logs(spark, sf_dir))
    return search.entity_counts(both, ["mac", "module", "error", "warning", "info", "debug"])


@query
def entity_counts_all(spark, sf_dir):
    """``entity_counts`` of every kind; DuckDB has no lookaround, so it has no SQL."""
    both = _text(spark, sf_dir, "documents").unionByName(inputs.event_logs(spark, sf_dir))
    return search.entity_counts(both)


@query
def entity_spans(spark, sf_dir):
    lines = _text(spark, sf_dir, "documents")
    return lines.select("file", "line_no", F.explode(spans_of("line")).alias("e")).select("file", "line_no", "e.start", "e.end", "e.text", "e.kind")


@query
def rule_hits(spark, sf_dir):
    hits = rule_ops.apply_rules(_text(spark, sf_dir, "documents"), inputs.rules(spark))
    return hits.withColumn("SampleLogs", F.array_join("SampleLogs", "\n"))


def _hits(spark, sf_dir) -> DataFrame:
    return rule_ops.apply_rules(_text(spark, sf_dir, "documents"), inputs.rules(spark))


@query
def rule_hits_many(spark, sf_dir):
    """A rule for each two-digit end of a user's number and event type, far more than one projection holds."""
    named = [(f"u{u}", t, "", "dev.log", "dev", "STD", rf"^\[{t}\] user=\d*{u:02d} ", "") for u in range(100) for t in ("click", "purchase", "view")]
    lines = inputs.parsed_events(spark, sf_dir).select(F.lit("dev.log").alias("file"), "line_no", F.col("loglines").alias("line"))
    return rule_ops.apply_rules(lines, spark.createDataFrame(named, FLAT)).select("Category", "Title", "Frequency", F.array_join("SampleLogs", "\n").alias("samples"))


@query
def rule_summary(spark, sf_dir):
    return rule_ops.rule_summary(_hits(spark, sf_dir))


@query
def rule_bars(spark, sf_dir):
    return rule_ops.rule_bars(_hits(spark, sf_dir))


@query
def rule_report(spark, sf_dir):
    return rule_ops.rule_report(_hits(spark, sf_dir)).drop("Samples")


@query
def merge_rotated(spark, sf_dir):
    lines = inputs.table(spark, sf_dir, "events")
    k = F.col("event_id") % 4
    member = F.when(k == 0, "WiFilog.txt").when(k == 1, "WiFilog.txt.1").when(k == 2, "2024-03-01-10-00-0_Core.txt").otherwise("mesh.txt")
    members = lines.select((F.concat(F.lit("a"), (F.col("event_id") % 3).cast("string"))).alias("archive"), member.alias("member"), F.col("event_id").alias("line_no"), F.concat_ws(" ", "event_type", F.col("user_id").cast("string"), F.col("event_id").cast("string")).alias("line"))
    return ingest.merge_rotated(members)


@query
def normalise_member_name(spark, sf_dir):
    o = inputs.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 5
    name = F.when(k == 0, F.concat(F.lit("dev_2024-03-01-10-0"), F.lit("1_log"), F.col("o_orderkey").cast("string"))).when(k == 1, F.concat(F.lit("abcdefgh2023ijklmno"), F.lit("_x"), F.col("o_orderkey").cast("string"))).when(k == 2, F.concat(F.lit("abcdefgh2024ijklmnop024-0123456789abc_"), F.col("o_orderkey").cast("string"))).otherwise("plain.txt")
    return o.select("o_orderkey", name.alias("name"), member_name(name).alias("normalised"))


@query
def kv_split(spark, sf_dir):
    e = inputs.table(spark, sf_dir, "events")
    packed = F.concat(F.lit("NAME="), F.col("event_type"), F.lit(" | RSS="), F.col("user_id").cast("string"), F.lit("; ;NAME=x|RSS="), F.col("event_id").cast("string"), F.lit(";"))
    rows = e.select("event_id", F.explode(split_packed(packed)).alias("m"))
    return rows.select("event_id", F.col("m")["NAME"].alias("name"), F.col("m")["RSS"].alias("rss"))


@query
def process_memory(spark, sf_dir):
    e = inputs.table(spark, sf_dir, "events")
    packed = F.concat(F.lit("NAME="), F.col("event_type"), F.lit("|RSS="), F.col("user_id").cast("string"))
    t = e.select(F.col("user_id").cast("string").alias("device"), F.col("event_id").alias("report_id"), F.col("ts").alias("time"), F.lit("Report.x.ccsp_memory_usage_split").alias("key"), packed.alias("value"))
    rows = tel.process_memory(t)
    return rows.groupBy("device", "NAME").agg(F.count("*").alias("n"), F.max(F.col("fields")["RSS"]).alias("rss"))


@query
def parse_size(spark, sf_dir):
    o = inputs.table(spark, sf_dir, "orders")
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("", "kB", "m", " KB", "x")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    text = F.concat((F.col("o_orderkey") % 100).cast("string"), suffix)
    return o.select("o_orderkey", text.alias("text"), size_of(text).alias("kb"))


@query
def latest_value(spark, sf_dir):
    return tel.latest_value(inputs.telemetry(spark, sf_dir), [".click", ".purchase", ".view"])


@query
def metric_by_suffix(spark, sf_dir):
    return tel.metric(inputs.telemetry(spark, sf_dir), "e").select("device", "report_id", "key", "value")


@query
def telemetry_wide(spark, sf_dir):
    t = inputs.telemetry(spark, sf_dir)
    return tel.telemetry_wide(t, [".click", ".purchase"]).select("device", "report_id", F.col("`.click`").alias("click"), F.col("`.purchase`").alias("purchase"))


@query
def telemetry_wide_all(spark, sf_dir):
    """``telemetry_wide`` of every report."""
    t = inputs.telemetry(spark, sf_dir)
    return tel.telemetry_wide(t, [".click", ".purchase"]).select("device", "report_id", F.col("`.click`").alias("click"), F.col("`.purchase`").alias("purchase"))


@query
def device_status(spark, sf_dir):
    names = {"click": "x.wan_access_mode_split", "purchase": "x.airties_edge_enable", "view": "x.wifi_radio_1_enable"}
    t = inputs.telemetry(spark, sf_dir)
    key = F.lit("Report.other")
    for k, v in names.items():
        key = F.when(F.col("key") == f"Report.{k}", F.lit(f"Report.{v}")).otherwise(key)
    return tel.device_status(t.withColumn("key", key)).select("device", F.col("WAN_MODE").alias("wan_mode"), F.col("MESH_EDGE").alias("mesh_edge"), F.col("RADIO1_ENABLE").alias("radio1"))


@query
def metric_series(spark, sf_dir):
    t = inputs.telemetry(spark, sf_dir)
    key = F.when(F.col("key") == "Report.click", "Report.x.wan_bytesReceived").when(F.col("key") == "Report.view", "Report.x.wan_bytesSent").otherwise("Report.other")
    rows = tel.metric_series(t.withColumn("key", key), "wan_bytes")
    return rows.select("device", "time", F.col("WAN_BYTES_RECEIVED").alias("received"), F.col("WAN_BYTES_SENT").alias("sent"))


@query
def flatten_json(spark, sf_dir):
    e = inputs.table(spark, sf_dir, "events")
    return e.select("event_id", F.explode(flatten("props")).alias("key", "value"))


@query
def json_skip_bad(spark, sf_dir):
    e = inputs.table(spark, sf_dir, "events")
    broken = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props"))
    reports = reports_of(e.select(F.col("event_id").cast("string").alias("file"), broken.alias("text")))
    return reports.select("file", "report_id")


@query
def telemetry_table(spark, sf_dir):
    e = inputs.table(spark, sf_dir, "events")
    body = F.concat(F.lit('{"Report":[{"Time":"'), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"), F.lit('"},{"x.user":"'), F.col("user_id").cast("string"), F.lit('","empty":""},{"x.user":"u'), F.col("user_id").cast("string"), F.lit('"}]}'))
    reports = e.select(F.col("user_id").cast("string").alias("file"), F.col("event_id").alias("report_id"), body.alias("json"))
    return tel.telemetry_table(reports).select("device", "report_id", "time", "key", "value")


@query
def carve_json(spark, sf_dir):
    e = inputs.table(spark, sf_dir, "events")
    prefix = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" host T2.INFO [tid=9] "))
    parts = F.array(F.lit("noise } before"), F.concat(prefix, F.lit('cJSON Report : {"Report":[{"id":"'), F.col("event_id").cast("string"), F.lit('"},')), F.concat(prefix, F.lit('{"x.y":"'), F.col("event_type"), F.lit('"}]} %')))
    lines = e.select(F.col("user_id").cast("string").alias("file"), F.col("event_id"), F.posexplode(parts).alias("pos", "line"))
    return tel.carve_json(lines.select("file", (F.col("event_id") * 10 + F.col("pos")).alias("line_no"), "line"))


@query
def vector_topk(spark, sf_dir):
    v = inputs.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = v.where("vec_id = 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vectors.vector_topk(v, q, 10).select("query_id", "vec_id", "similarity", "rank")


@query
def vector_topk_batch(spark, sf_dir):
    v = inputs.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vectors.vector_topk(v, q, 5).select("query_id", "vec_id", "similarity", "rank")


@query
def approx_topk(spark, sf_dir):
    v = inputs.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vector_index.approx_topk(v, q, 5).select("query_id", "vec_id", "similarity", "rank")


def _turns(spark, sf_dir) -> DataFrame:
    """Turns of conversations as parsed lines, each its own template."""
    c = inputs.table(spark, sf_dir, "conversations")
    return c.select(F.col("role").alias("file"), (F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"), F.col("text").alias("loglines"), F.col("text").alias("template"))


def _text_hits(spark, sf_dir) -> DataFrame:
    """Turns of every hundredth conversation as queries on all turns."""
    index = by_text.build_text_index(templates.template_counts(_turns(spark, sf_dir)))
    asked = inputs.table(spark, sf_dir, "conversations").where("conv_id % 100 = 0")
    return by_text.search_text(index, asked.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text"), 10)


@query
def text_search(spark, sf_dir):
    return _text_hits(spark, sf_dir)


@query
def text_search_lines(spark, sf_dir):
    """The lines behind the hits of ``text_search``."""
    return by_text.search_text_lines(_text_hits(spark, sf_dir), _turns(spark, sf_dir)).select("file", "line_no")


@query
def embed_templates(spark, sf_dir):
    return vectors.embed_templates(templates.template_counts(_masked(spark, sf_dir)))


@query
def drilldown_hits(spark, sf_dir):
    parsed = _masked(spark, sf_dir)
    hits = templates.template_counts(parsed)
    return vectors.drilldown_hits(hits, parsed).select("file", "template", "line_no")


@query
def drilldown_all(spark, sf_dir):
    """``drilldown_hits`` of every template."""
    parsed = _masked(spark, sf_dir)
    return vectors.drilldown_hits(templates.template_counts(parsed), parsed).select("file", "template", "line_no")


@query
def prompt_rows(spark, sf_dir):
    counts = templates.template_counts(_masked(spark, sf_dir)).withColumnRenamed("count", "frequency")
    return vectors.prompt_rows(counts)


@query
def eligible_files(spark, sf_dir):
    return catalog.eligible_files(inputs.files(spark, sf_dir)).select("id", "file", "original_name", "file_size")


@query
def viewable_files(spark, sf_dir):
    return catalog.viewable_files(inputs.files(spark, sf_dir)).select("id", "size_mb", "is_viewable")


@query
def unprocessed_files(spark, sf_dir):
    return catalog.unprocessed_files(inputs.files(spark, sf_dir), inputs.manifest(spark, sf_dir)).select("id", "file")


@query
def route_by_name(spark, sf_dir):
    index = spark.createDataFrame([(0, "wifi", "radio"), (1, "heal", "self"), (2, "e", "other")], "position int, supported string, config string")
    f = inputs.files(spark, sf_dir).select(F.col("original_name").alias("file"))
    return catalog.route_by_name(f, index).groupBy("file", "config").agg(F.count("*").alias("n"))


@query
def project_rollup(spark, sf_dir):
    return catalog.project_rollup(inputs.projects(spark, sf_dir), inputs.files(spark, sf_dir)).select("id", "name", "file_count", "total_size")


@query
def user_rollup(spark, sf_dir):
    return catalog.user_rollup(inputs.users(spark, sf_dir), inputs.projects(spark, sf_dir), inputs.files(spark, sf_dir)).select("id", "username", "project_count", "file_count")


@query
def system_stats(spark, sf_dir):
    return catalog.system_stats(catalog.user_rollup(inputs.users(spark, sf_dir), inputs.projects(spark, sf_dir), inputs.files(spark, sf_dir)))


@query
def pipeline_status(spark, sf_dir):
    return catalog.pipeline_status(inputs.manifest(spark, sf_dir))


@query
def file_sizes(spark, sf_dir):
    return inputs.files(spark, sf_dir).groupBy("project_id").agg(size_mb(F.sum("file_size")).alias("mb"))


@query
def render_lines(spark, sf_dir):
    e = inputs.parsed_events(spark, sf_dir)
    return e.select("line_no", render_line(F.col("timestamp"), F.col("loglines")).alias("shown"), line_page(F.col("line_no") + 1).alias("page"))


@query
def similarity_bands(spark, sf_dir):
    v = inputs.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vectors.vector_topk(v, q, 20).groupBy("query_id", similarity_band(F.col("similarity")).alias("band")).agg(F.count("*").alias("n"))


@query
def file_stems(spark, sf_dir):
    f = inputs.files(spark, sf_dir)
    return f.groupBy(file_stem(F.col("original_name")).alias("stem")).agg(F.count("*").alias("n"))


def _file_status(spark, sf_dir) -> DataFrame:
    return catalog.status_by_name(inputs.manifest(spark, sf_dir))


@query
def status_by_name(spark, sf_dir):
    return _file_status(spark, sf_dir)


@query
def read_log_lines(spark, sf_dir):
    """Event logs written as text files and read back; ``numbered``: whether the numbers of a line's file run from 1 on."""
    path = new_table_path(spark, "log-files")
    inputs.event_logs(spark, sf_dir).select(F.col("line").alias("value")).write.text(path)
    lines = logs.read_log_lines(spark, path)
    files = lines.groupBy("file").agg(((F.min("line_no") == 1) & (F.max("line_no") == F.count("*")) & (F.count_distinct("line_no") == F.count("*"))).alias("numbered"))
    return lines.join(files, "file").select("line", "numbered")


@query
def write_and_read_parsed(spark, sf_dir):
    path = new_table_path(spark, "parsed")
    sinks.write_parsed(_masked(spark, sf_dir).withColumn("parameter_list", F.array(F.lit("x"))), path)
    return logs.read_parsed_logs(spark, path).select("file", "line_no", "timestamp", "loglines", "template")


@query
def write_and_read_rule_hits(spark, sf_dir):
    """Hits written twice: a later run replaces those of an earlier one."""
    path = new_table_path(spark, "hits")
    for _ in range(2):
        sinks.write_rule_hits(_hits(spark, sf_dir), path)
    return spark.read.parquet(path).select("Category", "Title", "Description", "Frequency", "FileName", F.size("SampleLogs").alias("samples"))


@query
def write_and_read_vectors(spark, sf_dir):
    """Vectors of half the files, then of all: each is stored once."""
    path = new_table_path(spark, "vectors")
    found = vectors.embed_templates(templates.template_counts(_masked(spark, sf_dir)))
    sinks.write_vectors(found.where("file < 'dev4.log'"), path)
    sinks.write_vectors(found, path)
    return spark.read.parquet(path).select("file", "template", "frequency", F.size("embedding").alias("dimensions"))


@query
def export_and_read_patterns(spark, sf_dir):
    path = new_table_path(spark, "patterns")
    sinks.export_unique_patterns(templates.unique_patterns(_masked(spark, sf_dir)), path)
    return spark.read.option("header", True).schema("filename string, count bigint, template string").csv(path)


@query
def export_and_read_telemetry(spark, sf_dir):
    path = new_table_path(spark, "telemetry")
    sinks.export_telemetry(inputs.telemetry(spark, sf_dir).select("device", "report_id", "time", "key", "value"), path)
    return spark.read.option("header", True).schema("device string, report_id int, time timestamp_ntz, key string, value string").csv(path).select("device", "report_id", "key", "value")


@query
def write_and_read_reports(spark, sf_dir):
    """Carved reports written by device and read back."""
    path = new_table_path(spark, "reports")
    sinks.write_json_reports(QUERIES["carve_json"](spark, sf_dir), path)
    return sinks.read_json_reports(spark, path)


@query
def export_and_read_rules(spark, sf_dir):
    """A rule for each part type of the tables, exported as a catalogue and read back."""
    path = new_table_path(spark, "rules")
    rules_sink(_part_rules(spark, sf_dir), path)
    return read_rules(spark, path).select("category", "title", "file_key", "pattern", "description")


def _part_rules(spark, sf_dir) -> DataFrame:
    p = inputs.table(spark, sf_dir, "supplier")
    nation = (F.col("s_nationkey") % 5).cast("string")
    pattern = F.when(F.col("s_suppkey") % 7 == 0, "(").otherwise(F.concat(F.lit("code="), F.col("s_suppkey").cast("string")))
    return p.select(F.concat(F.lit("c"), nation).alias("category"), F.concat(F.lit("t"), F.col("s_nationkey").cast("string")).alias("title"), F.lit("").alias("cause"), F.lit(" Dev.LOG ").alias("file_name"), F.lit("dev.log").alias("file_key"), F.lit("STD").alias("type"), pattern.alias("pattern"), F.col("s_name").alias("description"))


@query
def rule_catalog_summary(spark, sf_dir):
    return rule_ops.rule_catalog_summary(_part_rules(spark, sf_dir))


@query
def validate_rules(spark, sf_dir):
    return validate(_part_rules(spark, sf_dir)).select("description", "pattern")


@query
def write_and_read_merged(spark, sf_dir):
    path = new_table_path(spark, "merged")
    sinks.write_merged_logs(QUERIES["merge_rotated"](spark, sf_dir), path)
    return spark.read.text(path).select("base", F.col("value").alias("line"))


@query
def read_catalog(spark, sf_dir):
    """Users, projects and files stored and read back: the files of each project by name."""
    path = new_table_path(spark, "catalog")
    stamp, text = F.lit(None).cast("timestamp_ntz"), F.lit("").alias("description")
    inputs.users(spark, sf_dir).select(F.col("id").cast("int").alias("id"), "username", F.lit("").alias("email"), "is_admin", stamp.alias("created_at"), stamp.alias("last_login")).write.parquet(f"{path}/users")
    inputs.projects(spark, sf_dir).select("id", F.col("user_id").cast("int").alias("user_id"), "name", text, stamp.alias("created_at"), stamp.alias("last_accessed")).write.parquet(f"{path}/projects")
    f = inputs.files(spark, sf_dir)
    f.select(F.col("id").cast("int").alias("id"), "project_id", F.col("file").alias("filename"), "original_name", F.col("file").alias("file_path"), (F.col("file_size") % 1000).cast("int").alias("file_size"), stamp.alias("uploaded_at")).write.parquet(f"{path}/files")
    users, projects, files = catalog_source.read_catalog(spark, path)
    owned = catalog_source.project_files(files).join(projects.select(F.col("id").alias("project_id"), "user_id", "name"), "project_id")
    return owned.join(users.select(F.col("id").alias("user_id"), "username"), "user_id").select("id", "original_name", "name", "username")


def _device_reports(spark, sf_dir) -> DataFrame:
    """Events as reports of their user's device: its address, two makers, the memory of two processes."""
    e = inputs.table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    pairs = {"Time": F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"), "x.mac": F.concat(F.lit("mac"), user), "a.manufacturer": F.lit("first"), "b.manufacturer": F.col("event_type"), "x.ccsp_memory_usage_split": F.concat(F.lit("NAME=p"), user, F.lit("|RSS="), F.col("event_id").cast("string"), F.lit(";NAME=all|RSS=1;"))}
    body = F.concat(F.lit('{"Report":['), F.concat_ws(",", *[F.concat(F.lit(f'{{"{k}":"'), v, F.lit('"}')) for k, v in pairs.items()]), F.lit("]}"))
    return e.select(user.alias("file"), F.col("event_id").cast("int").alias("report_id"), body.alias("json"))


@query
def device_info(spark, sf_dir):
    return tel.device_info(tel.telemetry_table(_device_reports(spark, sf_dir))).select("device", F.col("MAC").alias("mac"), F.col("MANUFACTURER").alias("maker"), F.col("VERSION").alias("version"))


@query
def process_names(spark, sf_dir):
    return tel.process_names(tel.process_memory(tel.telemetry_table(_device_reports(spark, sf_dir)))).select(F.col("NAME").alias("name"))


@query
def process_rows(spark, sf_dir):
    rows = tel.process_rows(tel.process_memory(tel.telemetry_table(_device_reports(spark, sf_dir))), "all")
    return rows.select("device", "time", F.col("fields")["RSS"].alias("rss"))


@query
def union_reports(spark, sf_dir):
    """Wide reports of two kinds of events as one table, less the columns that are empty everywhere."""
    t = inputs.telemetry(spark, sf_dir)
    one = tel.telemetry_wide(t.where("key = 'Report.click'"), [".click", ".never"])
    two = tel.telemetry_wide(t.where("key = 'Report.view'"), [".view"])
    rows = tel.drop_empty_columns(tel.union_reports(one, two))
    return rows.select(*[F.col(f"`{c}`").alias(c.strip(".")) for c in rows.columns])


@query
def inject_year(spark, sf_dir):
    """Syslog lines get the year of their file's earliest dated line."""
    rows = ingest.parse_lines(inputs.dialect_logs(spark, sf_dir))
    return rows.where("raw rlike '^[A-Z]'").select("file", "line_no", "raw", "timestamp")


def _stream(spark, sf_dir, name: str, build, mode: str) -> DataFrame:
    """Events as text files, read by ``build``'s stream until none is left; the rows it has written."""
    source, target = new_table_path(spark, f"{name}-in"), new_table_path(spark, f"{name}-out")
    e = inputs.table(spark, sf_dir, "events")
    # Local time order over the files, so that no line is late.
    lines = e.select(F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"), F.lit(" "), inputs.event_line(e)).alias("value"))
    lines.repartitionByRange(2, "value").sortWithinPartitions("value").write.text(source)
    out = build(streams.stream_log_lines(spark, source))
    writer = out.writeStream.outputMode(mode).option("checkpointLocation", f"{target}-state").trigger(availableNow=True)
    if mode == "append":
        started = writer.format("parquet").start(target)
    else:
        started = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(target)).start()
    started.awaitTermination()
    return spark.read.schema(out.schema).parquet(target)


@query
def stream_template_counts(spark, sf_dir):
    return _stream(spark, sf_dir, "counts", lambda x: streams.stream_template_counts(x, "10 minutes", "1 hour"), "append")


@query
def stream_mine_templates(spark, sf_dir):
    """The clusters that a stream has made of all lines, with their lines."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, streams.ROCKSDB)
    try:
        rows = _stream(spark, sf_dir, "mined", lambda x: streams.stream_mine_templates(x, ttl=None), "append")
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return streams.clusters_so_far(rows).select("template", "lines")


@query
def stream_rule_hits(spark, sf_dir):
    """Lines of the stream's files that a rule for each event type matches."""
    named = [("Events", t, "", "events.log", "events", "STD", rf"^\[{t}\] user=", t) for t in ("click", "purchase", "view")]
    rules = spark.createDataFrame(named, FLAT)
    rows = _stream(spark, sf_dir, "rules", lambda x: streams.stream_rule_hits(x.withColumn("file", F.lit("events.log")).withColumn("line", F.col("loglines")), rules, 1000), "complete")
    return rows.select("file", "title", "Frequency")


@query
def stream_dedupe(spark, sf_dir):
    return _stream(spark, sf_dir, "dedupe", lambda x: streams.stream_dedupe(x.withColumn("file", F.lit("one")), "1 hour"), "append").select("line")


@query
def stream_latest_status(spark, sf_dir):
    def build(lines):
        part = lambda p: F.regexp_extract("loglines", p, 1)
        return streams.stream_latest_status(lines.select(part(r"user=(\d+)").alias("device"), part(r"^\[(\w+)\]").alias("key"), F.col("ts").alias("time"), F.col("loglines").alias("value")))

    return _stream(spark, sf_dir, "latest", build, "complete").select("device", "key", F.col("time").cast("timestamp_ntz").alias("time"))
