"""DuckDB SQL of the queries in ``queries``, written apart from them."""

from __future__ import annotations

from ..functions.text import MASKS
from ..functions.timestamps import PREFIXES


def _masked(column: str, masks=MASKS) -> str:
    for pattern, name in masks:
        column = f"regexp_replace({column}, '{pattern}', '<{name}>', 'g')"
    return column


_LINE = "'[' || event_type || '] user=' || user_id || ' props ' || props"
_FILE = "'dev' || (user_id % 8) || '.log'"
_PARSED = f"SELECT {_FILE} AS file, event_id AS line_no, ts AS timestamp, {_LINE} AS loglines FROM events"
_TEMPLATES = f"SELECT *, {_masked('loglines')} AS template FROM ({_PARSED})"
_WORDS = "trim(regexp_replace(trim(template), '[-=,: ]+', ' ', 'g'))"
_DOCS = (
    "SELECT source || '.log' AS file, doc_id * 1000000 + pos AS line_no, line FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, "
    "unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents WHERE text IS NOT NULL)"
)
_TURNS = "SELECT role AS file, conv_id * 1000 + turn AS line_no, text AS line FROM conversations"
_ORDERS = "SELECT 'orders.log' AS file, o_orderkey + 1 AS line_no, '08:15:30 ' || CASE o_orderstatus WHEN 'F' THEN 'ERROR' WHEN 'P' THEN 'warning' ELSE 'info' END || ': order of 10.0.' || (o_custkey % 200) || '.7' AS line FROM orders"
_PREFIX = f"^({'|'.join(PREFIXES)})[:\\s]+(.*)$"
_DIALECTS = f"""SELECT {_FILE} AS file, event_id AS line_no, CASE event_id % 9
 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' iso ' || event_type
 WHEN 1 THEN strftime(ts, '%Y-%m-%d-%H-%M-%S') || ': dashes ' || event_type
 WHEN 2 THEN strftime(ts, '%y%m%d-%H:%M:%S') || '.123 compact ' || event_type
 WHEN 3 THEN strftime(ts, '%b %-d %H:%M:%S') || ' syslog ' || event_type
 WHEN 4 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || ' space ' || event_type
 WHEN 5 THEN (event_id % 5000) || '.250000: uptime ' || event_type
 WHEN 6 THEN '  continued ' || event_type || '  '
 WHEN 7 THEN '2024-13-01 10:00:05 bad month' ELSE '  ' END AS line, event_id, event_type, ts FROM events"""
_OWN = f"""SELECT file, line_no, CASE WHEN event_id % 9 <= 5 OR event_id % 9 = 7 THEN regexp_extract(line, '{_PREFIX}', 1) END AS raw,
 CASE WHEN event_id % 9 <= 4 THEN date_trunc('second', ts) END AS timestamp,
 CASE WHEN event_id % 9 <= 5 OR event_id % 9 = 7 THEN regexp_extract(line, '{_PREFIX}', 2) ELSE line END AS loglines, event_id FROM ({_DIALECTS})"""
_REBASED = f"""SELECT o.file, o.line_no, raw, loglines, event_id, CASE WHEN event_id % 9 = 5 THEN base + to_microseconds((event_id % 5000) * 1000000 + 250000) ELSE timestamp END AS timestamp
 FROM ({_OWN}) o JOIN (SELECT file AS f, min(timestamp) AS base FROM ({_OWN}) GROUP BY 1) b ON o.file = b.f"""
_FILLED = f"SELECT file, line_no, raw, loglines, event_id, last_value(timestamp IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS timestamp FROM ({_REBASED})"
_HITS = " UNION ALL ".join(
    f"SELECT file, line_no, line, '{c}' AS Category, '{t}' AS Title, '{x}' AS Cause, '{d}' AS Description FROM docs WHERE file = '{f}.log' AND regexp_matches(line, '{p}')"
    for f, c, t, x, d, p in (
        ("src0", "Legal", "License notice", "copied text", "license line", "[Ll]icensed under"),
        ("src0", "Legal", "License notice", "copied text", "MIT", "MIT License"),
        ("src1", "Legal", "License notice", "copied text", "license line", "[Ll]icensed under"),
        ("src0", "Noise", "Shouting", "", "capitals", "[A-Z][A-Z][A-Z]+!!"),
        ("src2", "Noise", "Shouting", "", "capitals", "[A-Z][A-Z][A-Z]+!!"),
        ("src2", "Noise", "Shouting", "", "table row", "[|] [a-z]+ [|]"),
    )
)
_RULES = f"""SELECT Category, Title, Cause, Description, count(*)::INT AS Frequency, string_agg(line, chr(10) ORDER BY line_no) FILTER (rn <= 5) AS SampleLogs, file AS FileName FROM (
 SELECT *, row_number() OVER (PARTITION BY file, Category, Title, Description ORDER BY line_no) AS rn FROM ({_HITS})) WHERE rn <= 100 GROUP BY ALL"""
_WITH_DOCS = f"WITH docs AS ({_DOCS}) "
_FILES = """SELECT o_orderkey AS id, o_custkey::VARCHAR AS project_id, o_orderkey || s AS file, n || s AS original_name, (floor(o_totalprice) * (o_orderkey % 11))::BIGINT AS file_size FROM (
 SELECT *, ['.log', '.txt', '.ZIP', '.zip', '.xls'][o_orderkey % 5 + 1] AS s, ['WiFi', 'SelfHeal', 'Telemetry2_0', 'snapshot', 'mesh', 'wan', 'core'][o_orderkey % 7 + 1] AS n FROM orders)"""
_MANIFEST = f"SELECT file, ['queued', 'parsed', 'indexed', 'error'][id % 4 + 1] AS state FROM ({_FILES}) WHERE id % 3 <> 0"
_USERS = f"""SELECT n_nationkey AS id, n_name AS username, n_nationkey % 2 = 0 AS is_admin, coalesce(p, 0) AS project_count, coalesce(f, 0)::BIGINT AS file_count FROM nation LEFT JOIN (
 SELECT c_nationkey, count(*) AS p, coalesce(sum(k), 0) AS f FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) ON c_custkey = o_custkey GROUP BY 1) ON n_nationkey = c_nationkey"""
_PART_RULES = "SELECT 'c' || (s_nationkey % 5) AS category, 't' || s_nationkey AS title, CASE WHEN s_suppkey % 7 = 0 THEN '(' ELSE 'code=' || s_suppkey END AS pattern, s_name AS description FROM supplier"
_TELEMETRY = "SELECT user_id::VARCHAR AS device, event_id::INT AS report_id, ts AS time, 'Report.' || event_type AS key, round(value, 2)::VARCHAR AS value, event_type FROM events"


def _bins(unit: str) -> str:
    return f"""SELECT b AS timestamp, coalesce(n, 0) AS count FROM (
 SELECT unnest(generate_series(date_trunc('{unit}', min(ts)), date_trunc('{unit}', max(ts)), INTERVAL 1 {unit})) AS b FROM events) LEFT JOIN (
 SELECT date_trunc('{unit}', ts) AS t, count(*) AS n FROM events GROUP BY 1) ON b = t"""


def _search(pattern: str, source: str) -> str:
    return f"SELECT file, line_no, (line_no - 1) // 1000 + 1 AS page, line FROM ({source}) WHERE regexp_matches(line, '(?i){pattern}')"


def _entities(kinds: tuple[tuple[str, str], ...]) -> str:
    return " UNION ALL ".join(f"SELECT file, '{k}' AS kind, unnest(regexp_extract_all(line, '(?i){p}')) AS text FROM docs" for k, p in kinds)


def _topk(where: str, k: int) -> str:
    return f"""SELECT query_id, vec_id, similarity, rank FROM (SELECT q.vec_id AS query_id, v.vec_id, round(s, 4) AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, v.vec_id) AS rank FROM (
 SELECT a.vec_id, b.vec_id AS vid, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) AS s FROM embeddings a, embeddings b WHERE a.{where}) q
 JOIN embeddings v ON v.vec_id = q.vid) WHERE rank <= {k}"""


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
_TFIDF = f"""e AS (SELECT role AS file, text, count(*) AS frequency FROM conversations WHERE text IS NOT NULL GROUP BY ALL),
 d AS (SELECT DISTINCT text FROM e), idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM d)) / (1.0 + count(*))) + 1 AS idf FROM (SELECT unnest(list_distinct({_TERMS})) AS term FROM d) GROUP BY 1),
 w AS (SELECT text, term, n * idf AS w FROM (SELECT text, term, count(*) AS n FROM (SELECT text, unnest({_TERMS}) AS term FROM d) GROUP BY ALL) JOIN idf USING (term)),
 u AS (SELECT text, term, w / sqrt(sum(w * w) OVER (PARTITION BY text)) AS w FROM w),
 q AS (SELECT conv_id * 1000 + turn AS query_id, text FROM conversations WHERE conv_id % 100 = 0),
 s AS (SELECT query_id, b.text, sum(a.w * b.w) AS s FROM q JOIN u a ON a.text = q.text JOIN u b ON a.term = b.term GROUP BY ALL),
 h AS (SELECT query_id, e.file, e.text AS template, e.frequency, s, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, e.file, e.text) AS rank FROM s JOIN e ON e.text = s.text QUALIFY rank <= 10)"""


ORACLES: dict[str, str] = {
    "top_templates": f"""SELECT template, count, round(count / sum(count) OVER (), 6) AS ratio, row_number() OVER (ORDER BY count DESC, template) - 1 AS "order" FROM (SELECT template, count(*) AS count FROM ({_TEMPLATES}) GROUP BY 1)""",
    "template_counts": f"SELECT file, template, count(*) AS count FROM ({_TEMPLATES}) GROUP BY ALL",
    "template_summary": f"SELECT count(*) AS total_lines, count(DISTINCT template) AS templates FROM ({_TEMPLATES})",
    "mask_values": f"SELECT file, line_no, {_masked('line', MASKS[:15])} AS masked FROM ({_DOCS})",
    "tokenise_lines": f"""SELECT line_no, replace(trim(regexp_replace(trim(loglines), '[-=,: ]+', ' ', 'g')), ' ', '|') AS words, len(string_split(trim(regexp_replace(trim(loglines), '[-=,: ]+', ' ', 'g')), ' '))::INT AS n_words FROM ({_PARSED})""",
    "template_histogram_1s": _bins("second"),
    "template_histogram_1min": _bins("minute"),
    "template_histogram_1h": _bins("hour"),
    "template_histogram_1d": _bins("day"),
    "histogram_downsample": f"SELECT timestamp, count FROM (SELECT *, row_number() OVER (ORDER BY timestamp) - 1 AS i, count(*) OVER () AS n FROM ({_bins('minute')})) WHERE i % (CASE WHEN n > 5000 THEN n // 5000 + 1 ELSE 1 END) = 0",
    "parameter_profile": """SELECT template, position, sum(n)::BIGINT AS count, string_agg(v, ', ' ORDER BY v) AS values FROM (
 SELECT event_type AS template, position, v, count(*) AS n FROM (SELECT event_type, 'POSITION_1' AS position, (user_id % 20)::VARCHAR AS v FROM events UNION ALL
 SELECT event_type, 'POSITION_2', (event_id % 7)::VARCHAR FROM events WHERE event_id % 3 <> 0) GROUP BY ALL) GROUP BY ALL""",
    "unique_patterns": f"SELECT file AS filename, count(*) AS count, template FROM ({_TEMPLATES}) GROUP BY ALL",
    "lines_for_template": f"""SELECT file, line_no, loglines FROM ({_PARSED}) WHERE regexp_full_match(loglines, '\\[click\\] user=\\d+ props \\{{"k": \\d+\\}}')""",
    "mine_in_two_runs": f"""WITH t AS (SELECT file, line_no, {_WORDS} AS template FROM ({_TEMPLATES})), c AS (SELECT template, row_number() OVER (ORDER BY min((file, line_no))) AS cluster_id FROM t GROUP BY 1)
 SELECT file, line_no, cluster_id, template FROM t JOIN c USING (template)""",
    "template_sketches": f"SELECT timestamp::DATE AS day, count(*) AS lines, count(DISTINCT template) AS templates FROM ({_TEMPLATES}) GROUP BY 1",
    "to_utc_naive": """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || ['', 'Z', '+02:00', '-09:30', ' nonsense'][event_id % 5 + 1] AS text,
 CASE WHEN event_id % 5 < 4 THEN date_trunc('second', ts) - to_minutes([0, 0, 120, -570][event_id % 5 + 1]) END AS utc FROM events""",
    "parse_timestamp": f"SELECT file, line_no, raw, timestamp, loglines FROM ({_OWN}) WHERE event_id % 9 <> 5",
    "rebase_uptime": f"SELECT file, line_no, epoch_us(timestamp) AS micros FROM ({_REBASED}) WHERE event_id % 9 = 5",
    "forward_fill_ts": "SELECT user_id % 8 AS file, event_id AS line_no, last_value(CASE WHEN event_id % 4 = 1 THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id % 8 ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS timestamp FROM events",
    "parse_logs": f"SELECT file, line_no, epoch_us(timestamp) AS micros, trim(loglines) AS loglines FROM ({_FILLED}) WHERE trim(loglines) <> ''",
    "parse_coverage": f"""SELECT a.file, total, dated, parsed, without_time FROM (SELECT file, count(*) AS total, count(*) FILTER (event_id % 9 <= 4) AS dated, count(timestamp) AS parsed FROM ({_REBASED}) GROUP BY 1) a
 JOIN (SELECT file, count(*) FILTER (timestamp IS NULL) AS without_time FROM ({_FILLED}) GROUP BY 1) b USING (file)""",
    "drop_blank_lines": f"SELECT file, line_no, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS loglines FROM ({_DOCS}) WHERE line_no % 7 <> 0 AND line_no % 5 <> 0 AND regexp_replace(line, '^\\s+|\\s+$', '', 'g') NOT IN ('', '\\n')",
    "sort_parsed": f"SELECT file, line_no, CASE WHEN line_no % 10 <> 0 THEN timestamp END AS timestamp FROM ({_PARSED})",
    "search_lines": _search("licensed?\\s+under", _DOCS),
    "search_stored_pages": f"SELECT *, 'licensed?\\s+under' AS pattern FROM ({_search('licensed?\\s+under', _DOCS)}) UNION ALL SELECT *, 'mit license|apache' FROM ({_search('mit license|apache', _DOCS)})",
    "quick_error": _search(r"\b(ERROR|FATAL|CRITICAL|FAIL)\b", f"{_DOCS} UNION ALL {_TURNS} UNION ALL {_ORDERS}"),
    "quick_warn": _search(r"\b(WARNING|WARN|ALERT)\b", f"{_DOCS} UNION ALL {_TURNS} UNION ALL {_ORDERS}"),
    "quick_ip": _search(r"\b(?:\d{1,3}\.){3}\d{1,3}\b", f"{_DOCS} UNION ALL {_TURNS} UNION ALL {_ORDERS}"),
    "quick_time": _search(r"\b\d{2}:\d{2}:\d{2}\b", f"{_DOCS} UNION ALL {_TURNS} UNION ALL {_ORDERS}"),
    "search_count": f"SELECT count(*) AS matches FROM ({_DOCS}) WHERE regexp_matches(line, '(?i)the')",
    "page_of_lines": f"SELECT file, line_no, strftime(timestamp, '%Y-%m-%d %H:%M:%S') || ' ' || loglines AS line FROM ({_PARSED}) WHERE file = 'dev1.log' AND line_no BETWEEN 1001 AND 2000",
    "page_stats": f"SELECT file, count(*) AS total, ceil(count(*) / 1000.0)::BIGINT AS total_pages FROM ({_DOCS}) GROUP BY 1",
    "context_window": f"""WITH t AS ({_TEMPLATES}) SELECT a.line_no AS anchor_id, t.file, t.line_no, t.template = a.template AS is_selected FROM t JOIN t a ON t.file = a.file AND a.line_no % 100 = 0
 AND t.timestamp BETWEEN a.timestamp - INTERVAL 300 SECOND AND a.timestamp + INTERVAL 300 SECOND""",
    "entity_counts": f"WITH docs AS ({_DOCS} UNION ALL SELECT file, line_no, strftime(timestamp, '%Y-%m-%d %H:%M:%S') || ' ' || loglines FROM ({_PARSED})) "
    + "SELECT file, kind, text, count(*) AS count FROM ("
    + _entities(
        (
            ("mac", r"\b([0-9A-F]{2}[:-]){5}[0-9A-F]{2}\b"),
            ("module", r"\[([A-Z0-9_-]*[A-Z][A-Z0-9_-]*)\]"),
            ("error", r"\b(ERR|ERROR|FATAL|CRITICAL|FAIL|FAILED|EXCEPTION|CRASH|ABORT|PANIC)\b"),
            ("warning", r"\b(WARN|WARNING|DEPRECATED|CAUTION|ALERT|DISCONNECTED)\b"),
            ("info", r"\b(INFO|INFORMATION|NOTICE|SUCCESS|OK|PASS|PASSED|COMPLETE|COMPLETED|CONNECTED)\b"),
            ("debug", r"\b(OFF|DEBUG|TRACE|VERBOSE|DETAIL)\b"),
        )
    )
    + ") GROUP BY ALL",
    "rule_hits": _WITH_DOCS + _RULES,
    "rule_hits_many": f"""SELECT 'u' || (user_id % 100) AS "Category", event_type AS "Title", least(count(*), 100)::INT AS "Frequency", string_agg(line, chr(10) ORDER BY event_id) FILTER (rn <= 5) AS samples FROM (
 SELECT *, {_LINE} AS line, row_number() OVER (PARTITION BY user_id % 100, event_type ORDER BY event_id) AS rn FROM events WHERE event_type IN ('click', 'purchase', 'view') AND user_id >= 10) GROUP BY ALL""",
    "rule_summary": _WITH_DOCS + f"SELECT count(*) AS total_issues, coalesce(string_agg(DISTINCT Category, ', ' ORDER BY Category), '') AS categories FROM ({_RULES})",
    "rule_bars": _WITH_DOCS + f"SELECT Title, Category, sum(Frequency)::BIGINT AS Frequency FROM ({_RULES}) GROUP BY ALL",
    "rule_report": _WITH_DOCS
    + f"""SELECT Category, Title, Cause, FileName, row_number() OVER (PARTITION BY Category, Title, Cause, FileName ORDER BY Description, Frequency, SampleLogs)::INT AS Number, Description, Frequency, Frequency > 10 AS Highlight FROM ({_RULES})""",
    "merge_rotated": """SELECT base, row_number() OVER (PARTITION BY base ORDER BY word, rotation, archive, line_no) AS seq, line FROM (
 SELECT CASE WHEN event_id % 4 <= 1 THEN 'WiFilog.txt' WHEN event_id % 4 = 2 THEN 'Core.txt' ELSE 'mesh.txt' END AS base, CASE WHEN event_id % 4 = 1 THEN 1 ELSE -1 END AS rotation,
 'a' || (event_id % 3) AS archive, event_id AS line_no, event_type || ' ' || user_id || ' ' || event_id AS line, CASE WHEN event_id % 4 <= 1 THEN event_type ELSE '' END AS word FROM events)""",
    "normalise_member_name": """SELECT o_orderkey, name, CASE o_orderkey % 5 WHEN 0 THEN 'log' || o_orderkey WHEN 1 THEN 'x' || o_orderkey
 WHEN 2 THEN o_orderkey::VARCHAR ELSE name END AS normalised FROM (
 SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'dev_2024-03-01-10-01_log' || o_orderkey WHEN 1 THEN 'abcdefgh2023ijklmno_x' || o_orderkey WHEN 2 THEN 'abcdefgh2024ijklmnop024-0123456789abc_' || o_orderkey ELSE 'plain.txt' END AS name FROM orders)""",
    "kv_split": "SELECT event_id, event_type AS name, user_id::VARCHAR AS rss FROM events UNION ALL SELECT event_id, 'x', event_id::VARCHAR FROM events",
    "process_memory": """SELECT user_id::VARCHAR AS device, event_type AS "NAME", count(*) AS n, max(user_id::VARCHAR) AS rss FROM events GROUP BY ALL""",
    "parse_size": """SELECT o_orderkey, (o_orderkey % 100) || ['', 'kB', 'm', ' KB', 'x'][o_orderkey % 5 + 1] AS text, CASE o_orderkey % 5 WHEN 2 THEN (o_orderkey % 100) * 1024.0 WHEN 4 THEN NULL ELSE o_orderkey % 100 END::DOUBLE AS kb FROM orders""",
    "latest_value": f"SELECT device, '.' || event_type AS metric, max(time) AS time, arg_max(value, (time, report_id)) AS value FROM ({_TELEMETRY}) WHERE event_type IN ('click', 'purchase', 'view') GROUP BY ALL",
    "metric_by_suffix": f"SELECT device, report_id, key, value FROM ({_TELEMETRY}) WHERE key LIKE '%e'",
    "telemetry_wide": f"""SELECT device, report_id, CASE WHEN event_type = 'click' THEN value END AS click, CASE WHEN event_type = 'purchase' THEN value END AS purchase FROM ({_TELEMETRY}) WHERE event_type IN ('click', 'purchase')""",
    "device_status": f"""SELECT device, arg_max(value, (time, report_id)) FILTER (event_type = 'click') AS wan_mode, arg_max(value, (time, report_id)) FILTER (event_type = 'purchase') AS mesh_edge,
 arg_max(value, (time, report_id)) FILTER (event_type = 'view') AS radio1 FROM ({_TELEMETRY}) WHERE event_type IN ('click', 'purchase', 'view') GROUP BY 1""",
    "metric_series": f"""SELECT device, time, max(value::DOUBLE) FILTER (event_type = 'click') AS received, max(value::DOUBLE) FILTER (event_type = 'view') AS sent FROM ({_TELEMETRY}) WHERE event_type IN ('click', 'view') GROUP BY ALL""",
    "flatten_json": "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events",
    "json_skip_bad": "SELECT event_id::VARCHAR AS file, 1 AS report_id FROM events WHERE event_id % 3 <> 0",
    "telemetry_table": """SELECT user_id::VARCHAR AS device, event_id AS report_id, date_trunc('second', ts) AS time, 'Report.Time' AS key, strftime(ts, '%Y-%m-%d %H:%M:%S') AS value FROM events
 UNION ALL SELECT user_id::VARCHAR, event_id, date_trunc('second', ts), 'Report.x.user', 'u' || user_id FROM events""",
    "carve_json": """SELECT user_id::VARCHAR AS file, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS report_id, '{"Report":[{"id":"' || event_id || '"},{"x.y":"' || event_type || '"}]}' AS json FROM events""",
    "vector_topk": _topk("vec_id = 7", 10),
    "vector_topk_batch": _topk("vec_id % 100 = 0", 5),
    "text_search": f"WITH {_TFIDF} SELECT query_id, file, template, frequency, round(s, 4) AS similarity, rank FROM h",
    "text_search_lines": f"WITH {_TFIDF} SELECT c.role AS file, c.conv_id * 1000 + c.turn AS line_no FROM conversations c JOIN (SELECT DISTINCT file, template FROM h) x ON x.file = c.role AND x.template = c.text",
    "drilldown_hits": f"SELECT t.file, t.template, t.line_no FROM ({_TEMPLATES}) t JOIN (SELECT file, template FROM ({_TEMPLATES}) GROUP BY ALL) h ON t.file = h.file AND t.template = h.template",
    "prompt_rows": f"""SELECT file, string_agg('{{"filename":"' || file || '","template":"' || replace(template, '"', '\\"') || '","frequency":' || n || '}}', chr(10) ORDER BY n DESC, template) AS prompt FROM (
 SELECT file, template, count(*) AS n FROM ({_TEMPLATES}) GROUP BY ALL) GROUP BY 1""",
    "eligible_files": f"""SELECT id, file, original_name, file_size FROM ({_FILES}) WHERE file_size > 0 AND file NOT LIKE '%.xls' AND file NOT LIKE '%.zip'
 AND NOT regexp_matches(lower(original_name), 'telemetry2|snapshot|selfheal')""",
    "viewable_files": f"SELECT id, round(file_size / 1048576.0, 2) AS size_mb, NOT regexp_matches(lower(file), '\\.(xls|zip)$') AS is_viewable FROM ({_FILES}) WHERE file_size > 0",
    "unprocessed_files": f"SELECT id, file FROM ({_FILES}) WHERE file NOT IN (SELECT file FROM ({_MANIFEST}) WHERE state <> 'error')",
    "route_by_name": f"""SELECT original_name AS file, CASE WHEN lower(original_name) LIKE '%wifi%' THEN 'radio' WHEN lower(original_name) LIKE '%heal%' THEN 'self' WHEN lower(original_name) LIKE '%e%' THEN 'other' END AS config, count(*) AS n FROM ({_FILES}) GROUP BY ALL""",
    "project_rollup": f"""SELECT c_custkey::VARCHAR AS id, c_name AS name, coalesce(n, 0) AS file_count, coalesce(s, 0)::BIGINT AS total_size FROM customer LEFT JOIN (
 SELECT project_id, count(*) AS n, sum(file_size) AS s FROM ({_FILES}) GROUP BY 1) ON project_id = c_custkey::VARCHAR""",
    "user_rollup": f"SELECT id, username, project_count, file_count FROM ({_USERS})",
    "system_stats": f"SELECT count(*) AS users, count(*) FILTER (is_admin) AS admins, sum(project_count)::BIGINT AS projects, sum(file_count)::BIGINT AS files FROM ({_USERS})",
    "pipeline_status": f"SELECT state, count(*) AS files, (SELECT bool_and(state IN ('indexed', 'error')) FROM ({_MANIFEST})) AS all_done FROM ({_MANIFEST}) GROUP BY 1",
    "file_sizes": f"SELECT project_id, round(sum(file_size) / 1048576.0, 2) AS mb FROM ({_FILES}) GROUP BY 1",
    "render_lines": f"SELECT line_no, strftime(timestamp, '%Y-%m-%d %H:%M:%S') || ' ' || loglines AS shown, line_no // 1000 + 1 AS page FROM ({_PARSED})",
    "similarity_bands": f"SELECT query_id, CASE WHEN similarity >= 0.8 THEN 'high' WHEN similarity < 0.5 THEN 'low' ELSE 'medium' END AS band, count(*) AS n FROM ({_topk('vec_id % 100 = 0', 20)}) GROUP BY ALL",
    "status_by_name": f"SELECT file, state, state IN ('indexed', 'error') AS done FROM ({_MANIFEST})",
    "read_log_lines": f"SELECT strftime(timestamp, '%Y-%m-%d %H:%M:%S') || ' ' || loglines AS line, true AS numbered FROM ({_PARSED})",
    "write_and_read_parsed": f"SELECT file, line_no, timestamp, loglines, template FROM ({_TEMPLATES})",
    "write_and_read_rule_hits": _WITH_DOCS + f"SELECT Category, Title, Description, Frequency, FileName, least(Frequency, 5)::INT AS samples FROM ({_RULES})",
    "write_and_read_vectors": f"SELECT file, template, count(*) AS frequency, 384 AS dimensions FROM ({_TEMPLATES}) GROUP BY ALL",
    "export_and_read_patterns": f"SELECT file AS filename, count(*) AS count, template FROM ({_TEMPLATES}) GROUP BY ALL",
    "export_and_read_telemetry": f"SELECT device, report_id, key, value FROM ({_TELEMETRY})",
    "write_and_read_reports": """SELECT user_id::VARCHAR AS file, '{"Report":[{"id":"' || event_id || '"},{"x.y":"' || event_type || '"}]}' AS json FROM events""",
    "export_and_read_rules": f"SELECT category, title, 'dev.log' AS file_key, pattern, description FROM ({_PART_RULES})",
    "rule_catalog_summary": f"""SELECT category AS "Category", title AS "Title", ' Dev.LOG ' AS "FileName", count(*) AS "PatternCount" FROM ({_PART_RULES}) GROUP BY ALL""",
    "validate_rules": f"SELECT description, pattern FROM ({_PART_RULES}) WHERE pattern = '('",
    "write_and_read_merged": """SELECT CASE WHEN event_id % 4 <= 1 THEN 'WiFilog.txt' WHEN event_id % 4 = 2 THEN 'Core.txt' ELSE 'mesh.txt' END AS base, event_type || ' ' || user_id || ' ' || event_id AS line FROM events""",
    "read_catalog": f"SELECT f.id::INT AS id, original_name, c_name AS name, n_name AS username FROM ({_FILES}) f JOIN customer ON c_custkey::VARCHAR = project_id JOIN nation ON n_nationkey = c_nationkey",
    "device_info": "SELECT user_id::VARCHAR AS device, 'mac' || user_id AS mac, arg_max(event_type, (date_trunc('second', ts), event_id)) AS maker, NULL::VARCHAR AS version FROM events GROUP BY user_id",
    "process_names": "SELECT DISTINCT 'p' || user_id AS name FROM events UNION SELECT 'all'",
    "process_rows": "SELECT user_id::VARCHAR AS device, date_trunc('second', ts) AS time, '1' AS rss FROM events",
    "union_reports": f"SELECT device, report_id, time, CASE WHEN event_type = 'click' THEN value END AS click, CASE WHEN event_type = 'view' THEN value END AS view FROM ({_TELEMETRY}) WHERE event_type IN ('click', 'view')",
    "inject_year": f"SELECT file, line_no, raw, timestamp FROM ({_OWN}) WHERE event_id % 9 = 3",
    "file_stems": f"SELECT lower(regexp_replace(original_name, '[.][^.]*$', '')) AS stem, count(*) AS n FROM ({_FILES}) GROUP BY 1",
    "stream_template_counts": f"""SELECT start, template, count(*) AS count FROM (SELECT date_trunc('hour', timestamp) AS start, template FROM ({_TEMPLATES}))
 WHERE start + INTERVAL 1 HOUR <= (SELECT date_trunc('second', max(ts)) - INTERVAL 10 MINUTE FROM events) GROUP BY ALL""",
    "stream_mine_templates": f"SELECT template, count(*) AS lines FROM (SELECT {_WORDS} AS template FROM ({_TEMPLATES})) GROUP BY 1",
    "stream_rule_hits": "SELECT 'events.log' AS file, event_type AS title, least(count(*), 1000) AS \"Frequency\" FROM events WHERE event_type IN ('click', 'purchase', 'view') GROUP BY 2",
    "stream_dedupe": f"SELECT DISTINCT strftime(timestamp, '%Y-%m-%d %H:%M:%S') || ' ' || loglines AS line FROM ({_PARSED})",
    "stream_latest_status": "SELECT user_id::VARCHAR AS device, event_type AS key, date_trunc('second', max(ts)) AS time FROM events GROUP BY ALL",
}
