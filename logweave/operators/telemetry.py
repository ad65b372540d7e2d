"""Telemetry: carving of reports, the long table, latest values and series."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.telemetry import METRICS, flatten_json, flatten_report, kv_split, null_normalise, parse_size, strip_log_prefix, trim_json_tail
from ..session import materialise

#: Line numbers of a run that one task carves.
CARVE_BLOCK = 50_000
#: Runs whose summaries go on together; what stands for a line without an opening brace.
SUMMARIES, NO_BRACE = 4096, -(1 << 62)
DEVICE_INFO = ("MAC", "SERIAL_NUMBER", "VERSION", "HW_VERSION", "MODEL_NAME", "MANUFACTURER")
DEVICE_STATUS = ("WAN_MODE", "MESH_EDGE", "RADIO1_ENABLE", "RADIO2_ENABLE", "AP1_STATUS", "AP2_STATUS")
#: Metrics of a series by its name.
SERIES = {
    "memory": ("MEM_AVAILABLE", "MEM_CACHED"),
    "cpu": ("CPU_USAGE", "CPU_TEMP"),
    "wan_bytes": ("WAN_BYTES_RECEIVED", "WAN_BYTES_SENT"),
    "wan_packets": ("WAN_PACKETS_RECEIVED", "WAN_PACKETS_SENT"),
    "ssid_bytes": ("SSID1_BYTES_RECEIVED", "SSID1_BYTES_SENT"),
    "ssid_packets": ("SSID1_PACKETS_RECEIVED", "SSID1_PACKETS_SENT"),
    "ssid_errors": ("SSID1_ERRORS_RECEIVED", "SSID1_ERRORS_SENT"),
}


def _scan(total: list[int], opens: list[int | None]) -> dict[int | None, tuple[int, int | None]]:
    """What a run of lines does to each state in front of it: blocks that end in it, and the state behind it.

    A state is None outside a block, else the number of open braces. ``total``: opening less
    closing braces of each line; ``opens``: the same from the first opening brace on, None
    without one. States that are not in the answer stay in their block: ``total`` is added.
    A block that begins in line s ends in the first line from s on where the running total has
    come back to what it was in front of that brace; lines are walked backwards, so that such
    a line, and what follows it, are known.
    """
    running, at = [], 0
    for t in total:
        at += t
        running.append(at)
    outside: tuple[int, int | None] = (0, None)
    after: dict[int, tuple[int, int | None]] = {}
    for k in range(len(total) - 1, -1, -1):
        after[running[k]] = outside
        if opens[k] is not None:
            back = running[k] - opens[k]
            outside = (after[back][0] + 1, after[back][1]) if back in after else (0, at - back)
    found: dict[int | None, tuple[int, int | None]] = {-v: (n + 1, state) for v, (n, state) in after.items() if v}
    found[None] = outside
    return found


def _numbers(batch: pa.RecordBatch, column: str, null: int = 0) -> list[int]:
    """A column of numbers as a list, with ``null`` for nulls."""
    return pc.fill_null(batch.column(column), null).to_numpy(zero_copy_only=False).tolist()


def _names(batch: pa.RecordBatch, column: str) -> list[str | None]:
    """A column of texts as a list in which equal neighbours of a batch are one object."""
    coded = batch.column(column).dictionary_encode()
    names = [*coded.dictionary.to_pylist(), None]
    return [names[k] for k in pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).tolist()]


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_scan`` of each run of lines (neighbouring rows of equal ``file`` and ``block``); one run is held at a time, many summaries go on in one batch.

    State None is written as 0, which is no state of a block.
    """
    names = ["file", "block", "total", "ended", "state", "from", "from_ended", "from_state"]
    kinds = [pa.string(), *[pa.int64()] * 4, *[pa.list_(pa.int64())] * 3]
    run, total, opens, out = None, [], [], []

    def summed() -> tuple:
        found = _scan(total, opens)
        ended, state = found.pop(None)
        each = found.values()
        return (*run, sum(total), ended, state or 0, list(found), [n for n, _ in each], [x or 0 for _, x in each])

    def sent() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    for batch in batches:
        keys = list(zip(_names(batch, "file"), _numbers(batch, "block")))
        totals, all_opens = _numbers(batch, "total"), [None if x == NO_BRACE else x for x in _numbers(batch, "opens", NO_BRACE)]
        first = 0
        for k in range(1, len(keys) + 1):
            if k == len(keys) or keys[k] != keys[first]:
                if keys[first] != run:
                    if run is not None:
                        out.append(summed())
                    run, total, opens = keys[first], [], []
                total += totals[first:k]
                opens += all_opens[first:k]
                first = k
        if len(out) >= SUMMARIES or sum(len(x[5]) for x in out) >= 50 * SUMMARIES:
            yield sent()
            out = []
    if run is not None:
        out.append(summed())
    if out:
        yield sent()


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of summaries in order of file and run: the state in front of each run (0: outside a block), and the blocks that have ended before it."""
    kinds = (pa.string(), *[pa.int64()] * 4)
    file, state, number, first = None, 0, 0, True
    for batch in batches:
        out = []
        ends = batch.column("from").offsets.to_numpy().tolist()
        base = ends[0]
        froms, from_ended, from_state = (batch.column(c).flatten().to_numpy(zero_copy_only=False).tolist() for c in ("from", "from_ended", "from_state"))
        rows = zip(_names(batch, "file"), _numbers(batch, "block"), _numbers(batch, "total"), _numbers(batch, "ended"), _numbers(batch, "state"))
        for k, (name, block, total, ended, behind) in enumerate(rows):
            if first or name != file:
                file, state, number, first = name, 0, 0, False
            entry, before = state, number
            if state == 0:
                state = behind
            else:
                known = froms[ends[k] - base : ends[k + 1] - base]
                if state in known:
                    at = ends[k] - base + known.index(state)
                    ended, state = from_ended[at], from_state[at]
                else:
                    ended, state = 0, state + total
            number += ended
            out.append((name, block, entry, before, number))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["file", "block", "state", "number", "until"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of reports, as far as a run of lines holds them; in front of a run's lines stands its entry (``_entries``)."""
    run, state, number, last, at, parts = None, None, 0, 0, 0, []
    for batch in batches:
        out = []
        columns = (_names(batch, "file"), _numbers(batch, "block"), _numbers(batch, "line_no"), batch.column("line").to_pylist(), _numbers(batch, "total"), _numbers(batch, "opens", NO_BRACE))
        for file, block, line_no, line, total, opens, entry, ended, reports in zip(*columns, *(_numbers(batch, c) for c in ("state", "number", "reports"))):
            if run is None or block != run[1] or file != run[0]:
                if parts:
                    out.append((run[0], number + 1, at, "".join(parts)))
                run, state, number, last, parts = (file, block), None, 0, 0, []
            if reports:  # an entry: only files with reports have any
                state, number, last = entry or None, ended, reports
                continue
            if number >= last or (state is None and opens == NO_BRACE):  # what begins behind the last report never ends
                continue
            if state is None:
                state, total, line = 0, opens, line[line.index("{") :]
            if not parts:
                at = line_no
            parts.append(line)
            state += total
            if state == 0:
                number += 1
                out.append((file, number, at, "".join(parts)))
                state, parts = None, []
        if out:
            yield _piece_batch(out)
    if parts:
        yield _piece_batch([(run[0], number + 1, at, "".join(parts))])


def _piece_batch(rows: list[tuple[str, int, int, str]]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["file", "report_id", "line_no", "piece"])


def carve_json(lines: DataFrame, block: int = CARVE_BLOCK) -> DataFrame:
    """JSON blocks of log files: ``file``, ``report_id`` (from 1), ``json``.

    A block begins at the first ``{`` outside a block and ends with the line at whose end
    its braces balance (those inside strings count, too); lines are joined without the
    device-log prefixes. Braces that close nothing are passed over outside a block; a balance
    that goes below zero does not end its block; an unterminated block is dropped. A null line
    counts as empty.

    The scan is parallel: runs of ``block`` line numbers are summed up by what they do to each
    state in front of them (``_scan``; only brace counts are shuffled for that), the summaries
    of a file, one row a run, are composed in order, which gives each run its entry state, and
    then all runs are cut into reports at once. So one file is shared out to many tasks, each
    holds one run, and lines of an unterminated block go no further than their run.
    """
    text = F.regexp_replace(strip_log_prefix(F.coalesce("line", F.lit(""))), r"^\s+|\s+$", "")
    braces = lambda t: F.length(F.replace(t, F.lit("}"), F.lit(""))) - F.length(F.replace(t, F.lit("{"), F.lit("")))
    rows = lines.select("file", F.floor(F.col("line_no") / block).alias("block"), "line_no", text.alias("line"))
    tail = F.when(F.col("line").contains("{"), F.substr("line", F.instr("line", "{")))
    rows = rows.select("*", braces(F.col("line")).cast("bigint").alias("total"), braces(tail).cast("bigint").alias("opens"))
    counted = rows.select("file", "block", "line_no", "total", "opens")
    counted = counted.repartition("file", "block").sortWithinPartitions("file", "block", "line_no")
    sums = counted.mapInArrow(_summaries, "file string, block bigint, total bigint, ended bigint, state bigint, `from` array<bigint>, from_ended array<bigint>, from_state array<bigint>")
    in_order = sums.repartition("file").sortWithinPartitions("file", "block")
    entries = materialise(in_order.mapInArrow(_entries, "file string, block bigint, state bigint, number bigint, until bigint"), "entries")
    last = entries.groupBy(F.col("file").alias("_file")).agg(F.max("until").alias("reports"))
    entries = entries.join(last, F.col("file").eqNullSafe(F.col("_file"))).where("number < reports")
    both = rows.unionByName(entries.select("file", "block", "state", "number", "reports"), allowMissingColumns=True)
    both = both.repartition("file", "block").sortWithinPartitions("file", "block", F.asc_nulls_first("line_no"))
    pieces = both.mapInArrow(_pieces, "file string, report_id int, line_no bigint, piece string")
    in_line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "piece"))), lambda p: p["piece"]), "")
    return pieces.groupBy("file", "report_id").agg(in_line.alias("json")).withColumn("json", trim_json_tail(F.col("json")))


def telemetry_table(reports: DataFrame, device: str = "file") -> DataFrame:
    """Long table (``device``, ``report_id``, ``time``, ``key``, ``value``) of reports (``report_id``, ``json``).

    Keys are dotted paths; empty values and the word ``null`` are left out. ``time`` is the
    first ``*.Time`` value by key order. Reports of the usual shape are taken apart without
    Python.
    """
    usual = flatten_report(F.col("json"))
    split = reports.select(F.col(device).alias("device"), "report_id", "json", usual.alias("m"))
    rest = split.where("m is null").withColumn("m", flatten_json("json"))
    rows = split.where("m is not null").unionByName(rest).select("device", "report_id", "m")
    rows = rows.withColumn("m", F.map_filter("m", lambda _, v: null_normalise(v).isNotNull()))
    times = F.array_sort(F.map_entries(F.map_filter("m", lambda k, _: k.endswith(METRICS["TIME"]))))
    time = F.try_to_timestamp(F.try_element_at(times, F.lit(1))["value"], F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    return rows.select("device", "report_id", time.alias("time"), F.explode("m").alias("key", "value"))


def telemetry_wide(telemetry: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per device, report and time with a column for each named metric, by time."""
    named = _named(telemetry, metrics)
    return named.groupBy("device", "report_id", "time").pivot("metric", metrics).agg(F.first("value", ignorenulls=True)).orderBy("time", "device", "report_id")


def metric(telemetry: DataFrame, suffix: str, index: int = 0) -> DataFrame:
    """Rows of the ``index``-th key of each report that ends with ``suffix``."""
    ranked = telemetry.where(F.col("key").endswith(suffix)).withColumn("_n", F.row_number().over(Window.partitionBy("device", "report_id").orderBy("key")) - 1)
    return ranked.where(F.col("_n") == index).drop("_n")


def _named(telemetry: DataFrame, metrics: list[str] | tuple[str, ...]) -> DataFrame:
    """Rows of the metrics named, with their name."""
    key = F.col("key")
    name = None
    for m in metrics:
        hit = key.endswith(METRICS.get(m, m))
        name = F.when(hit, F.lit(m)) if name is None else name.when(hit, F.lit(m))
    return telemetry.withColumn("metric", name).where("metric is not null")


def latest_value(telemetry: DataFrame, metrics: list[str] | tuple[str, ...], index: dict[str, int] | None = None) -> DataFrame:
    """The value of each metric at its latest time per device; rows without time do not count.

    Of several keys with a metric's suffix the first by name counts, or that of ``index`` (from 0; null where there are fewer).
    """
    rows = _named(telemetry, metrics).where("time is not null")
    each = rows.groupBy("device", "metric", "key").agg(F.max("time").alias("time"), F.max_by("value", F.struct("time", "report_id")).alias("value"))
    keys = F.array_sort(F.collect_list(F.struct("key", "time", "value")))  # the few keys of one suffix
    nth = F.lit(0)
    for name, n in (index or {}).items():
        nth = F.when(F.col("metric") == name, F.lit(n)).otherwise(nth)
    found = each.groupBy("device", "metric").agg(keys.alias("keys")).select("device", "metric", F.get("keys", nth).alias("one"))
    return found.select("device", "metric", "one.time", "one.value")


def _latest_wide(telemetry: DataFrame, metrics: tuple[str, ...], index: dict[str, int] | None = None) -> DataFrame:
    return latest_value(telemetry, metrics, index).groupBy("device").pivot("metric", list(metrics)).agg(F.first("value"))


def device_info(telemetry: DataFrame) -> DataFrame:
    """Latest address, serial number, versions, model and manufacturer (the second such key) of each device."""
    return _latest_wide(telemetry, DEVICE_INFO, {"MANUFACTURER": 1})


def device_status(telemetry: DataFrame) -> DataFrame:
    """Latest modes, radios and access points of each device."""
    return _latest_wide(telemetry, DEVICE_STATUS)


def metric_series(telemetry: DataFrame, group: str) -> DataFrame:
    """Values over time of a group of metrics (``SERIES``), a column each; sizes in KB for ``memory``."""
    metrics = SERIES[group]
    value = parse_size(F.col("value")) if group == "memory" else F.col("value").try_cast("double")
    rows = _named(telemetry, metrics).where("time is not null").withColumn("_v", value)
    return rows.groupBy("device", "time").pivot("metric", list(metrics)).agg(F.max("_v"))


def process_memory(telemetry: DataFrame) -> DataFrame:
    """Processes of the packed memory column: ``device``, ``time``, ``NAME`` and every key as ``fields``."""
    rows = _named(telemetry, ("PROCESS_MEMORY",)).where("value is not null")
    return rows.select("device", "time", F.explode(kv_split(F.col("value"))).alias("fields")).select("device", "time", F.col("fields")["NAME"].alias("NAME"), "fields")


def process_names(processes: DataFrame) -> DataFrame:
    """Distinct process names."""
    return processes.select("NAME").distinct()


def process_rows(processes: DataFrame, name: str) -> DataFrame:
    """Rows of a process by time."""
    return processes.where(F.col("NAME") == name).orderBy("time", "device")


def drop_empty_columns(reports: DataFrame) -> DataFrame:
    """A wide table without the columns that are null in every row."""
    counts = reports.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in reports.columns]).first()
    return reports.select(*[F.col(f"`{c}`") for c in reports.columns if counts[c]])


def union_reports(*reports: DataFrame) -> DataFrame:
    """Reports with different columns as one table; what a report lacks is null."""
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out
