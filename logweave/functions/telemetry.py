"""Functions of telemetry reports, as Catalyst expressions (``flatten_json``: a pandas function)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

#: What stands in front of a report's lines in a device log. Fixed value.
LOG_PREFIX = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2} [^ ]+ T\d\.\w+ \[tid=\d+\] ?"

#: Metrics and the suffix of their keys. Fixed values.
METRICS = {
    "TIME": ".Time",
    "MEM_AVAILABLE": ".meminfoavailable_split",
    "MEM_CACHED": ".cachedMem_split",
    "NVRAM_FREE": ".flash_usage_nvram_free_split",
    "CPU_TEMP": ".cpu_temp_split",
    "CPU_USAGE": ".CPUUsage",
    "MAC": ".mac",
    "VERSION": ".Version",
    "PRODUCT_CLASS": ".ProductClass",
    "SERIAL_NUMBER": ".SerialNumber",
    "HW_VERSION": ".hardwareversion",
    "MODEL_NAME": ".ModelName",
    "MANUFACTURER": ".manufacturer",
    "EROUTER_IPV4": ".erouterIpv4",
    "WAN_MODE": ".wan_access_mode_split",
    "RADIO1_ENABLE": ".wifi_radio_1_enable",
    "RADIO2_ENABLE": ".wifi_radio_2_enable",
    "AP1_STATUS": ".wifi_accesspoint_1_status",
    "AP2_STATUS": ".wifi_accesspoint_2_status",
    "SSID1": ".wifi_ssid_1_ssid",
    "SSID2": ".wifi_ssid_2_ssid",
    "MESH_EDGE": ".airties_edge_enable",
    "WAN_BYTES_RECEIVED": ".wan_bytesReceived",
    "WAN_BYTES_SENT": ".wan_bytesSent",
    "WAN_PACKETS_RECEIVED": ".wan_packetsReceived",
    "WAN_PACKETS_SENT": ".wan_packetsSent",
    "SSID1_PACKETS_SENT": ".wifi_ssid_1_stats_packetssent",
    "SSID1_PACKETS_RECEIVED": ".wifi_ssid_1_stats_packetsreceived",
    "SSID1_BYTES_SENT": ".wifi_ssid_1_stats_bytessent",
    "SSID1_BYTES_RECEIVED": ".wifi_ssid_1_stats_bytesreceived",
    "SSID1_ERRORS_SENT": ".wifi_ssid_1_stats_errorssent",
    "SSID1_ERRORS_RECEIVED": ".wifi_ssid_1_stats_errorsreceived",
    "MESH_MEMORY": ".mesh_memory_usage_split",
    "PROCESS_MEMORY": ".ccsp_memory_usage_split",
}


def strip_log_prefix(line: Column) -> Column:
    """A line without its device-log prefixes."""
    return F.regexp_replace(line, LOG_PREFIX, "")


def trim_json_tail(text: Column) -> Column:
    """A carved report up to its last ``}]}``; without one, less blanks and ``%`` at its end."""
    tail = r"(?s)^(.*\}\]\})"
    return F.when(text.rlike(tail), F.regexp_extract(text, tail, 1)).otherwise(F.regexp_replace(text, r"[%\s]+$", ""))


def parse_size(text: Column) -> Column:
    """KB of ``12``, ``5 kB`` or ``2m`` (times 1024); null if it is no number."""
    t = F.lower(F.trim(text))
    number = lambda x: F.trim(x).try_cast("double")
    return (
        F.when(t.endswith("kb"), number(F.regexp_replace(t, "kb$", "")))
        .when(t.endswith("m"), number(F.regexp_replace(t, "m$", "")) * 1024)
        .otherwise(number(t))
    )


def kv_split(text: Column) -> Column:
    """Maps of a packed column ``k=v|k=v;k=v``: one per non-blank part between semicolons."""
    parts = F.filter(F.split(text, ";"), lambda p: F.trim(p) != "")
    pair = lambda e: F.struct(F.trim(F.element_at(F.split(e, "=", 2), 1)).alias("key"), F.trim(F.try_element_at(F.split(e, "=", 2), F.lit(2))).alias("value"))
    return F.transform(parts, lambda p: F.map_from_entries(F.transform(F.split(p, r"\|"), pair)))


def null_normalise(value: Column) -> Column:
    """Null for an empty value and for the word ``null``."""
    return F.when(~value.isin("", "null"), value)


def _flatten(value: object, key: str, out: dict[str, str]) -> None:
    if isinstance(value, dict):
        for k, v in value.items():
            _flatten(v, f"{key}.{k}" if key else k, out)
    elif isinstance(value, list):
        for v in value:
            _flatten(v, key, out)
    elif value is not None:
        out[key.rstrip(".")] = value if isinstance(value, str) else json.dumps(value)


@F.pandas_udf(MapType(StringType(), StringType()))
def flatten_json(reports: pd.Series) -> pd.Series:
    """Leaves of a JSON object by dotted key; of a list's elements, the later ones win. Null if undecodable."""

    def one(text: str | None):
        try:
            value = json.loads(text) if text else None
        except ValueError:
            return None
        if not isinstance(value, dict):
            return None
        out: dict[str, str] = {}
        _flatten(value, "", out)
        return out

    return reports.map(one)


def flatten_report(report: Column) -> Column:
    """Keys and values of a report ``{"Report": [{..}, ..]}`` without Python: later entries win. Null if it has another shape."""
    entries = F.from_json(report, "Report array<map<string,string>>")["Report"]
    merged = F.aggregate(entries, F.expr("cast(map() as map<string,string>)"), lambda acc, m: F.map_concat(acc, F.coalesce(m, F.expr("cast(map() as map<string,string>)"))))
    return F.transform_keys(merged, lambda k, _: F.concat(F.lit("Report."), k))
