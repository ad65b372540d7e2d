"""Time-stamp prefixes of log lines, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Time stamps that a line may begin with, in the order in which they are tried. Fixed values.
PREFIXES = (
    r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}",
    r"\d{4}-\d{2}-\d{2}-\d{2}-\d{2}-\d{2}",
    r"\d{6}-\d{2}:\d{2}:\d{2}\.\d+",
    r"[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}",
    r"\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2}",
    r"\d+\.\d+",
)
_LINE = rf"^({'|'.join(PREFIXES)})[:\s]+(.*)$"


def raw_timestamp(line: Column) -> Column:
    """The text of the time stamp in front of a line; null if there is none."""
    return F.nullif(F.regexp_extract(line, _LINE, 1), F.lit(""))


def message(line: Column) -> Column:
    """The line behind its time stamp; the whole line if there is none."""
    return F.when(line.rlike(_LINE), F.regexp_extract(line, _LINE, 2)).otherwise(line)


def _ntz(text: Column, pattern: str) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")


def parse_timestamp(raw: Column, syslog_year: Column | int | None = None) -> Column:
    """The time of a raw time stamp, to the second, by its dialect.

    Dialects: ISO with ``T``, all dashes, ``yymmdd-H:M:S.f`` (the fraction is dropped, two
    digits of a year are 1969 to 2068), ``Mon d H:M:S`` (in ``syslog_year``, else the current
    year), ISO with a blank. Null for uptimes (``rebase_uptime``), dates that do not exist,
    and anything else.
    """
    year = F.year(F.current_date()) if syslog_year is None else (syslog_year if isinstance(syslog_year, Column) else F.lit(syslog_year))
    compact = F.regexp_extract(raw, r"^(\d{6}-\d{2}:\d{2}:\d{2})\.\d+$", 1)
    century = F.when(F.substring(compact, 1, 2).cast("int") >= 69, F.lit("19")).otherwise(F.lit("20"))
    syslog = F.regexp_replace(raw, r"\s+", " ")
    is_syslog = raw.rlike(r"^[A-Z][a-z]{2}\s")
    return F.coalesce(
        F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}T"), _ntz(raw, "yyyy-MM-dd'T'HH:mm:ss")),
        F.when(raw.rlike(r"^\d{4}(-\d{2}){5}$"), _ntz(raw, "yyyy-MM-dd-HH-mm-ss")),
        F.when(compact != "", _ntz(F.concat(century, compact), "yyyyMMdd-HH:mm:ss")),
        F.when(is_syslog, _ntz(F.concat(year.cast("string"), F.lit(" "), syslog), "yyyy MMM d HH:mm:ss")),
        F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}\s"), _ntz(F.regexp_replace(raw, r"\s", " "), "yyyy-MM-dd HH:mm:ss")),
    )


def to_utc_naive(text: Column) -> Column:
    """The time of an ISO time stamp without zone, in UTC: an offset (``+02:00``, ``Z``) is taken off, none counts as UTC.

    The session's time zone is UTC (``session.SETTINGS``). Null for anything else.
    """
    iso = F.regexp_replace(F.trim(text), r"^(\d{4}-\d{2}-\d{2})\s", "$1T")
    known = iso.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})?$")
    zoned = F.when(iso.rlike(r"(Z|[+-]\d{2}:\d{2})$"), iso).otherwise(F.concat(iso, F.lit("Z")))
    return F.when(known, zoned.try_cast("timestamp").cast("timestamp_ntz"))


def is_uptime(raw: Column) -> Column:
    """Whether a raw time stamp counts seconds since the device's start."""
    return raw.rlike(r"^\d+\.\d+$")


def rebase_uptime(raw: Column, base: Column) -> Column:
    """``base`` plus an uptime in seconds; null if either is missing."""
    micros = F.round(raw.try_cast("double") * 1_000_000).cast("bigint")
    return F.when(is_uptime(raw), (F.timestamp_micros(F.unix_micros(base.cast("timestamp")) + micros)).cast("timestamp_ntz"))
