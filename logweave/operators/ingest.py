"""From raw lines to parsed lines: time stamps, forward fill, blank lines, rotated files."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise_member_name, rotation_base, rotation_number
from ..functions.timestamps import is_uptime, message, parse_timestamp, raw_timestamp, rebase_uptime
from .numbering import number_rows

#: Lines of a file that are filled in one window; longer files are filled block by block.
FILL_BLOCK = 100_000
LEAP_YEAR = 2000


def strip(text: Column) -> Column:
    """Text without white space at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def drop_blank_lines(lines: DataFrame, column: str = "loglines") -> DataFrame:
    """Lines with their ends stripped, less empty ones and those of the two characters ``\\n``."""
    return lines.withColumn(column, strip(F.col(column))).where(~F.col(column).isin("", "\\n"))


def forward_fill(rows: DataFrame, column: str, group: str = "file", order: str = "line_no", block: int = FILL_BLOCK) -> DataFrame:
    """Each null of ``column`` replaced by the last value before it in its group; leading nulls stay.

    In two levels: inside blocks of line numbers, then with the last value of earlier blocks,
    so that one huge file is shared out to many tasks.
    """
    rows = rows.withColumn("_block", F.floor(F.col(order) / block))
    inside = F.last(column, ignorenulls=True).over(Window.partitionBy(group, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    lasts = rows.groupBy(group, "_block").agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.col(order))).alias("_last"))
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    lasts = lasts.select(group, "_block", before.alias("_before"))
    filled = rows.withColumn(column, inside).join(lasts, [group, "_block"])
    return filled.withColumn(column, F.coalesce(column, "_before")).drop("_block", "_before")


def parse_lines(lines: DataFrame, syslog_year: int | None = None, default_base: datetime.datetime | None = None) -> DataFrame:
    """``file``, ``line_no``, ``raw``, ``timestamp``, ``loglines`` of each line, before filling and cleaning.

    Syslog lines get ``syslog_year``, else the year of the file's earliest fully dated line,
    else the current year. Uptimes count from the earliest time of their file, else from
    ``default_base`` (null: they stay without time).
    """
    rows = lines.select("file", "line_no", raw_timestamp(F.col("line")).alias("raw"), message(F.col("line")).alias("loglines"))
    firsts = _first_times(rows, syslog_year)
    base = F.coalesce("_base", F.lit(default_base).cast("timestamp_ntz"))
    year = F.lit(syslog_year) if syslog_year is not None else F.col("_year")
    own = F.coalesce(parse_timestamp(F.col("raw"), year), rebase_uptime(F.col("raw"), base))
    return rows.join(firsts, "file").withColumn("timestamp", own).drop("_base", "_year")


def _first_times(rows: DataFrame, syslog_year: int | None) -> DataFrame:
    """``file``, ``_year`` (of its syslog lines) and ``_base`` (its earliest time), in one pass over the raw time stamps.

    Syslog lines have no year, so their earliest is taken in a leap year: once of all lines,
    once without the 29th of February, which other years do not have.
    """
    raw = F.col("raw")
    if syslog_year is not None:
        return rows.groupBy("file").agg(F.min(parse_timestamp(raw, syslog_year)).alias("_base"), F.lit(syslog_year).alias("_year"))
    syslog = F.when(raw.rlike("^[A-Z]"), parse_timestamp(raw, LEAP_YEAR))
    common = F.when(~raw.rlike(r"^Feb\s+29\s"), syslog)
    found = rows.groupBy("file").agg(F.min(F.when(~raw.rlike("^[A-Z]"), parse_timestamp(raw))).alias("_dated"), F.min(syslog).alias("_all"), F.min(common).alias("_common"))
    year = F.coalesce(F.year("_dated"), F.year(F.current_date()))
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    first = F.when(leap, F.col("_all")).otherwise(F.col("_common"))
    dated = F.try_to_timestamp(F.concat(year.cast("string"), F.date_format(first, "-MM-dd HH:mm:ss")), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    return found.select("file", F.least("_dated", dated).alias("_base"), year.alias("_year"))


def parse_logs(lines: DataFrame, syslog_year: int | None = None, default_base: datetime.datetime | None = None) -> DataFrame:
    """Parsed logs (``file``, ``line_no``, ``timestamp``, ``loglines``) of raw lines (``file``, ``line_no``, ``line``).

    Time stamps are split off and parsed by dialect, uptimes rebased, lines without a time
    get that of the line before them, then blank lines are dropped. A date that does not
    exist makes only its own line's time null.
    """
    filled = forward_fill(parse_lines(lines, syslog_year, default_base), "timestamp")
    return drop_blank_lines(filled.select("file", "line_no", "timestamp", "loglines"))


def sort_parsed(parsed: DataFrame) -> DataFrame:
    """Parsed lines by time, those without time last, then by line number."""
    return parsed.orderBy(F.col("timestamp").asc_nulls_last(), "file", "line_no")


def parse_coverage(lines: DataFrame, syslog_year: int | None = None) -> DataFrame:
    """Per file: lines, lines with a time of their own, and lines without any after filling."""
    own = parse_lines(lines, syslog_year)
    whole = forward_fill(own.select("file", "line_no", "timestamp"), "timestamp").groupBy("file").agg(F.count_if(F.col("timestamp").isNull()).alias("without_time"))
    some = own.groupBy("file").agg(F.count("*").alias("total"), F.count_if(F.col("timestamp").isNotNull() & ~F.coalesce(is_uptime(F.col("raw")), F.lit(False))).alias("dated"), F.count("timestamp").alias("parsed"))
    return some.join(whole, "file")


def merge_rotated(members: DataFrame) -> DataFrame:
    """Lines of archive members (``archive``, ``member``, ``line_no``, ``line``) by base name: ``base``, ``seq``, ``line``.

    Names are normalised; members of one name follow each other in order of their archives;
    rotations ``.1``, ``.2``, .. follow the base file. If a base has several versions, its
    lines are sorted by their first word, keeping that order among equals. Lines are numbered
    by ``number_rows``, so that a base of any size is spread over many tasks.
    """
    name = normalise_member_name(F.col("member"))
    rows = members.select(rotation_base(name).alias("base"), rotation_number(name).alias("rotation"), "archive", "line_no", "line")
    versions = rows.groupBy("base").agg(F.count_distinct("rotation").alias("versions"))
    first = F.coalesce(F.regexp_extract("line", r"^\s*(\S+)", 1), F.lit(""))
    rows = rows.join(versions, "base").withColumn("word", F.when(F.col("versions") > 1, first).otherwise(F.lit("")))
    return number_rows(rows, ["word", "rotation", "archive", "line_no"], ["base"]).select("base", "seq", "line")
