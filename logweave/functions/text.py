"""Text functions of log lines and file names, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Value classes in the order in which they are masked: pattern, name. Fixed values.
MASKS = (
    (r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", "DATETIME"),
    (r"\d{4}-\d{2}-\d{2}-\d{2}-\d{2}-\d{2}", "DATETIME"),
    (r"\d{6}-\d{2}:\d{2}:\d{2}\.\d+", "DATETIME"),
    (r"[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}", "DATETIME"),
    (r"[A-Z][a-z]{2}\s+[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+UTC\s+\d{4}", "DATETIME"),
    (r"\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2}", "DATETIME"),
    (r"\b\d{4,6}\.\d{4,6}\b", "DATETIME"),
    (r"VERSION=\d+(?:\.\d+){2,}", "VERSION"),
    (r"\[tid=\d+\]", "THREADID"),
    (r"([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})", "MAC"),
    (r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "IP"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "IP"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}:\d+\b", "IP_PORT"),
    (r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b", "IPv6"),
    (r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}:\d+\b", "IPv6_PORT"),
    (r"\b\d+\b", "NUM"),
    (r"\b\d+\.\d+\.\d+\.\d+\/\d+\b", "CIDR"),
    (r"\b(?:[0-9a-fA-F]{2}[:-]){5}(?:[0-9a-fA-F]{2})\/\d+\b", "MAC_CIDR"),
)
#: Delimiters of a template's words besides blanks. Fixed values.
DELIMITERS = "-=,:"


def mask_values(line: Column, masks: tuple[tuple[str, str], ...] = MASKS) -> Column:
    """The line with each value replaced by ``<NAME>`` of its class, class after class."""
    for pattern, name in masks:
        line = F.regexp_replace(line, pattern, f"<{name}>")
    return line


def tokenise(line: Column, delimiters: str = DELIMITERS) -> Column:
    """Words of a line between blanks and delimiters; an empty line has one empty word."""
    inner = "".join("\\" + c for c in delimiters)
    return F.split(F.trim(F.regexp_replace(F.trim(line), f"[{inner} ]+", " ")), " ")


def mining_prefix(words: Column, depth: int) -> Column:
    """The words by which similar lines are looked up: a third of them from the left, 1 to ``depth - 2``; those with digits count alike."""
    n = F.least(F.lit(max(depth - 2, 1)), F.greatest(F.lit(1), F.floor(F.size(words) / 3))).cast("int")
    return F.array_join(F.transform(F.slice(words, F.lit(1), n), lambda w: F.when(w.rlike(r"\d"), F.lit("<*>")).otherwise(w)), " ")


def strip_ansi(text: Column) -> Column:
    """Text without terminal colour codes."""
    return F.regexp_replace(text, r"\x1b\[[0-9;]*m", "")


def strip_control(text: Column, all_of_them: bool = False) -> Column:
    """Text without control characters; tab, newline and carriage return stay unless ``all_of_them``."""
    return F.regexp_replace(text, r"[\x00-\x1f\x7f]" if all_of_them else r"[\x00-\x08\x0b-\x0c\x0e-\x1f]", "")


def clean_template(text: Column) -> Column:
    """A template as it is exported."""
    return strip_control(strip_ansi(text))


def file_stem(name: Column) -> Column:
    """A file name without its last suffix, in lower case and trimmed; a leading dot is no suffix."""
    return F.lower(F.trim(F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")))


def normalise_member_name(name: Column, any_year: bool = False) -> Column:
    """An archive member's name without its dated prefix.

    Only names that hold 2023, 2024 or 2025 (``any_year``: 2000 to 2099) change: 19 characters
    go, or 37 if ``024-`` follows; then 2 more if ``1_`` is in the rest; then 1 more if the
    rest begins with a digit or an underscore.
    """
    rest = F.substring(name, 20, 10_000)
    rest = F.when(rest.contains("024-"), F.substring(name, 38, 10_000)).otherwise(rest)
    rest = F.when(rest.contains("1_"), F.substring(rest, 3, 10_000)).otherwise(rest)
    rest = F.when(rest.rlike(r"^[0-9_]"), F.substring(rest, 2, 10_000)).otherwise(rest)
    return F.when(name.rlike(r"20\d\d" if any_year else "202[345]"), rest).otherwise(name)


def rotation_base(name: Column) -> Column:
    """A log's name without its rotation number."""
    return F.regexp_extract(name, r"^(.+?)(?:\.(\d+))?$", 1)


def rotation_number(name: Column) -> Column:
    """The rotation number behind a log's name; -1 if there is none."""
    return F.coalesce(F.regexp_extract(name, r"^(.+?)(?:\.(\d+))?$", 2).try_cast("int"), F.lit(-1))


def size_mb(n: Column) -> Column:
    """Bytes in MB of 2**20, to two digits."""
    return F.round(n / F.lit(1048576.0), 2)


def line_page(line_no: Column, size: int = 1000) -> Column:
    """The page of a 1-based line number."""
    return F.floor((line_no - 1) / size) + 1


def samples_text(samples: Column) -> Column:
    """Sample lines as one text."""
    return F.array_join(samples, "\n")


def render_line(timestamp: Column, line: Column) -> Column:
    """A parsed line as it is shown."""
    return F.concat_ws(" ", F.date_format(timestamp, "yyyy-MM-dd HH:mm:ss"), line)


def similarity_band(similarity: Column) -> Column:
    """``high`` from 0.8 on, ``low`` below 0.5, else ``medium``."""
    return F.when(similarity >= 0.8, "high").when(similarity < 0.5, "low").otherwise("medium")
