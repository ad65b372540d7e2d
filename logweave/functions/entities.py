"""Entities inside log lines: kinds, counts and spans."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("text", StringType()), StructField("kind", StringType())]))

#: Words of log levels by kind. Fixed values.
LEVELS = {
    "error": "ERR|ERROR|FATAL|CRITICAL|FAIL|FAILED|EXCEPTION|CRASH|ABORT|PANIC",
    "warning": "WARN|WARNING|WARN|DEPRECATED|CAUTION|ALERT|DISCONNECTED",
    "info": "INFO|INFORMATION|NOTICE|SUCCESS|OK|PASS|PASSED|COMPLETE|COMPLETED|CONNECTED",
    "debug": "OFF|DEBUG|TRACE|VERBOSE|DETAIL",
}

#: Kinds of entities and their patterns, matched in any case. Fixed values.
ENTITIES = (
    ("timestamp", r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|[+-]\d{2}:\d{2})?\b"),
    ("timestamp", r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\b"),
    ("timestamp", r"(?<![0-9A-Fa-f:])\b\d{2}:\d{2}:\d{2}(?:\.\d{3})?\b(?![:0-9A-Fa-f])"),
    ("mac", r"\b([0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b"),
    ("module", r"\[([A-Za-z0-9_-]*[A-Za-z][A-Za-z0-9_-]*)\]"),
    ("ip", r"\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b"),
    ("ip", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d?\d)\b"),
    ("path", r"(?<!\S)/(?:[^\s/]+/)*[^\s/]+"),
    ("path", r"\b[A-Za-z]:\\(?:[^\s\\]+\\)*[^\s\\]+\b"),
    ("cli", r"--[a-zA-Z][a-zA-Z0-9-]*(?:=[^\s]+)?"),
    ("cli", r"(?<!\w)-[a-zA-Z](?![a-zA-Z0-9])"),
    ("error", rf"\b({LEVELS['error']})\b"),
    ("warning", rf"\b({LEVELS['warning']})\b"),
    ("info", rf"\b({LEVELS['info']})\b"),
    ("debug", rf"\b({LEVELS['debug']})\b"),
)

#: Texts that every match of a pattern holds, whatever the case: one of each group. They are found much faster than the pattern.
REQUIRED = dict(zip((p for _, p in ENTITIES), (
    ("-", ":"), (":",), (":",), ((":", "-"),), ("[", "]"), (":",), (tuple(f"{d}." for d in range(10)),), ("/",), (":\\",), ("--",), ("-",),
)))


def _any_level() -> str:
    """A pattern of the words of all ``LEVELS`` by their first letter."""
    words = sorted({w for ws in LEVELS.values() for w in ws.split("|")})
    heads = sorted({w[0] for w in words})
    each = "|".join(f"{h}(?:{'|'.join(w[1:] for w in words if w[0] == h)})" for h in heads)
    return rf"(?i)\b(?=[{''.join(heads)}][{''.join(sorted({w[1] for w in words}))}])(?:{each})\b"


ANY_LEVEL = _any_level()


def may_hold(line: Column, pattern: str) -> Column | None:
    """Whether a line holds the texts that ``pattern`` requires; None for a pattern without any, as those of ``LEVELS``."""
    groups = [reduce(or_, [line.contains(t) for t in ([g] if isinstance(g, str) else g)]) for g in REQUIRED.get(pattern, ())]
    return reduce(and_, groups) if groups else None


@F.pandas_udf(SPANS)
def entity_spans(lines: pd.Series) -> pd.Series:
    """Entities of each line from left to right; of overlapping ones the earliest, then the shortest. Null: none."""
    compiled = [(kind, re.compile(p, re.I)) for kind, p in ENTITIES]

    def one(line: str | None) -> list[dict]:
        found = sorted((m.start(), m.end(), m[0], kind) for kind, p in compiled for m in p.finditer(line or ""))
        out, end = [], 0
        for a, z, text, kind in found:
            if a >= end:
                out.append({"start": a, "end": z, "text": text, "kind": kind})
                end = z
        return out

    return lines.map(one)
