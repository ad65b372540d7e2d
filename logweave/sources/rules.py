"""The rule catalogue: categories, issues, files and patterns."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_REGEX = "struct<type:string,pattern:string,description:string>"
CATALOGUE = f"map<string,array<struct<Title:string,Cause:string,CPELogs:array<struct<FileName:string,Regex:array<{_REGEX}>>>>>>"
FLAT = "category string, title string, cause string, file_name string, file_key string, type string, pattern string, description string"


def flatten_rules(texts: DataFrame) -> DataFrame:
    """One row per pattern of catalogues given as JSON in ``text``; a bad catalogue has none.

    Issues, files and categories without patterns keep a row with a null pattern, missing
    keys become empty. ``file_key`` is the file name in lower case, trimmed.
    """
    held = texts.select(F.from_json("text", CATALOGUE).alias("c")).where("c is not null")
    issues = held.select(F.explode_outer("c").alias("category", "issues")).select("category", F.explode_outer("issues").alias("i"))
    files = issues.select("category", F.coalesce("i.Title", F.lit("")).alias("title"), F.coalesce("i.Cause", F.lit("")).alias("cause"), F.explode_outer("i.CPELogs").alias("f"))
    rows = files.select("category", "title", "cause", F.coalesce("f.FileName", F.lit("")).alias("file_name"), F.explode_outer("f.Regex").alias("r"))
    return rows.select(
        "category", "title", "cause", "file_name", F.lower(F.trim("file_name")).alias("file_key"),
        F.coalesce("r.type", F.lit("")).alias("type"), F.col("r.pattern").alias("pattern"), F.coalesce("r.description", F.lit("")).alias("description"),
    )


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """``flatten_rules`` of the catalogue file(s) below ``path``."""
    return flatten_rules(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"))


def validate_catalogue(texts: DataFrame) -> DataFrame:
    """``text`` and ``problem`` of catalogues whose root is no object or has a value that is no list."""
    v = F.try_parse_json("text")
    kind = F.schema_of_variant(v)
    lists = F.forall(F.map_values(F.from_json("text", "map<string,string>")), lambda x: F.coalesce(F.ltrim(x).startswith("["), F.lit(False)))
    problem = F.when(v.isNull(), "no JSON").when(~kind.startswith("OBJECT"), "no object").when(~lists, "a category is no list")
    return texts.select("text", problem.alias("problem")).where("problem is not null")


def validate_rules(rules: DataFrame) -> DataFrame:
    """The rules whose pattern does not compile, with ``problem``. The catalogue is small and read by the driver."""
    bad = []
    for r in rules.where("pattern is not null").select("pattern").distinct().collect():
        if problem := pattern_problem(rules.sparkSession, r["pattern"]):
            bad.append((r["pattern"], problem))
    return rules.join(F.broadcast(rules.sparkSession.createDataFrame(bad, "pattern string, problem string")), "pattern")


def pattern_problem(spark: SparkSession, pattern: str) -> str | None:
    """Why Spark cannot use a pattern; None if it can."""
    compiler = spark.sparkContext._jvm.java.util.regex.Pattern
    try:
        compiler.compile(pattern)
    except Exception as e:  # the JVM's own message
        return re.sub(r"\s+", " ", str(getattr(e, "java_exception", e)))[:200]
    return None
