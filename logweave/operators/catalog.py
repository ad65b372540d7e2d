"""Catalogue of users, projects and files: filters and rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import size_mb

#: Suffixes and parts of names of files that are not parsed. Fixed values.
SKIPPED_SUFFIXES = (".xls", ".xlsx", ".tgz", ".zip")
SKIPPED_NAMES = ("telemetry2", "snapshot", "selfheal")


def eligible_files(files: DataFrame) -> DataFrame:
    """Files (``file``, ``original_name``, ``file_size``) to parse: with content, of a kind that is text, no report or snapshot."""
    name = F.lower(F.coalesce("original_name", F.lit("")))
    keep = F.coalesce(F.col("file_size") > 0, F.lit(False))
    for s in SKIPPED_SUFFIXES:
        keep = keep & ~F.col("file").endswith(s)
    for s in SKIPPED_NAMES:
        keep = keep & ~name.contains(s)
    return files.where(keep)


def viewable_files(files: DataFrame) -> DataFrame:
    """Files with content, with ``size_mb`` and ``is_viewable`` (by suffix)."""
    viewable = F.lit(True)
    for s in SKIPPED_SUFFIXES:
        viewable = viewable & ~F.lower("file").endswith(s)
    return files.where("file_size > 0").select("*", size_mb(F.col("file_size")).alias("size_mb"), viewable.alias("is_viewable"))


def unprocessed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that the manifest (``file``, ``state``) does not name as queued, parsed or indexed."""
    return files.join(manifest.where(F.col("state").isin("queued", "parsed", "indexed")), "file", "left_anti")


def route_by_name(files: DataFrame, index: DataFrame) -> DataFrame:
    """The configuration of the first index row (``position``, ``supported``, ``config``) whose name a file's name contains.

    The index is a short list kept by hand; Spark broadcasts it if it is small. Files without
    a match have a null configuration.
    """
    hits = files.select("file").distinct().join(index, F.lower("file").contains(F.lower(F.col("supported")))).groupBy("file").agg(F.min_by("config", "position").alias("config"))
    return files.join(hits, "file", "left")


def project_rollup(projects: DataFrame, files: DataFrame) -> DataFrame:
    """Projects with ``file_count`` and ``total_size``, the last accessed first."""
    sums = files.groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("file_count"), F.sum("file_size").alias("total_size"))
    rows = projects.join(sums, "id", "left").withColumns({"file_count": F.coalesce("file_count", F.lit(0)), "total_size": F.coalesce("total_size", F.lit(0))})
    return rows.orderBy(F.desc("last_accessed"), "id")


def user_rollup(users: DataFrame, projects: DataFrame, files: DataFrame) -> DataFrame:
    """Users with ``project_count`` and ``file_count``, the latest first."""
    per_project = files.groupBy("project_id").agg(F.count("*").alias("n"))
    owned = projects.select(F.col("id").alias("project_id"), "user_id").join(per_project, "project_id", "left")
    sums = owned.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("project_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("file_count"))
    rows = users.join(sums, "id", "left").withColumns({"project_count": F.coalesce("project_count", F.lit(0)), "file_count": F.coalesce("file_count", F.lit(0))})
    return rows.orderBy(F.desc("created_at"), "id")


def system_stats(rollup: DataFrame) -> DataFrame:
    """Users, administrators, projects and files of a user rollup."""
    return rollup.agg(F.count("*").alias("users"), F.count_if("is_admin").alias("admins"), F.coalesce(F.sum("project_count"), F.lit(0)).alias("projects"), F.coalesce(F.sum("file_count"), F.lit(0)).alias("files"))


def pipeline_status(manifest: DataFrame) -> DataFrame:
    """Files per state, and whether all are done (indexed or failed)."""
    states = manifest.groupBy("state").agg(F.count("*").alias("files"))
    done = manifest.agg((F.coalesce(F.bool_and(F.col("state").isin("indexed", "error")), F.lit(False))).alias("all_done"))
    return states.crossJoin(F.broadcast(done))  # one row


def status_by_name(manifest: DataFrame) -> DataFrame:
    """Files (``file``, ``state``) with whether each is done (indexed or failed), by name."""
    return manifest.select("file", "state", F.col("state").isin("indexed", "error").alias("done")).orderBy("file", "state")
