"""Catalogue tables: users, projects and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

USERS = "id int, username string, email string, is_admin boolean, created_at timestamp_ntz, last_login timestamp_ntz"
PROJECTS = "id string, user_id int, name string, description string, created_at timestamp_ntz, last_accessed timestamp_ntz"
FILES = "id int, project_id string, filename string, original_name string, file_path string, file_size int, uploaded_at timestamp_ntz"


def read_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables ``users``, ``projects`` and ``files`` below ``path``."""
    return tuple(spark.read.schema(s).parquet(f"{path}/{t}") for t, s in (("users", USERS), ("projects", PROJECTS), ("files", FILES)))


def project_files(files: DataFrame, project_id: str | None = None) -> DataFrame:
    """Files (of one project) by their original name in lower case, then id."""
    held = files if project_id is None else files.where(F.col("project_id") == project_id)
    return held.orderBy(F.lower("original_name"), "id")
