"""Readers of log files, archives, parsed logs and JSON reports."""

from __future__ import annotations

import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.text import strip_control

PARSED_SCHEMA = "file string, line_no bigint, timestamp timestamp_ntz, loglines string, template string, parameter_list array<string>"
_LINES = "archive string, member string, line_no bigint, line string"
#: Lines of an archive member sent on at once.
_BATCH_LINES = 10_000


def read_log_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of text files as ``file``, ``line_no`` (from 1), ``line``.

    Large files are read in splits. Line numbers come from the splits' own counts plus the
    lines of earlier splits of the file, so that no file has to pass through one task as a
    whole. Undecodable bytes become replacement characters; an end-of-line ``\\r`` is cut.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        F.regexp_replace("value", "\r$", "").alias("line"),
    )
    return number_lines(lines, "path", "block", "id").select("file", "line_no", "line")


def number_lines(lines: DataFrame, group: str, block: str, order: str) -> DataFrame:
    """``line_no`` (from 1) in each group, by block, then ``order``: in two levels, block by block."""
    counts = lines.groupBy(group, block).count()
    before = counts.select(group, block, (F.sum("count").over(Window.partitionBy(group).orderBy(block)) - F.col("count")).alias("_before"))
    inside = lines.withColumn("_inside", F.row_number().over(Window.partitionBy(group, block).orderBy(order)))
    return inside.join(before, [group, block]).withColumn("line_no", (F.col("_before") + F.col("_inside")).cast("bigint")).drop("_before", "_inside")


def read_log_archive(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of the files in ``.tgz`` and ``.tar.gz`` archives; other files pass through as one member.

    An archive whose root holds one folder only is entered there. Members stream through
    memory line by line and are never extracted to disk; undecodable bytes are dropped. One
    task reads an archive. Columns: ``archive``, ``member``, ``line_no``, ``line``.
    """

    def members(data: bytes, name: str):
        import io

        if not name.endswith((".tgz", ".tar.gz")):
            yield name, io.BytesIO(data)
            return
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:gz") as tar:
            roots = {m.name.removeprefix("./").split("/")[0] for m in tar if m.name.strip("./")}
            folder = f"{next(iter(roots))}/" if len(roots) == 1 else ""
        with tarfile.open(fileobj=io.BytesIO(data), mode="r|gz") as tar:
            for m in tar:
                if m.isfile():
                    yield m.name.removeprefix("./").removeprefix(folder), tar.extractfile(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(archive: str, member: str, first: int, lines: list[str]) -> pa.RecordBatch:
            n = len(lines)
            return pa.RecordBatch.from_pydict({"archive": [archive] * n, "member": [member] * n, "line_no": pa.array(range(first, first + n), pa.int64()), "line": pa.array(lines, pa.string())})

        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                archive = path.rsplit("/", 1)[-1]
                for member, stream in members(data, archive):
                    first, lines = 1, []
                    for raw in stream:
                        lines.append(raw.decode("utf-8", "ignore").rstrip("\r\n"))
                        if len(lines) == _BATCH_LINES:
                            yield batch(archive, member, first, lines)
                            first, lines = first + len(lines), []
                    if lines:
                        yield batch(archive, member, first, lines)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, _LINES)


def read_parsed_logs(spark: SparkSession, path: str) -> DataFrame:
    """Parsed logs; an empty table of the same schema where nothing is stored."""
    try:
        return spark.read.schema(PARSED_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], PARSED_SCHEMA)


def reports_of(texts: DataFrame) -> DataFrame:
    """``file``, ``report_id`` (from 1), ``json`` of whole JSON texts (``file``, ``text``).

    Control characters go; undecodable texts are skipped; a list gives a report per element, in its order.
    """
    value = F.try_parse_json(strip_control(F.col("text"), all_of_them=True))
    texts = texts.select("file", value.alias("v")).where("v is not null")
    is_list = F.expr("schema_of_variant(v) like 'ARRAY%'")
    many = texts.where(is_list).select("file", F.posexplode(F.expr("cast(v as array<variant>)")).alias("pos", "v"))
    one = texts.where(~is_list).select("file", F.lit(0).alias("pos"), "v")
    rows = one.unionByName(many).where("schema_of_variant(v) like 'OBJECT%'").select("file", "pos", F.to_json("v").alias("json"))
    return rows.select("file", F.row_number().over(Window.partitionBy("file").orderBy("pos", "json")).alias("report_id"), "json")


def read_json_reports(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Reports of JSON files, one object or a list of objects a file (``reports_of``)."""
    texts = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    return reports_of(texts)
