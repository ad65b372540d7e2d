"""Binary files of token ids compressed by a grammar of frequent id pairs (Re-Pair)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import BLOCK_CHARS, Ragged, blocks, public_path, word_table
from .common import partitions, ship
from .repair import compress, expand, expand_range, rule_lengths

#: Ids in a shard (more where one document alone has more).
SHARD_IDS = 1 << 20

#: One row a shard, in ascending id order. first_id and last_id let Parquet skip shards;
#: doc_symbols and rule_lengths lead to the symbols of a document or of a range of its ids.
SCHEMA = (
    "part int, shard int, vocabulary int, n_ids bigint, first_id bigint, last_id bigint, doc_ids array<bigint>, doc_symbols array<bigint>, doc_tokens array<bigint>, "
    "rules_left binary, rules_right binary, rule_lengths binary, symbols binary, width int"
)


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode texts, append ``end_id`` to each, and write the ids below ``path`` by ascending id.

    Method: documents are range-partitioned and sorted by id; each task encodes its own and
    writes shards of about ``SHARD_IDS`` ids, each with its own Re-Pair grammar (``compress``),
    in which no pair is left that repeats: rules, expansion lengths of the rules, symbols, and
    per document the numbers of symbols and ids, so that any document or id range can be
    decoded alone (``read_range``). ``part`` and ``shard`` order the shards.

    A null text counts as empty. Null ids come first; rows of equal id are ordered by text.
    Other columns are ignored. An empty table writes no shard.
    """
    spark = docs.sparkSession
    ship(spark)
    name = tokenizer or public_path("word_bpe_49k.json")

    def shard(part: int, k: int, doc_ids: list, lens: list[int], ids: list[np.ndarray], vocabulary: int) -> pa.RecordBatch:
        flat = np.concatenate(ids)
        symbols, per_doc, rules = compress(flat, np.array(lens), vocabulary)
        wide = np.uint16 if vocabulary + len(rules) <= 1 << 16 else np.uint32
        known = [d for d in doc_ids if d is not None]
        row = {
            "part": pa.array([part], pa.int32()), "shard": pa.array([k], pa.int32()), "vocabulary": pa.array([vocabulary], pa.int32()), "n_ids": pa.array([len(flat)], pa.int64()),
            "first_id": pa.array([min(known, default=None)], pa.int64()), "last_id": pa.array([max(known, default=None)], pa.int64()),
            "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())), "doc_symbols": pa.array([per_doc], pa.list_(pa.int64())), "doc_tokens": pa.array([lens], pa.list_(pa.int64())),
            "rules_left": pa.array([rules[:, 0].tobytes()]), "rules_right": pa.array([rules[:, 1].tobytes()]), "rule_lengths": pa.array([rule_lengths(rules, vocabulary).astype(np.uint32).tobytes()]),
            "symbols": pa.array([symbols.astype(wide).tobytes()]), "width": pa.array([wide().itemsize], pa.int32()),
        }
        return pa.RecordBatch.from_pydict(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, end = word_table(name), np.array([end_id], np.uint32)
        vocabulary = len(table.ends)
        part, k, size = TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        lens: list[int] = []
        ids: list[np.ndarray] = []
        for batch in batches:
            for first, texts in blocks(batch, "text", 2 * BLOCK_CHARS):  # fewer lookups, as a word is looked up once a block
                names = batch.column("id").slice(first, len(texts)).to_pylist()
                for doc, found in zip(names, table.encode(texts)):
                    doc_ids.append(doc)
                    lens.append(len(found) + 1)
                    ids += [found, end]
                    size += lens[-1]
                    if size >= SHARD_IDS:
                        yield shard(part, k, doc_ids, lens, ids, vocabulary)
                        k, size, doc_ids, lens, ids = k + 1, 0, [], [], []
        if lens:
            yield shard(part, k, doc_ids, lens, ids, vocabulary)

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(partitions(spark), "id").sortWithinPartitions("id", "text")
    rows.mapInArrow(run, SCHEMA).write.parquet(path)


def _grammar(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Symbols, rules, stored rule lengths and vocabulary of a shard."""
    rules = np.stack([np.frombuffer(row["rules_left"], np.uint32), np.frombuffer(row["rules_right"], np.uint32)], 1)
    symbols = np.frombuffer(row["symbols"], np.uint16 if row["width"] == 2 else np.uint32)
    return symbols, rules, np.frombuffer(row["rule_lengths"], np.uint32).astype(np.int64), row["vocabulary"]


def read_range(spark: SparkSession, path: str, doc_id: int, start: int = 0, length: int | None = None) -> DataFrame:
    """``doc_id`` and ``ids``: those from position ``start`` on of one document (``length`` of them, at most to its end).

    Parquet statistics lead to the shard, symbol counts to the document's symbols, and stored
    expansion lengths to those that cover the range; no other symbol is expanded. Rows of
    equal id give a row each; an unknown id gives none.
    """
    ship(spark)
    rows = spark.read.schema(SCHEMA).parquet(path).where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                symbols, rules, lengths, vocabulary = _grammar(row)
                stops = np.cumsum(row["doc_symbols"])
                for k in [k for k, d in enumerate(row["doc_ids"]) if d == doc_id]:
                    mine, n = symbols[stops[k] - row["doc_symbols"][k] : stops[k]], row["doc_tokens"][k]
                    a = min(start, n)
                    found = expand_range(mine, rules, lengths, vocabulary, a, n - a if length is None else min(length, n - a))
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_id], pa.int64()), "ids": pa.array([found], pa.list_(pa.int32()))})

    return rows.mapInArrow(run, "doc_id bigint, ids array<int>")


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """The documents of the files below ``path``, decoded from their shards.

    Returns ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``,
    ``ids_crc32``; with ``with_ids`` also ``ids``.
    """
    ship(spark)
    shards = spark.read.schema(SCHEMA).parquet(path)
    schema = "part int, shard int, doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = expand(*_grammar(row))
                lens = np.array(row["doc_tokens"], np.int64)
                if len(ids) != lens.sum():
                    raise ValueError("a shard does not decode to its number of ids")
                found = list(Ragged(ids.astype("<u4"), lens))
                out = {
                    "part": pa.array([row["part"]] * len(lens), pa.int32()), "shard": pa.array([row["shard"]] * len(lens), pa.int32()),
                    "doc_id": pa.array(row["doc_ids"], pa.int64()), "within": np.cumsum(lens) - lens, "n_tokens": lens,
                    "ids_crc32": pa.array([zlib.crc32(x) for x in found], pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.array(found, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    # Two levels, so that only one row a part meets in one task.
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))
    sums = shards.select("part", "shard", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")).alias("before_shard"))
    before = sums.join(parts, "part").select("part", "shard", (F.col("before_part") + F.col("before_shard")).alias("before"))
    columns = ["doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"]
    return shards.mapInArrow(run, schema).join(before, ["part", "shard"]).select(*columns, *(["ids"] if with_ids else []))
