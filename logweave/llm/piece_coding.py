"""Encoding and decoding with a sentencepiece model by a table of distinct marked words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import TABLE_CHUNKS, blocks, piece_table, public_path
from .common import ship


def encode_pieces(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, table_chunks: int = TABLE_CHUNKS) -> DataFrame:
    """Ids of each text, and the text decoded from them.

    Method: pieces of the model never cross a blank, so each distinct blank-marked word is
    segmented once per task and its ids are joined back by position; the decoded text is
    joined from the words' decoded forms in the same way. The table is bounded by
    ``table_chunks`` and is refilled beyond it, which changes no result. There is no shuffle.

    Returns id, ``n_tokens``, ``ids_sha256`` (decimal ids joined by commas),
    ``decoded_sha256``; with ``with_ids`` also ``ids`` (array<int>) and ``decoded``.
    A null text counts as empty: no ids, empty decoded text. Repeated rows and null ids are
    kept as they are. Other columns are ignored, whatever their names. An empty table gives
    an empty result.
    """
    ship(docs.sparkSession)
    path = model or public_path("piece_bpe_32k.model")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(path, table_chunks)
        for batch in batches:
            for first, texts in blocks(batch, text_col):
                ids, decoded = table.encode(texts)
                digits = table.decimal.take(ids.flat).merge(ids.lens)
                out = {
                    id_col: batch.column(id_col).slice(first, len(texts)),
                    "n_tokens": pa.array(ids.lens),
                    "ids_sha256": pa.array([hashlib.sha256(x[:-1]).hexdigest() for x in digits], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(x[1:]).hexdigest() for x in decoded], pa.string()),
                }
                if with_ids:
                    out["ids"] = pa.array(list(ids), pa.list_(pa.int32()))
                    out["decoded"] = pa.array([x[1:].tobytes().decode() for x in decoded], pa.string())
                yield pa.RecordBatch.from_pydict(out)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
