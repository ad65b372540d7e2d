"""Packing of token sequences into windows of near-equal fill by multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .chunks import blocks, give_back, public_path, word_table
from .common import ship

#: Tokens packed together. A larger shard saves at most one partly filled window a shard.
SHARD_TOKENS = 1_000_000
#: Pieces longer than this are cut, so that a window always holds several pieces to balance.
PIECE_TOKENS = 384
#: Characters encoded at once: fewer than elsewhere, since this is the pipeline's last stage and workers hold what others left.
BLOCK_CHARS = 1_000_000


def differencing(sizes: np.ndarray, ways: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp differencing of ``sizes`` into ``ways`` parts, in its balanced form.

    Each partial partition is a row of ``ways`` sums. At first, rows are made of ``ways``
    neighbours in descending order (what merging single sizes by spread leads to). Then the
    two rows of the largest spread (largest less smallest sum) are merged again and again,
    the largest sums of one with the smallest of the other, so that their imbalances oppose.

    Returns the part of each size and the parts' sums. Ties are taken in input order.
    """
    n = len(sizes)
    order = np.argsort(-sizes, kind="stable")
    rows = -(-n // ways) if n else 0
    padded = np.full(rows * ways, -1, np.int64)
    padded[:n] = order
    heap = []
    for k, items in enumerate(padded.reshape(rows, ways)):
        sums = np.where(items >= 0, sizes[items], 0)
        heap.append((int(sums[-1] - sums[0]), k, sums, items[:, None]))
    heapq.heapify(heap)
    k = rows
    while len(heap) > 1:
        _, _, a, left = heapq.heappop(heap)
        _, _, b, right = heapq.heappop(heap)
        sums = a + b[::-1]
        by = np.argsort(-sums, kind="stable")
        sums, items = sums[by], np.concatenate([left, right[::-1]], 1)[by]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), k, sums, items))
        k += 1
    part, sums = np.zeros(n, np.int64), np.zeros(ways, np.int64)
    if heap:
        _, _, sums, items = heap[0]
        where = np.repeat(np.arange(ways), items.shape[1])
        flat = items.ravel()
        part[flat[flat >= 0]] = where[flat >= 0]
    return part, sums


def pack(lengths: np.ndarray, window: int, piece: int = PIECE_TOKENS) -> dict[str, np.ndarray]:
    """Cut texts of ``lengths`` tokens into pieces and place them in windows.

    Runs of ``window`` tokens fill a window each; the rest of each text is cut into pieces of
    at most ``piece`` tokens, partitioned by differencing into as few windows as could hold
    them. Whenever a window's sum exceeds its capacity, the number of windows rises by one.

    Returns per piece ``text``, ``start``, ``length``, ``window``, ``offset``.
    """
    full, rest = lengths // window, lengths % window
    small = -(-rest // piece)
    text = np.concatenate([np.repeat(np.arange(len(lengths)), full), np.repeat(np.arange(len(lengths)), small)])
    nth = np.concatenate([np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full), np.arange(small.sum()) - np.repeat(np.cumsum(small) - small, small)])
    n = int(full.sum())
    start = nth * window
    start[n:] = full[text[n:]] * window + nth[n:] * piece
    length = np.full(len(text), window)
    length[n:] = np.minimum(piece, lengths[text[n:]] - start[n:])
    ways = max(1, -(-int(length[n:].sum()) // window))
    part, sums = differencing(length[n:], ways)
    while len(sums) and sums.max() > window:
        ways += 1
        part, sums = differencing(length[n:], ways)
    place = np.concatenate([np.arange(n), n + part])
    order = np.lexsort((start, text, place))
    before = np.cumsum(length[order]) - length[order]
    first = np.concatenate([[True], np.diff(place[order]) != 0]) if len(order) else np.zeros(0, bool)
    offset = np.zeros(len(order), np.int64)
    offset[order] = before - np.maximum.accumulate(np.where(first, before, 0)) if len(order) else 0
    return {"text": text, "start": start, "length": length, "window": place, "offset": offset}


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, window: int = 2048, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS, with_ids: bool = False) -> DataFrame:
    """Tokenise documents, append ``end_id`` to each, and pack them into windows.

    Method: each task packs its own documents in shards of about ``shard_tokens`` tokens by
    Karmarkar-Karp multiway differencing (``differencing``); the windows of a shard are near
    equal and their number rises whenever the capacity is exceeded. Nothing is shuffled, so
    one source or one very long document costs no more than its share. ``sequence_id`` is
    the partition's number times 2**40 plus a running number: unique, with gaps, and the
    same when a lost task runs again over the same input.

    Returns per piece the id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset``; with ``with_ids`` the piece's ``ids``. A null or empty text
    is one piece, the end id. Repeated rows are packed each. Other columns are ignored.
    An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    path = tokenizer or public_path("word_bpe_49k.json")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + (", ids array<int>" if with_ids else "")

    def packed(names: list, ids: list[np.ndarray], base: int) -> tuple[pa.RecordBatch, int]:
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        p = pack(lengths, window)
        cuts = [ids[t][s : s + n] for t, s, n in zip(p["text"].tolist(), p["start"].tolist(), p["length"].tolist())]
        out = {
            id_col: pa.concat_arrays(names).take(pa.array(p["text"])),
            "start": p["start"],
            "length": p["length"],
            "ids_crc32": pa.array([zlib.crc32(c) for c in cuts], pa.int64()),
            "doc_tokens": lengths[p["text"]],
            "sequence_id": base + p["window"],
            "offset": p["offset"],
        }
        if with_ids:
            out["ids"] = pa.array(cuts, pa.list_(pa.int32()))
        return pa.RecordBatch.from_pydict(out), int(p["window"].max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        table, end = word_table(path), np.array([end_id], np.uint32)
        base = TaskContext.get().partitionId() << 40
        names: list = []
        ids: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for first, texts in blocks(batch, text_col, BLOCK_CHARS):
                for found in table.encode(texts):
                    ids.append(np.concatenate([found, end]))
                    size += len(ids[-1])
                names.append(batch.column(id_col).slice(first, len(texts)))
                if size >= shard_tokens:
                    out, used = packed(names, ids, base)
                    yield out
                    base, names, ids, size = base + used, [], [], 0
                    give_back()
        if ids:
            yield packed(names, ids, base)[0]

    return docs.select(id_col, text_col).mapInArrow(run, schema)
