"""Media payloads stored as content-defined chunks, each distinct chunk once."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import blocks
from .common import ship
from .words import mix

#: Samples of a frame; the payload is padded to a positive multiple of it.
FRAME, PAD = 576, 255
#: Bytes of a chunk: at least, at most, and about (a power of two) between cuts.
LEAST, MOST, ABOUT = 256, 8192, 1024
#: Bits of the bitmap that names chunks which may stand in several places: a fixed 8 MB.
BITMAP_BITS = 26
_GEAR = (mix(np.arange(256, dtype=np.uint64) + np.uint64(0xC0FFEE)) >> np.uint64(32)).astype(np.uint32)

#: A chunk that stands in more than a HOT-th of all places is looked up without a shuffle; there are fewer than HOT such, of at most MOST bytes.
HOT = 1024

#: media: the media file, a header and the ordered chunk list; samples: the bytes of its
#: chunks, null for those in ``chunks``, whose digests stand in ``shared``.
STORE = "row bigint, doc_id bigint, media binary, samples array<binary>, shared array<binary>"
_HEADER, _ENTRY = "<4sQI", "<I32s"


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling gear hash at each byte: the sum over the last 32 bytes of their numbers, shifted by their age."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        shifted = np.zeros_like(h)
        shifted[k:] = h[:-k] << np.uint32(k)
        h += shifted
    return h


def cuts(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each payload ``data[start:stop]``; they depend on the payload alone.

    A cut follows a byte where the top bits of the rolling hash are 0, at the first such byte
    from ``LEAST`` bytes on, or after ``MOST`` bytes.
    """
    marks = np.flatnonzero(gear(data) < np.uint32(2**32 // ABOUT)) + 1 if len(data) else np.zeros(0, np.int64)
    first, last = np.searchsorted(marks, starts), np.searchsorted(marks, stops)
    out = []
    for a, z, i, j in zip(starts.tolist(), stops.tolist(), first.tolist(), last.tolist()):
        ends, at = [], a
        for m in marks[i:j].tolist():
            while m - at > MOST:
                at += MOST
                ends.append(at)
            if m - at >= LEAST:
                at = m
                ends.append(at)
        while z - at > MOST:
            at += MOST
            ends.append(at)
        if z > at:
            ends.append(z)
        out.append(ends)
    return out


def payloads(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All payloads of a block end to end, their starts and stops, and the bytes before padding."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts.to_pylist()]
    n = np.fromiter(map(len, raw), np.int64, len(raw))
    size = np.maximum(-(-n // FRAME), 1) * FRAME
    stops = np.cumsum(size)
    data = b"".join([r + bytes([PAD]) * int(s - len(r)) for r, s in zip(raw, size)])
    return np.frombuffer(data, np.uint8), stops - size, stops, n


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, list[list[tuple[bytes, bytes]]]]]:
    """Ids, unpadded sizes and (digest, bytes) of the chunks, block by block."""
    for batch in batches:
        for first, texts in blocks(batch, "text"):
            data, starts, stops, n = payloads(texts)
            held = memoryview(data)
            rows = []
            for a, ends in zip(starts.tolist(), cuts(data, starts, stops)):
                parts = [bytes(held[x:y]) for x, y in zip([a, *ends], ends)]
                rows.append([(hashlib.sha256(p).digest(), p) for p in parts])
            ids = batch.column("doc_id").slice(first, len(texts)).to_pylist() if "doc_id" in batch.schema.names else []
            yield ids, n, rows


def _listed(n: int, parts: list[tuple[bytes, bytes]]) -> bytes:
    """The media file of a payload: magic, unpadded bytes, number of chunks, and per chunk its size and digest."""
    return struct.pack(_HEADER, b"CDC8", n, len(parts)) + b"".join([struct.pack(_ENTRY, len(p), d) for d, p in parts])


def _bit(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little") >> (64 - BITMAP_BITS)


def _repeated(texts: DataFrame) -> np.ndarray:
    """Bitmap (64 bits a number) with the bit of every chunk digest that occurs more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, rows in _chunked(batches):
            names = [int.from_bytes(d[:8], "little", signed=True) for row in rows for d, _ in row]
            yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.int64())})

    several = texts.mapInArrow(run, "name bigint").groupBy("name").count().where("count > 1")
    several = several.select(F.shiftrightunsigned("name", 64 - BITMAP_BITS).alias("bit"))
    word = several.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    found = word.toArrow()  # at most 2**(BITMAP_BITS - 6) rows of 16 bytes
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint64)


def write_media(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Store texts as 8-bit samples below ``path``: ``rows`` (ordered chunk lists) and ``chunks``.

    Method: payloads are cut by a rolling gear hash. Spark counts the chunk digests; the
    digests that occur more than once set bits of a bitmap of fixed size, which is broadcast.
    A chunk whose bit is not set stands in one place and is stored inside its row; all others
    are shuffled by digest and stored once, in ``chunks``. A bit set by another digest only
    moves a chunk from its row to ``chunks``; nothing depends on the bitmap's load.

    Null text counts as empty; rows of any id, null or repeated, are stored each; an empty
    table gives empty ones; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    repeated = spark.sparkContext.broadcast(_repeated(rows.select("text")))

    def shared(digest: bytes) -> bool:
        k = _bit(digest)
        return bool((int(repeated.value[k >> 6]) >> (k & 63)) & 1)

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, found in _chunked(batches):
            own: dict[bytes, list] = {}
            for row in found:
                for d, p in row:
                    if shared(d):
                        own.setdefault(d, [p, 0])[1] += 1
            yield pa.RecordBatch.from_pydict({"digest": pa.array(own.keys(), pa.binary()), "samples": pa.array([p for p, _ in own.values()], pa.binary()), "places": pa.array([n for _, n in own.values()], pa.int64())})

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for ids, n, found in _chunked(batches):
            out = {
                "row": pa.array(np.arange(row, row + len(ids))),
                "doc_id": pa.array(ids, pa.int64()),
                "media": pa.array([_listed(k, r) for k, r in zip(n.tolist(), found)], pa.binary()),
                "samples": pa.array([[None if shared(d) else p for d, p in r] for r in found], pa.list_(pa.binary())),
                "shared": pa.array([[d if shared(d) else None for d, _ in r] for r in found], pa.list_(pa.binary())),
            }
            row += len(ids)
            yield pa.RecordBatch.from_pydict(out)

    once = rows.select("text").mapInArrow(several, "digest binary, samples binary, places bigint").groupBy("digest").agg(F.first("samples").alias("samples"), F.sum("places").alias("places"))
    once.write.option("compression", "zstd").parquet(f"{path}/chunks")
    rows.mapInArrow(stored, STORE).write.option("compression", "zstd").parquet(f"{path}/rows")


def read_media(spark: SparkSession, path: str, with_samples: bool = False) -> DataFrame:
    """Payloads put together from their ordered chunk lists, each chunk checked by its digest.

    Rows without shared chunks need no shuffle; for the others, chunk references are joined
    with ``chunks`` by digest and grouped by row (one payload's chunks). Chunks that stand in
    very many places (that of all empty texts) are broadcast: fewer than ``HOT``, of at most
    ``MOST`` bytes.

    Returns ``doc_id``, ``n_bytes``, ``payload_bytes``, ``payload_sha256``, ``tail_crc32``,
    ``media_bytes`` and ``media_sha256`` (the stored bytes of the document: its media file,
    then its chunks in order), ``feature``; with ``with_samples`` also ``payload``. An empty
    table gives an empty result.
    """
    ship(spark)
    store = spark.read.schema(STORE).parquet(f"{path}/rows")
    chunks = spark.read.schema("digest binary, samples binary, places bigint").parquet(f"{path}/chunks")
    absent = F.exists("shared", lambda x: x.isNotNull())
    names = store.where(absent).select("row", F.posexplode("shared").alias("at", "digest")).where("digest is not null")
    total = chunks.agg(F.sum("places")).first()[0] or 0
    hot = chunks.where(F.col("places") > total / HOT).select("digest", F.col("samples").alias("hot"))
    names = names.join(F.broadcast(hot), "digest", "left")  # fewer than HOT rows of at most MOST bytes
    found = names.where("hot is not null").select("row", "at", F.col("hot").alias("samples"))
    found = found.union(names.where("hot is null").join(chunks.select("digest", "samples"), "digest").select("row", "at", "samples"))
    found = found.groupBy("row").agg(F.collect_list(F.struct("at", "samples")).alias("found"))
    whole = store.where(~absent).withColumn("found", F.lit(None).cast("array<struct<at:int,samples:binary>>"))
    whole = whole.union(store.where(absent).join(found, "row", "left").select(*store.columns, "found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "payload")}
            for listed, samples, extra in zip(*(batch.column(c).to_pylist() for c in ("media", "samples", "found"))):
                magic, n, count = struct.unpack_from(_HEADER, listed)
                if magic != b"CDC8" or len(listed) != struct.calcsize(_HEADER) + count * struct.calcsize(_ENTRY):
                    raise ValueError("a media file is damaged")
                for x in extra or ():
                    samples[x["at"]] = x["samples"]
                for (size, d), p in zip(struct.iter_unpack(_ENTRY, listed[struct.calcsize(_HEADER) :]), samples, strict=True):
                    if p is None or len(p) != size or hashlib.sha256(p).digest() != d:
                        raise ValueError("a chunk is missing or damaged")
                payload = b"".join(samples)
                media = hashlib.sha256(listed)
                media.update(payload)
                counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
                share = counts[counts > 0] / len(payload)
                mean = float(counts @ np.arange(256)) / len(payload)
                out["n_bytes"].append(n)
                out["payload_bytes"].append(len(payload))
                out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                out["tail_crc32"].append(zlib.crc32(payload[-32:]))
                out["media_bytes"].append(len(listed) + len(payload))
                out["media_sha256"].append(media.hexdigest())
                out["feature"].append(f"chunks={count} mean={mean:.4f} entropy={-float(share @ np.log2(share)) + 0.0:.4f}")
                out["payload"].append(payload if with_samples else None)
            columns = {"doc_id": batch.column("doc_id")}
            columns |= {k: pa.array(out[k], pa.int64()) if k in ("n_bytes", "payload_bytes", "tail_crc32", "media_bytes") else pa.array(out[k], pa.binary() if k == "payload" else pa.string()) for k in out if k != "payload" or with_samples}
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string" + (", payload binary" if with_samples else "")
    return whole.mapInArrow(run, schema)
