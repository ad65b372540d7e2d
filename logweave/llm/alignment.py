"""Alignment of two tokenizers' tokens over the same bytes, by Arrow's own list, table and join functions.

Texts of a block lie one behind the other, so a running sum of token lengths gives every
token's end in the block, and an end that both tokenizers share is a key of an Acero join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Keys, PieceTable, Ragged, _distinct, blocks, public_path
from .common import discard, materialise, ship

#: Pairs of ids that tasks look up in a broadcast table at most; all others are joined by Spark.
HOT_PAIRS = 1_000_000
#: Bytes of text encoded at once, and aligned at once.
BLOCK_BYTES, ALIGN_BYTES = 2_000_000, 250_000
#: Chunks kept by one task for each tokenizer; at the bound a table starts anew, which changes no result.
TABLE_CHUNKS = 300_000
#: Chunks that the byte-level tokenizer gets as one text.
GROUP = 256
#: Rows of partial counts that a task holds before it merges them.
MERGE_ROWS = 2_000_000
_SPACE = r"[\s\v\x{85}\p{Z}]"


def _byte_alphabet() -> dict[str, int]:
    """The byte of each character of byte-level vocabularies: printable characters stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _faithful(ids: Ragged, entries: Ragged, chunks: list[str]) -> np.ndarray:
    """Whether the bytes of each row of ids are those of a blank and its chunk."""
    raw = [(" " + t).encode() for t in chunks]
    found = entries.take(ids.flat).merge(ids.lens)
    if np.array_equal(found.lens, np.fromiter(map(len, raw), np.int64, len(raw))) and np.array_equal(found.flat, np.frombuffer(b"".join(raw), np.uint8)):
        return np.ones(len(raw), bool)
    return np.array([x.tobytes() == r for x, r in zip(found, raw)], bool)


class ByteTable:
    """Token ids of texts, with a blank in front, under a byte-level tokenizer of the tokenizers library.

    Its text splitting always cuts in front of a blank, unless white space stands on both
    sides of it; texts with such a blank are looked up whole.
    """

    def __init__(self, path: str, limit: int = TABLE_CHUNKS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        alphabet = _byte_alphabet()
        vocab = self.tokenizer.get_vocab()
        self.entries = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            self.entries[k] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.bytes = Ragged.of(self.entries, np.uint8)
        self.sizes = self.bytes.lens
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.rows = Keys([])
        self.ids = Ragged(np.zeros(0, np.int32), np.zeros(0, np.int64))
        self.good = np.zeros(0, bool)

    def _together(self, words: list[str]) -> Ragged:
        """Ids of chunks that begin with no white space: behind one another they are split where they meet."""
        found = [np.zeros(0, np.int32)]
        for at in range(0, len(words), 32 * GROUP):  # the library's answers are large
            groups = [" " + " ".join(words[k : min(k + GROUP, at + 32 * GROUP)]) for k in range(at, min(len(words), at + 32 * GROUP), GROUP)]
            found += [np.array(x.ids, np.int32) for x in self.tokenizer.encode_batch_fast(groups, add_special_tokens=False)]
        ids = np.concatenate(found)
        ends = np.cumsum(self.sizes[ids])
        want = np.cumsum([len(w.encode()) + 1 for w in words])
        stops = np.searchsorted(ends, want) + 1
        if len(words) and (stops[-1] != len(ids) or not np.array_equal(ends[stops - 1], want)):
            raise ValueError("the tokenizer joins chunks across a blank")
        return Ragged(ids, np.diff(stops, prepend=0))

    def _add(self, new: list[str]) -> None:
        plain = np.fromiter((bool(t) and not t[0].isspace() for t in new), bool, len(new))
        words, others = [t for t, p in zip(new, plain) if p], [t for t, p in zip(new, plain) if not p]
        rest = Ragged.of([x.ids for x in self.tokenizer.encode_batch_fast([" " + t for t in others], add_special_tokens=False)], np.int32)
        order = np.where(plain, np.cumsum(plain) - 1, len(words) + np.cumsum(~plain) - 1)
        ids = self._together(words).add(rest).take(order)
        self.ids = self.ids.add(ids)
        self.good = np.concatenate([self.good, _faithful(ids, self.bytes, new)])

    def encode(self, texts: pa.Array) -> tuple[Ragged, np.ndarray]:
        """The ids of a blank and each text, and whether their bytes are those of the text."""
        if len(self.rows) > self.limit:
            self._clear()
        odd = pc.match_substring_regex(texts, f"(?:^|{_SPACE}) (?:{_SPACE}|$)")
        lists = pc.split_pattern(texts, " ")
        if pc.any(odd).as_py():
            split = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            which = odd.to_numpy(zero_copy_only=False)
            values = pc.if_else(pa.array(np.repeat(which, split)), None, lists.flatten()).drop_null()
            whole, counts = texts.filter(odd), np.where(which, 1, split)
            at = np.concatenate([self._places(values), self._places(whole)])
            order = np.argsort(np.concatenate([np.repeat(np.flatnonzero(~which), split[~which]), np.flatnonzero(which)]), kind="stable")
            at = at[order]
        else:
            at, counts = self._places(lists.flatten()), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        counts = counts.astype(np.int64)
        good = np.ones(len(texts), bool)
        np.logical_and.at(good, np.repeat(np.arange(len(texts)), counts), self.good[at])
        return self.ids.take(at).merge(counts), good

    def _places(self, values: pa.Array) -> np.ndarray:
        chunks, at = _distinct(values)
        return self.rows.places(chunks, self._add)[at] if len(chunks) else np.zeros(0, np.int64)


class MarkedTable(PieceTable):
    """Ids under a sentencepiece model, with the bytes of its pieces checked against each chunk."""

    def __init__(self, path: str, limit: int = TABLE_CHUNKS):
        super().__init__(path, limit)
        n = self.sp.get_piece_size()
        byte = [self.sp.is_byte(k) for k in range(n)]
        pieces = [self.sp.id_to_piece(k) for k in range(n)]
        self.entries = [bytes([int(p[3:5], 16)]) if b else p.replace(self.MARK, " ").encode() for p, b in zip(pieces, byte)]
        self.bytes = Ragged.of(self.entries, np.uint8)
        self.sizes = self.bytes.lens

    def _clear(self) -> None:
        self.rows = Keys([])
        self.ids = Ragged(np.zeros(0, np.int32), np.zeros(0, np.int64))
        self.good = np.zeros(0, bool)

    def _add(self, new: list[str]) -> None:
        # One blank on its own is what remains of a text's last blank.
        ids = Ragged.of([x if c else [self.blank] for c, x in zip(new, self.sp.encode(new, num_threads=1))], np.int32)
        self.ids = self.ids.add(ids)
        self.good = np.concatenate([self.good, _faithful(ids, self.bytes, new)])

    def encode(self, texts: pa.Array) -> tuple[Ragged, np.ndarray]:
        """The ids of each text, and whether their bytes are those of a blank and the text."""
        if len(self.rows) > self.limit:
            self._clear()
        values, counts = self._cut(texts)
        chunks, at = _distinct(values)
        row = self.rows.places(chunks, self._add)[at] if len(chunks) else np.zeros(0, np.int64)
        good = ~pc.match_substring(texts, self.MARK).to_numpy(zero_copy_only=False) & (counts > 0)
        np.logical_and.at(good, np.repeat(np.arange(len(texts)), counts), self.good[row])
        return self.ids.take(row).merge(counts), good


@lru_cache(maxsize=1)
def _tables(first: str, second: str) -> tuple[ByteTable, MarkedTable]:
    """The tables of this Python worker, kept from one task to the next; they are bounded and change no result."""
    return ByteTable(first), MarkedTable(second)


def _ends(ids: Ragged, sizes: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Flat ids, the text of each, and its token's end in the block, as a running sum of lengths."""
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(ids.lens)]), pa.int32()), pa.array(ids.flat))
    flat = lists.flatten()
    return flat, pc.list_parent_indices(lists), pc.cumulative_sum(pc.take(pa.array(sizes), flat))


class _Written:
    """Ids as decimals, each with one of three marks behind it."""

    def __init__(self, first: int, second: int):
        self.first = first
        self.stride = first + second
        self.texts = Ragged.of([f"{k if k < first else k - first}{mark}".encode() for mark in ",|;" for k in range(self.stride)], np.uint8)


@lru_cache(maxsize=1)
def _written(first: int, second: int) -> _Written:
    return _Written(first, second)


def align(a: Ragged, b: Ragged, a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, list[str], pa.Table]:
    """Groups of each text, their text's sha256, and the links (``text``, ``a``, ``b``) of all texts.

    A full outer join of both sides' ends (a key tells the text, too) gives the stretches in
    which no token ends: each lies in one token of either side, so it is one link, whose ids
    stand at the next ends. Ends that both sides share close the groups.
    """
    (ai, at, ae), (bi, bt, be) = _ends(a, a_sizes), _ends(b, b_sizes)
    left, right = pa.table({"end": ae, "a": ai, "at": at}), pa.table({"end": be, "b": bi, "bt": bt})
    both = left.join(right, "end", join_type="full outer", use_threads=False).combine_chunks()
    both = both.take(pc.sort_indices(both.column("end")))
    shared = pc.and_(both.column("a").is_valid(), both.column("b").is_valid())
    links = pa.table({"text": pc.coalesce(both.column("at"), both.column("bt")), "a": pc.fill_null_backward(both.column("a")), "b": pc.fill_null_backward(both.column("b"))})
    closes = shared.to_numpy()
    group = np.cumsum(closes) - closes
    of_a, of_b = group[both.column("a").is_valid().to_numpy()], group[both.column("b").is_valid().to_numpy()]
    texts = len(a.lens)
    groups = np.bincount(links.column("text").to_numpy()[closes], minlength=texts)
    # The texts of the groups: ids of the first side, then those of the second, each with its mark.
    form = _written(len(a_sizes), len(b_sizes))
    last = lambda g: np.diff(g, append=-1) != 0
    codes = np.concatenate([a.flat + np.where(last(of_a), form.stride, 0), b.flat + form.first + np.where(last(of_b), 2 * form.stride, 0)])
    order = np.argsort(np.concatenate([2 * of_a, 2 * of_b + 1]), kind="stable")
    digests = [hashlib.sha256(x[:-1]).hexdigest() if len(x) else "" for x in form.texts.take(codes[order]).merge(a.lens + b.lens)]
    return groups, digests, links


def _documents(docs: DataFrame, first: str, second: str, id_col: str, text_col: str) -> DataFrame:
    """A row a document: ``id``, ``row`` (unique), its counts, ``groups_sha256``, and its distinct linked pairs with their numbers."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, `row` bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>"

    def aligned(a: Ragged, b: Ragged, good: np.ndarray, names: pa.Array, row: int) -> pa.RecordBatch:
        byte, marked = _tables(first, second)
        at, n = np.flatnonzero(good), len(good)
        a, b = a.take(at), b.take(at)
        groups, digests, links = align(a, b, byte.sizes, marked.sizes)
        pair = pc.add(pc.shift_left(links.column("a").cast(pa.int64()), 32), links.column("b").cast(pa.int64()))
        counts = pa.table({"text": links.column("text"), "pair": pair}).group_by(["text", "pair"], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
        counts = counts.take(pc.sort_indices(counts, [("text", "ascending"), ("pair", "ascending")]))
        stops = pa.array(np.cumsum(np.concatenate([[0], np.bincount(at[counts.column("text").to_numpy()], minlength=n)])), pa.int32())
        lists = [pa.ListArray.from_arrays(stops, counts.column(c).combine_chunks()) for c in ("pair", "count_all")]
        sha = np.full(n, "", object)
        sha[at] = digests
        n_a, n_b, n_groups = (np.bincount(at, x, n).astype(np.int64) for x in (a.lens, b.lens, groups))
        numbers = [pa.array(x) for x in (np.arange(row, row + n), n_a, n_b, n_groups, n_a + n_b - n_groups)]
        return pa.RecordBatch.from_arrays([names, *numbers, pa.array(sha, pa.string()), *lists], ["id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte, marked = _tables(first, second)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for begin, texts in blocks(batch, text_col, BLOCK_BYTES):
                a, good = byte.encode(texts)
                b, other = marked.encode(texts)
                size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
                good = good & other & (size > 0)
                cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // ALIGN_BYTES)) + 1).tolist(), len(texts)]
                for x, y in zip(cuts, cuts[1:]):
                    some = np.arange(x, y)
                    yield aligned(a.take(some), b.take(some), good[x:y], batch.column(id_col).slice(begin + x, y - x), row)
                    row += y - x

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _partial_counts(documents: DataFrame) -> DataFrame:
    """``pair`` and ``n`` over the documents of a task, counted by ``Table.group_by`` and merged when there are many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def merged() -> pa.Table:
            whole = pa.concat_tables(held).group_by("pair", use_threads=False).aggregate([("n", "sum")])
            return pa.table({"pair": whole.column("pair"), "n": whole.column("n_sum")})

        for batch in batches:
            held.append(pa.table({"pair": pc.list_flatten(batch.column("pairs")), "n": pc.list_flatten(batch.column("times"))}))
            rows += len(held[-1])
            if rows >= MERGE_ROWS:
                held = [merged()]
                rows = len(held[0])
                if rows >= MERGE_ROWS // 2:  # merging would not pay: the rest is Spark's
                    yield from held.pop().to_batches()
                    rows = 0
        if held:
            yield from merged().to_batches()

    return documents.select("pairs", "times").mapInArrow(run, "pair bigint, n bigint")


def _threshold(counts: DataFrame, most: int) -> int:
    """The smallest power of two that at most ``most`` pairs' counts reach."""
    sizes = {r[0]: r[1] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).count().collect()}  # 63 rows at most
    total, at = 0, 63
    while at >= 0 and total + sizes.get(at, 0) <= most:
        total += sizes.get(at, 0)
        at -= 1
    return 1 << (at + 1)


def align_tokenizers(docs: DataFrame, first: str | None = None, second: str | None = None, id_col: str = "doc_id", text_col: str = "text", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Groups and links between a byte-level and a sentencepiece tokenizer's tokens of each text.

    ``first`` encodes a blank and the text, ``second`` the text; byte offsets where tokens of
    both end cut them into groups, tokens whose bytes overlap are linked. Method: each task
    aligns blocks of texts in Arrow (``align``) and counts their linked id pairs; partial
    counts are merged by Spark. The ``hot_pairs`` most frequent pairs at most (by powers of
    two) are broadcast and looked up where the documents lie; the others, whose occurrences
    are few, are joined. So no frequent pair is shuffled row by row, and what is broadcast
    has a fixed bound.

    Texts that are null, empty or changed by a tokenizer have no tokens: zeros and an empty
    ``groups_sha256``. Rows of one id, and rows without an id, stay rows of their own. Other
    columns are ignored, whatever their names. An empty table gives an empty result.

    Returns ``id_col``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose
    pair is the most frequent one of its second id), ``count_sum`` (of the pairs' corpus-wide
    counts over the links), ``groups_sha256``.
    """
    spark = docs.sparkSession
    ship(spark)
    documents = materialise(_documents(docs, first or public_path("byte_bpe_50k.json"), second or public_path("piece_bpe_32k.model"), id_col, text_col), "aligned")
    counts = _partial_counts(documents).groupBy("pair").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "pair-counts")
    second_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")
    most = counts.groupBy(second_id).agg(F.max("n").alias("top"))
    known = counts.select("*", second_id).join(most, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    least = _threshold(counts, hot_pairs)
    hot = known.where(F.col("n") >= least).toArrow().sort_by("pair")  # at most hot_pairs rows of 17 bytes
    held = spark.sparkContext.broadcast(tuple(hot.column(c).to_numpy() for c in ("pair", "n", "best")))

    def places(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = held.value[0]
        at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
        return at, keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)

    def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        owner = pc.list_parent_indices(batch.column("pairs")).to_numpy()
        return owner, batch.column("pairs").flatten().to_numpy(), batch.column("times").flatten().to_numpy()

    columns = ["id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, pairs, times = flat(batch)
            at, found = places(pairs)
            n, best = np.zeros((2, len(batch)), np.int64)
            if found.any():
                owner, at, times = owner[found], at[found], times[found]
                np.add.at(n, owner, times * held.value[1][at])
                np.add.at(best, owner, times * held.value[2][at])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(best), pa.array(n)], [*columns, "n_best", "count_sum"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, pairs, times = flat(batch)
            rest = ~places(pairs)[1]
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(owner[rest])), pa.array(pairs[rest]), pa.array(times[rest])], ["row", "pair", "times"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = documents.mapInArrow(looked_up, f"id {kind}, `row` bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint")
    if least > 1:
        rare = documents.select("row", "pairs", "times").mapInArrow(others, "`row` bigint, pair bigint, times bigint")
        rare = rare.join(known.where(F.col("n") < least), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
        out = out.join(rare, "row", "left")
        for name, more in (("n_best", "_best"), ("count_sum", "_sum")):
            out = out.withColumn(name, F.col(name) + F.coalesce(F.col(more), F.lit(0)))
    else:
        discard(counts)
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
