"""Tables of distinct chunks with their token ids, kept inside one task.

Both tokenizers used here never join characters across certain white space, so a text's
ids are those of its chunks in order. A task looks each distinct chunk up once; positions
are joined back with numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks kept by one task; at the bound the table starts anew, which changes no result.
TABLE_CHUNKS = 500_000
#: Characters of text handled at once, so that memory does not follow the Arrow batch.
BLOCK_CHARS = 3_000_000
#: Letters whose lower case is one precomposed letter, then plain ASCII punctuation that the
#: split pattern keeps together; no apostrophe (contractions) and no < | > (special tokens).
_SIMPLE = r"^(?P<a>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<b>[!-&(-/:;=?@\[-`{}~]*)$"


def public_path(name: str) -> str:
    """Where the installed vocabulary file ``name`` lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def blocks(batch: pa.RecordBatch, column: str, chars: int = BLOCK_CHARS) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of runs of rows holding about ``chars`` bytes; null: empty text."""
    texts = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    group = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // chars
    cuts = np.flatnonzero(np.diff(group)) + 1
    for first, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)]):
        if stop > first:
            yield first, texts.slice(first, stop - first)


def give_back() -> None:
    """Return memory that Arrow has freed but keeps to the system; a Python worker lives on from stage to stage."""
    pa.default_memory_pool().release_unused()


class Ragged:
    """Rows of numbers of different lengths in one flat array."""

    def __init__(self, flat: np.ndarray, lens: np.ndarray):
        self.flat, self.lens = flat, lens.astype(np.int64)
        self.starts = np.cumsum(self.lens) - self.lens

    @classmethod
    def of(cls, rows: list, dtype) -> Ragged:
        lens = np.fromiter(map(len, rows), np.int64, len(rows))
        if dtype == np.uint8:
            return cls(np.frombuffer(b"".join(rows), np.uint8), lens)
        return cls(np.fromiter(chain.from_iterable(rows), dtype, int(lens.sum())), lens)

    def take(self, rows: np.ndarray) -> Ragged:
        lens = self.lens[rows]
        ends = np.cumsum(lens)
        at = np.repeat(self.starts[rows] - (ends - lens), lens)
        at += np.arange(len(at))
        return Ragged(self.flat[at], lens)

    def add(self, more: Ragged) -> Ragged:
        return Ragged(np.concatenate([self.flat, more.flat]), np.concatenate([self.lens, more.lens]))

    def merge(self, counts: np.ndarray) -> Ragged:
        """Runs of ``counts`` rows as one row each."""
        ends = np.concatenate([[0], np.cumsum(self.lens)])
        stops = np.cumsum(counts)
        return Ragged(self.flat, ends[stops] - ends[stops - counts])

    def __iter__(self) -> Iterator[np.ndarray]:
        for a, n in zip(self.starts.tolist(), self.lens.tolist()):
            yield self.flat[a : a + n]


def _distinct(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct values, and for each value its position among them."""
    coded = values.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


class Keys:
    """Distinct strings in the order in which they came, and their places."""

    def __init__(self, first: list[str]):
        self.held = pa.array(first, pa.large_string())
        self.at = np.arange(len(first))

    def __len__(self) -> int:
        return len(self.held)

    def places(self, keys: pa.Array, add, first: int | None = None) -> np.ndarray:
        """The place of each of some distinct keys; ``add`` is called with those that come now.

        New keys get places from ``first`` on, or from the number of keys on.
        """
        found = pc.index_in(keys, value_set=self.held)
        new = found.is_null()
        where = pc.fill_null(found, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if found.null_count:
            fresh = keys.filter(new)
            add(fresh.to_pylist())
            start = len(self.held) if first is None else first
            where[new.to_numpy(zero_copy_only=False)] = np.arange(len(self.held), len(self.held) + len(fresh))
            self.at = np.concatenate([self.at, np.arange(start, start + len(fresh))])
            self.held = pa.concat_arrays([self.held, fresh])
        return self.at[where]


class WordTable:
    """Token ids of texts under a word tokenizer of the tokenizers library.

    The vocabulary marks the end of each word; its text splitting never crosses white space.
    Texts are cut at blanks and newlines only; all other characters stay for the library.
    """

    def __init__(self, path: str, limit: int = TABLE_CHUNKS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        # For words that are already split and in lower case.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.whole.get_vocab_size(), bool)
        for token, k in self.whole.get_vocab().items():
            self.ends[k] = token.endswith("</w>")
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        # Apart, because a lookup goes over all keys held: words are many, other chunks few.
        self.rows, self.others = Keys([""]), Keys([])
        self.ids = Ragged(np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def _add_words(self, words: list[str]) -> None:
        """words: each one word of the split pattern, so that its last id alone ends a word."""
        groups = [" ".join(words[k : k + 400]) for k in range(0, len(words), 400)]
        ids = np.concatenate([np.array(x.ids, np.uint32) for x in self.plain.encode_batch_fast(groups, add_special_tokens=False)])
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):
            raise ValueError("a word was split in two")
        self.ids = self.ids.add(Ragged(ids, np.diff(stops, prepend=0)))

    def _add_others(self, keys: list[str]) -> None:
        found = [x.ids for x in self.whole.encode_batch_fast(keys, add_special_tokens=False)]
        self.ids = self.ids.add(Ragged.of(found, np.uint32))

    def encode(self, texts: pa.Array) -> Ragged:
        """The ids of each text."""
        if len(self.rows) + len(self.others) > self.limit:
            self._clear()
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        chunks, at = _distinct(lists.flatten())
        parts = pc.extract_regex(chunks, _SIMPLE)
        simple = parts.is_valid().to_numpy(zero_copy_only=False)
        others = chunks.filter(pa.array(~simple))
        parts = parts.filter(pa.array(simple))
        both = pa.concat_arrays([pc.utf8_lower(pc.struct_field(parts, [0])), pc.struct_field(parts, [1])])
        words, which = _distinct(both)
        row = self.rows.places(words, self._add_words, len(self.ids.lens))[which]
        n = int(simple.sum())
        first, second = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        first[simple], second[simple] = row[:n], row[n:]
        first[~simple] = self.others.places(others, self._add_others, len(self.ids.lens))
        table = self.ids.take(np.stack([first, second], 1).ravel()).merge(np.full(len(chunks), 2))
        return table.take(at).merge(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))


@lru_cache(maxsize=1)
def word_table(path: str) -> WordTable:
    """The table of this Python worker, kept from one task to the next; it is bounded and changes no result."""
    return WordTable(path)


class PieceTable:
    """Ids and decoded text under a sentencepiece model whose pieces hold blanks only in front."""

    MARK = "▁"

    def __init__(self, path: str, limit: int = TABLE_CHUNKS):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        if any(self.MARK in p.lstrip(self.MARK) for p in map(self.sp.id_to_piece, range(n))):
            raise ValueError("this model has pieces that cross a blank")
        self.blank = self.sp.piece_to_id(self.MARK)
        self.decimal = Ragged.of([f"{k},".encode() for k in range(n)], np.uint8)
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.rows = Keys([])
        self.ids = Ragged(np.zeros(0, np.int32), np.zeros(0, np.int64))
        self.decoded = Ragged(np.zeros(0, np.uint8), np.zeros(0, np.int64))

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The texts' chunks, each without the one blank in front, and their number per text.

        An empty text has none. Runs of blanks belong to the chunk that follows them.
        """
        texts = pc.replace_substring(texts, self.MARK, " ")
        odd = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
        if pc.any(pc.or_(odd, pc.equal(texts, ""))).as_py():
            lists = [[m[1:] for m in re.findall(" +[^ ]*", " " + t)] if t else [] for t in texts.to_pylist()]
            lists = pa.array(lists, pa.large_list(pa.large_string()))
        else:
            lists = pc.split_pattern(texts, " ")
        return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)

    def _add(self, new: list[str]) -> None:
        ids = self.sp.encode(new, num_threads=1)
        # One blank on its own is what remains of a text's last blank.
        ids = [x if c else [self.blank] for c, x in zip(new, ids)]
        texts = [(" " + t).encode() for t in self.sp.decode(ids, num_threads=1)]
        self.ids = self.ids.add(Ragged.of(ids, np.int32))
        self.decoded = self.decoded.add(Ragged.of(texts, np.uint8))

    def encode(self, texts: pa.Array) -> tuple[Ragged, Ragged]:
        """The ids and the decoded bytes of each text; the bytes have one blank too many in front."""
        if len(self.rows) > self.limit:
            self._clear()
        values, counts = self._cut(texts)
        chunks, at = _distinct(values)
        row = self.rows.places(chunks, self._add)[at]
        return self.ids.take(row).merge(counts), self.decoded.take(row).merge(counts)


@lru_cache(maxsize=1)
def piece_table(path: str, limit: int = TABLE_CHUNKS) -> PieceTable:
    """The table of this Python worker, kept from one task to the next; it is bounded and changes no result."""
    return PieceTable(path, limit)
