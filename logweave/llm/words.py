"""Word hashes and word-shingle sets of text blocks, vectorised."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from .chunks import Ragged, _distinct


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words (runs without ASCII white space), each word's position there, words per text."""
    lists = pc.ascii_split_whitespace(texts)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten()
    empty = pc.equal(values, "").to_numpy(zero_copy_only=False)
    if empty.any():  # in front of or behind white space
        owner = np.repeat(np.arange(len(counts)), counts)
        counts = counts - np.bincount(owner[empty], minlength=len(counts))
        values = values.filter(pa.array(~empty))
    words, at = _distinct(values)
    return words, at, counts


def word_hashes(texts: pa.Array) -> Ragged:
    """A 64-bit hash of each word of each text."""
    words, at, counts = word_chunks(texts)
    hashes = pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(words) else np.zeros(0, np.uint64)
    return Ragged(hashes[at], counts)


def shingles(hashes: Ragged, n: int) -> Ragged:
    """Hashes of all runs of ``n`` words of each text; of fewer words, one of the whole text.

    A text without words has none. The length goes into the hash, so that short texts meet
    only texts of as many words.
    """
    size = np.minimum(hashes.lens, n)
    count = np.where(hashes.lens > 0, np.maximum(hashes.lens - n + 1, 1), 0)
    owner = np.repeat(np.arange(len(count)), count)
    begin = np.repeat(hashes.starts - (np.cumsum(count) - count), count) + np.arange(len(owner))
    length = size[owner]
    out = length.astype(np.uint64)
    for k in range(n):
        here = begin + k
        use = k < length
        out = np.where(use, mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes.flat[np.where(use, here, 0)]) if len(hashes.flat) else out, out)
    return Ragged(out, count)


def distinct_sets(rows: Ragged) -> Ragged:
    """Each row's distinct values in ascending order."""
    sets = [np.unique(x) for x in rows]
    return Ragged(np.concatenate(sets) if sets else rows.flat, np.fromiter(map(len, sets), np.int64, len(sets)))
