"""License notices inside texts: MinHash bands over overlapping windows, then exact containment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .chunks import Ragged, blocks
from .common import ship
from .license_texts import TEXTS
from .words import mix, shingles, word_chunks

#: Words of a shingle (all words of a shorter template), share of a template's shingles a window needs, hash functions (one a band).
WORDS, CONTAINMENT, BANDS = 5, 0.8, 32
#: Windows of 2**k shingles begin at every shingle of a text whose number divides by 2**k / STEPS.
STEPS = 8
#: Bytes of text handled at once.
_BLOCK = 500_000

#: Notices by which texts name their license, and full texts. Fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "LGPL-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "EPL-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "all-rights-reserved": "All rights reserved.",
    "MIT-notice": "Licensed under the MIT License.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "SPDX-MIT": "SPDX-License-Identifier: MIT",
    "SPDX-Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "SPDX-BSD-3-Clause": "SPDX-License-Identifier: BSD-3-Clause",
    "SPDX-GPL-3.0-or-later": "SPDX-License-Identifier: GPL-3.0-or-later",
    "SPDX-MPL-2.0": "SPDX-License-Identifier: MPL-2.0",
    **TEXTS,
}

_TRIM = ".,;:!?\"'()[]{}<>*_`~“”‘’«»…-"


def _hashed_words(texts: pa.Array) -> tuple[Ragged, Ragged]:
    """Hashes of lower-case words without punctuation around them, and each word's position in its text; words of punctuation alone are left out."""
    words, at, counts = word_chunks(pc.utf8_lower(texts))
    trimmed = pc.utf8_trim(words, characters=_TRIM)
    trimmed = pc.if_else(pc.equal(trimmed, ""), words, trimmed)
    hashes = pd.util.hash_array(trimmed.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(words) else np.zeros(0, np.uint64)
    kept = pc.match_substring_regex(words, r"[\pL\pN]").to_numpy(zero_copy_only=False)[at] if len(words) else np.zeros(0, bool)
    owner = np.repeat(np.arange(len(counts)), counts)
    places = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    left = np.bincount(owner[kept], minlength=len(counts))
    return Ragged(hashes[at][kept], left), Ragged(places[kept], left)


@dataclass(frozen=True)
class Match:
    """One occurrence: text and template by number, its first and last shingle, the share of the template's shingles there."""

    text: int
    template: int
    first: int
    last: int
    share: float


class Templates:
    """Shingle sets of the templates, and an index from MinHash values (by shingle width, window size and band) to templates."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        words = _hashed_words(pa.array(list(templates.values()), pa.large_string()))[0]
        self.seeds = mix(np.arange(1, BANDS + 1, dtype=np.uint64)) | np.uint64(1)
        self.sets: list[np.ndarray] = []
        #: Per shingle width and window level: numbers of the templates.
        self.levels: dict[int, dict[int, list[int]]] = {}
        for k, n in enumerate(words.lens.tolist()):
            width = min(WORDS, n)
            row = shingles(Ragged(words.flat[words.starts[k] : words.starts[k] + n], np.array([n])), max(width, 1)).flat
            self.sets.append(np.unique(row))
            level = 0
            while 1 << level < len(row) + max(1, (1 << level) // STEPS) - 1:
                level += 1
            if len(row):
                self.levels.setdefault(width, {}).setdefault(level, []).append(k)
        self.index = {(width, level): self._index(which) for width, by_level in self.levels.items() for level, which in by_level.items()}

    def _values(self, flat: np.ndarray) -> np.ndarray:
        """The hash of each shingle under each function."""
        return ((flat[None, :] * self.seeds[:, None]) >> np.uint64(32)).astype(np.uint32)

    def _index(self, which: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted (band, value) keys with their templates, and which low 16 bits of values occur."""
        low = np.stack([self._values(self.sets[k]).min(1) for k in which], 1)
        keys = (np.arange(BANDS, dtype=np.uint64)[:, None] << np.uint64(32)) | low
        owner = np.tile(np.array(which), (BANDS, 1))
        order = np.argsort(keys, axis=None, kind="stable")
        some = np.zeros(1 << 16, bool)
        some[low & np.uint32(0xFFFF)] = True
        return keys.ravel()[order], owner.ravel()[order], some

    def candidates(self, rows: Ragged, width: int) -> set[tuple[int, int, int]]:
        """(template, first shingle, window size) of the windows that agree with a template in any band."""
        found: set[tuple[int, int, int]] = set()
        if not len(rows.flat):
            return found
        low = self._values(rows.flat)
        owner = np.repeat(np.arange(len(rows.lens)), rows.lens)
        at = np.arange(len(rows.flat)) - rows.starts[owner]
        place = np.arange(len(rows.flat))
        top, step = max(self.levels[width]), 1
        for level in range(top + 1):
            size = 1 << level
            if (width, level) in self.index:
                keys, templates, some = self.index[width, level]
                band, k = np.nonzero(some[low & np.uint32(0xFFFF)])
                wanted = (band.astype(np.uint64) << np.uint64(32)) | low[band, k]
                first, stop = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
                for j in np.flatnonzero(stop > first).tolist():
                    found.update((t, int(place[k[j]]), size) for t in templates[first[j] : stop[j]].tolist())
            if level < top:
                # Twice the window: the lower of this value and the one a window further on, within the text.
                ahead = size // step
                if ahead < low.shape[1]:
                    other = np.where(owner[ahead:] == owner[:-ahead], low[:, ahead:], np.uint32(0xFFFFFFFF))
                    low[:, :-ahead] = np.minimum(low[:, :-ahead], other)
                if 2 * size // STEPS > step:
                    step = 2 * size // STEPS
                    kept = at % step == 0
                    low, owner, at, place = low[:, kept], owner[kept], at[kept], place[kept]
        return found

    def measured(self, row: np.ndarray, template: int) -> tuple[float, int, int]:
        """Share of the template's distinct shingles in a window, and the first and last shingle of the shortest run that holds them."""
        wanted = self.sets[template]
        which = np.minimum(np.searchsorted(wanted, row), len(wanted) - 1)
        hits = np.flatnonzero(wanted[which] == row)
        if not len(hits):
            return 0.0, 0, 0
        which = which[hits].tolist()
        need, count, best, a = len(set(which)), {}, (len(row) + 1, 0, 0), 0
        for b, x in enumerate(which):
            count[x] = count.get(x, 0) + 1
            while len(count) == need:
                best = min(best, (int(hits[b] - hits[a]), int(hits[a]), int(hits[b])))
                count[which[a]] -= 1
                if not count[which[a]]:
                    del count[which[a]]
                a += 1
        return need / len(wanted), best[1], best[2]

    def extended(self, row: np.ndarray, template: int, first: int, last: int) -> tuple[int, int]:
        """The run with the template's shingles that adjoin it in the text: those that stand in it twice."""
        wanted = self.sets[template]
        held = lambda x: wanted[min(int(np.searchsorted(wanted, x)), len(wanted) - 1)] == x
        while first > 0 and held(row[first - 1]):
            first -= 1
        while last + 1 < len(row) and held(row[last + 1]):
            last += 1
        return first, last

    def find(self, words: Ragged) -> list[tuple[Match, int]]:
        """All occurrences in a block of texts, with the width of their shingles."""
        out = []
        for width in self.levels:
            rows = shingles(words, width)
            stops = rows.starts + rows.lens
            seen: dict[tuple[int, int], set[tuple[float, int, int]]] = {}
            for template, a, size in self.candidates(rows, width):
                text = int(np.searchsorted(stops, a, "right"))
                share, first, last = self.measured(rows.flat[a : min(a + size, stops[text])], template)
                if share >= CONTAINMENT:
                    begin = a - int(rows.starts[text])
                    row = rows.flat[rows.starts[text] : stops[text]]
                    seen.setdefault((text, template), set()).add((-share, *self.extended(row, template, begin + first, begin + last)))
            for (text, template), some in seen.items():
                taken: list[tuple[int, int]] = []
                for share, first, last in sorted(some, key=lambda x: (x[0], x[2] - x[1], x[1])):
                    if all(last < a or first > b for a, b in taken):
                        taken.append((first, last))
                        out.append((Match(text, template, first, last, -share), width))
        return sorted(out, key=lambda m: (m[0].text, m[0].template, m[0].first))


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License templates that a text holds: id, ``license``, ``first_word``, ``n_words``, ``containment``, a row each time.

    Method: all windows of 2**k shingles, k by the template's length, overlapping so that one
    of them covers any occurrence, get ``BANDS`` MinHash values of their five-word shingles
    (of a shorter template, of all its words; words of punctuation alone, such as comment
    marks, are left out, spans count them). A window that agrees with a template in any one
    value (a band of one row), looked up in an index of all templates, is a candidate, and its
    exact containment of the template's distinct shingles must reach 0.8. A window is at most
    2.3 times as long as the template, so such a one has a similarity of at least 0.32 with
    it, and all 32 bands miss it with a probability of at most 5e-6.

    Occurrences of one template do not overlap: of overlapping ones that with the largest
    containment is returned, of equals the shortest, then the first. The table of templates
    is an argument of fixed size. Null, empty and short texts have no match; repeated rows are
    scanned each; other columns are ignored; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    held = templates or TEMPLATES
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(held)
        for batch in batches:
            for first, texts in blocks(batch, text_col, _BLOCK):
                words, places = _hashed_words(texts)
                found = known.find(words)
                ids = batch.column(id_col).slice(first, len(texts))
                begin = [int(places.flat[places.starts[m.text] + m.first]) for m, _ in found]
                end = [int(places.flat[places.starts[m.text] + min(m.last + width, places.lens[m.text]) - 1]) for m, width in found]
                out = {
                    id_col: ids.take(pa.array([m.text for m, _ in found], pa.int64())),
                    "license": pa.array([known.names[m.template] for m, _ in found], pa.string()),
                    "first_word": pa.array(begin, pa.int64()),
                    "n_words": pa.array([b - a + 1 for a, b in zip(begin, end)], pa.int64()),
                    "containment": pa.array([m.share for m, _ in found], pa.float64()),
                }
                yield pa.RecordBatch.from_pydict(out)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, license string, first_word bigint, n_words bigint, containment double")
