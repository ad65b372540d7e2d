"""Re-Pair grammars of id sequences: exact pair counts, kept up as pairs are replaced."""

from __future__ import annotations

import numpy as np

#: Pairs at least this share of the most frequent one's count are replaced in one round.
SHARE = 0.5


def _grouped(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions sorted by their pair (then by position), and each pair's start there, left and right symbol."""
    bits = int(max(left.max(initial=0), right.max(initial=0))).bit_length()
    low = int(at.max(initial=0)).bit_length()
    if 2 * bits + low <= 64:  # pair and position in one number sort fastest
        key = (((left.astype(np.uint64) << np.uint64(bits)) | right) << np.uint64(low)) | at.astype(np.uint64)
        key.sort()
        pair = key >> np.uint64(low)
        at = (key & np.uint64((1 << low) - 1)).astype(np.int64)
    else:
        order = np.lexsort((at, right, left))
        at, bits = at[order], 32
        pair = (left[order].astype(np.uint64) << np.uint64(32)) | right[order]
    starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
    names = pair[starts]
    return at, starts, (names >> np.uint64(bits)).astype(np.uint32), (names & np.uint64((1 << bits) - 1)).astype(np.uint32)


def _slices(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of runs of ``lens`` from ``starts`` on."""
    ends = np.cumsum(lens)
    out = np.repeat(starts - (ends - lens), lens)
    out += np.arange(len(out))
    return out


class _Pairs:
    """All pairs that occur at least twice: symbols, exact counts, and where they occurred when they were found."""

    def __init__(self, room: int):
        self.size = self.used = 0  # pairs, places
        self.columns = {k: np.zeros(room // 4 + 16, np.uint32) for k in ("left", "right", "names")}
        self.columns |= {k: np.zeros(room // 4 + 16, np.int64) for k in ("counts", "starts", "lens", "ranks")}
        self.held = np.zeros(2 * room + 16, np.int32)

    def __getattr__(self, name: str) -> np.ndarray:
        return self.columns[name][: self.size]

    def add(self, at: np.ndarray, starts: np.ndarray, left: np.ndarray, right: np.ndarray, pair_of: np.ndarray) -> None:
        """Pairs found now, grouped; ``pair_of`` gets the number of the pair at each position that repeats."""
        lens = np.diff(np.append(starts, len(at)))
        some = lens > 1
        places = at[np.repeat(some, lens)]
        lens = lens[some]
        first, size, used = self.size, self.size + len(lens), self.used + len(places)
        pair_of[places] = np.repeat(np.arange(first, size, dtype=np.int32), lens)
        if used > len(self.held):
            self.held = np.concatenate([self.held, np.zeros(used, np.int32)])
        for name in self.columns:
            if size > len(self.columns[name]):
                self.columns[name] = np.concatenate([self.columns[name], np.zeros(size, self.columns[name].dtype)])
        for name, values in {"left": left[some], "right": right[some], "counts": lens, "lens": lens, "starts": self.used + np.cumsum(lens) - lens}.items():
            self.columns[name][first:size] = values
        self.held[self.used : used] = places
        self.size, self.used = size, used


def _disjoint(at: np.ndarray, rank: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Occurrences (ascending positions ``at`` of pairs of some ``rank``) of which none overlaps another.

    Two occurrences overlap where the second symbol of one begins the other. In a chain of
    such, pairs of higher rank go first; in a run of one pair, every other one from the left.
    """
    chosen = []
    while len(at) > 1:
        link = after[at[:-1]] == at[1:]  # each with the next one
        if not link.any():
            break
        here = np.arange(len(at))
        ahead, behind = rank[:-1] < rank[1:], rank[:-1] > rank[1:]
        head = np.ones(len(at), bool)
        head[1:] = ~link | ahead | behind
        begin = np.maximum.accumulate(np.where(head, here, 0))
        under = np.zeros(len(at), bool)
        under[1:] = link & behind
        take = ((here - begin) & 1 == 0) & ~under[begin]
        take[:-1] &= ~(link & ahead)
        chosen.append(at[take])
        left = ~take
        left[1:] &= ~(link & take[:-1])
        left[:-1] &= ~(link & take[1:])
        at, rank = at[left], rank[left]
    if not chosen:
        return at
    out = np.concatenate([*chosen, at])
    out.sort()
    return out


def compress(ids: np.ndarray, doc_lens: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: replace the most frequent pairs of neighbouring symbols by new ones until no pair repeats.

    Counts are exact. A round replaces all pairs with at least ``SHARE`` of the highest count;
    where occurrences overlap, the more frequent pair goes first. Only places beside a
    replacement change their pairs: their old pairs are counted down, and their new pairs,
    which all hold a new symbol, are counted there alone. Pairs never reach across documents.
    At the end no pair occurs twice without overlap in the sequence.

    Returns the symbols, the symbols per document, and the rules (pairs) in the order of their symbols.
    """
    n = len(ids)
    seq = ids.astype(np.uint32)
    ends = np.cumsum(doc_lens)
    after = np.arange(1, n + 1, dtype=np.int32)  # next symbol's position; n: none
    after[ends - 1] = n
    before = np.arange(-1, n - 1, dtype=np.int32)
    before[ends - doc_lens] = -1
    pair_of = np.full(n + 1, -1, np.int32)  # at n and -1: none
    rules_left, rules_right = [], []
    pairs, symbol = _Pairs(n), vocabulary
    at = np.flatnonzero(after < n)
    pairs.add(*_grouped(seq[at], seq[after[at]], at), pair_of)
    dead = np.zeros(n, bool)

    def replaceable(picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where pairs are replaced, in order, and those pairs; one that would be replaced once stays."""
        places = pairs.held[_slices(pairs.starts[picked], pairs.lens[picked])].astype(np.int64)
        rank = np.repeat(np.arange(len(picked)), pairs.lens[picked])
        live = pair_of[places] == picked[rank]
        key = (places[live] << 32) | rank[live]  # in order of place
        key.sort()
        places = _disjoint(key >> 32, key & 0xFFFFFFFF, after)
        ranks = pairs.ranks  # only those of picked pairs are read
        ranks[picked] = np.arange(len(picked))
        rank = ranks[pair_of[places]]
        used = np.bincount(rank, minlength=len(picked)) > 1
        return places[used[rank]], np.sort(picked[used])

    while pairs.size and (most := int(pairs.counts.max())) > 1:
        picked = np.flatnonzero(pairs.counts >= max(2, int(np.ceil(most * SHARE))))
        picked = picked[np.argsort(pairs.counts[picked], kind="stable")]
        at, new = replaceable(picked)
        if not len(at):  # pairs that only overlap themselves, or each other
            for p in picked[pairs.left[picked] == pairs.right[picked]].tolist():
                if not len(replaceable(np.array([p]))[0]):
                    pairs.counts[p] = 0
            at, new = replaceable(picked[-1:])
            if not len(at):
                continue
        mine, name = pair_of[at], pairs.names  # only those of new rules are read
        name[new] = symbol + np.arange(len(new), dtype=np.uint32)
        symbol += len(new)
        rules_left.append(pairs.left[new])
        rules_right.append(pairs.right[new])
        second = after[at].astype(np.int64)
        third = after[second].astype(np.int64)
        # Old pairs at the places that change: before, at and after each replaced pair.
        old = []
        for around in (before[at].astype(np.int64), at, second):
            around = around[around >= 0] if around is not at else at
            old.append(pair_of[around])
            pair_of[around] = -1
        old = np.concatenate(old)
        old, counts = old[old >= 0], pairs.counts
        if len(old) < len(counts) // 8:
            np.subtract.at(counts, old, 1)
        else:
            counts -= np.bincount(old, minlength=len(counts))
        seq[at] = name[mine]
        after[at] = third
        inner = third < n
        before[third[inner]] = at[inner]
        dead[second] = True
        ahead = before[at]
        ahead = ahead[ahead >= 0]
        where = np.concatenate([ahead[seq[ahead] < symbol - len(new)], at])  # each place once
        where = where[after[where] < n]
        pairs.add(*_grouped(seq[where], seq[after[where]], where), pair_of)
    left = ~dead
    kept = np.concatenate([[0], np.cumsum(left)])
    rules = np.stack([np.concatenate(rules_left), np.concatenate(rules_right)], 1) if rules_left else np.zeros((0, 2), np.uint32)
    return seq[left], kept[ends] - kept[ends - doc_lens], rules


def rule_lengths(rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """The number of ids that each rule's symbol stands for."""
    lens = np.ones(vocabulary + len(rules), np.int64)
    highest = np.maximum.accumulate(rules.max(1)) if len(rules) else np.zeros(0)
    k = 0
    while k < len(rules):
        ready = int(np.searchsorted(highest, vocabulary + k))  # up to here rules hold known symbols only
        lens[vocabulary + k : vocabulary + ready] = lens[rules[k:ready]].sum(1)
        k = ready
    return lens[vocabulary:]


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, vocabulary: int) -> np.ndarray:
    """The ids that ``symbols`` stand for; ``lengths`` of the rules say where each goes, and only rules below them are read."""
    size = lambda s: np.where(s >= vocabulary, lengths[np.maximum(s.astype(np.int64) - vocabulary, 0)] if len(lengths) else 1, 1)
    lens = size(symbols)
    place = np.cumsum(lens) - lens
    out = np.zeros(int(lens.sum()), np.uint32)
    while len(symbols):
        plain = symbols < vocabulary
        out[place[plain]] = symbols[plain]
        symbols, place = symbols[~plain].astype(np.int64) - vocabulary, place[~plain]
        left, right = rules[symbols, 0], rules[symbols, 1]
        symbols, place = np.concatenate([left, right]), np.concatenate([place, place + size(left)])
    return out


def expand_range(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, vocabulary: int, start: int, length: int) -> np.ndarray:
    """``length`` ids from position ``start`` on of what ``symbols`` stand for; only the symbols that cover them are expanded."""
    lens = np.where(symbols >= vocabulary, lengths[np.maximum(symbols.astype(np.int64) - vocabulary, 0)] if len(lengths) else 1, 1)
    ends = np.cumsum(lens)
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + length, "left") + 1
    first = int(ends[a - 1]) if a else 0
    return expand(symbols[a:b], rules, lengths, vocabulary)[start - first : start - first + length]
