import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from logweave.llm import grammar_ids, packing, repair
from logweave.llm.chunks import Keys, PieceTable, WordTable, public_path
from logweave.llm.piece_coding import encode_pieces
from logweave.llm.queries import QUERIES

from .helpers import EDGES, edge_docs, empty_docs


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(public_path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def piece():
    return sentencepiece.SentencePieceProcessor(model_file=public_path("piece_bpe_32k.model"))


def noise(n):
    r, letters = random.Random(5), list("abzZéÉ ßÀ 's't,.!?*<|>09_\n\t  İΣσς́e▁\x00 　&$")
    return ["".join(r.choice(letters) for _ in range(r.randrange(50))) for _ in range(n)] + [x or "" for x in EDGES]


@pytest.mark.parametrize("limit", [10, 500_000])
def test_tables_equal_the_libraries(word, piece, limit):
    texts = noise(1500)
    table, pieces = WordTable(public_path("word_bpe_49k.json"), limit), PieceTable(public_path("piece_bpe_32k.model"), limit)
    for part in (texts[:400], texts[400:]):
        arrow = pa.array(part, pa.large_string())
        assert [x.tolist() for x in table.encode(arrow)] == [e.ids for e in word.encode_batch(part, add_special_tokens=False)]
        ids, decoded = pieces.encode(arrow)
        expected = piece.encode(part)
        assert [x.tolist() for x in ids] == expected
        assert [x[1:].tobytes().decode() for x in decoded] == [piece.decode(e) for e in expected]


def test_rare_chunks_are_looked_up_apart(word, monkeypatch):
    """A lookup goes over all keys held, so the few chunks that are no plain word must not pay for all words."""
    table, sizes = WordTable(public_path("word_bpe_49k.json")), []
    places = Keys.places
    monkeypatch.setattr(Keys, "places", lambda self, *a: (sizes.append(len(self)), places(self, *a))[1])
    words = [f"w{a}{b}{c}" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    for text in (" ".join(words), "it's 5 o'clock", "it's <5> wabc o'clock", "plain wabc"):
        assert next(iter(table.encode(pa.array([text], pa.large_string())))).tolist() == word.encode(text, add_special_tokens=False).ids
    assert max(sizes[0::2]) > 500 and max(sizes[1::2]) < 10


def test_pieces(spark, piece):
    rows = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256, list(r.ids), r.decoded) for r in encode_pieces(edge_docs(spark), with_ids=True).collect())
    expected = []
    for d in edge_docs(spark).collect():
        ids = piece.encode(d.text or "")
        text = piece.decode(ids)
        expected.append((d.doc_id is None, d.doc_id or 0, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids, text))
    assert rows == sorted(expected)
    assert encode_pieces(empty_docs(spark)).count() == 0


def repeating(symbols, per_doc):
    """The most occurrences of a pair that do not overlap, over all documents."""
    counts, at = {}, 0
    for n in per_doc.tolist():
        row, last = symbols[at : at + n].tolist(), {}
        for k, pair in enumerate(zip(row, row[1:])):
            if last.get(pair) != k - 1:
                counts[pair] = counts.get(pair, 0) + 1
                last[pair] = k
        at += n
    return max(counts.values(), default=0)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), min_size=1, max_size=60), min_size=1, max_size=6), st.integers(1, 8))
def test_grammar_round_trip(docs, times):
    ids = np.array(sum(docs, []) * times, np.uint32)
    lens = np.array([len(d) for d in docs] * times)
    symbols, per_doc, rules = repair.compress(ids, lens, 6)
    assert per_doc.sum() == len(symbols) and len(per_doc) == len(lens)
    assert repeating(symbols, per_doc) < 2
    assert len(np.unique(rules, axis=0)) == len(rules)
    lengths = repair.rule_lengths(rules, 6)
    assert (repair.expand(symbols, rules, lengths, 6) == ids).all()
    a = len(ids) // 3
    assert (repair.expand_range(symbols, rules, lengths, 6, a, len(ids) - a - 1) == ids[a:-1]).all()
    first, at = 0, 0
    for n, m in zip(per_doc.tolist(), lens.tolist()):  # each document on its own
        assert (repair.expand(symbols[first : first + n], rules, lengths, 6) == ids[at : at + m]).all()
        first, at = first + n, at + m


def test_grammar_of_runs():
    for n in (1, 2, 3, 4, 7, 1000, 100_001):
        symbols, per_doc, rules = repair.compress(np.zeros(n, np.uint32), np.array([n]), 1)
        assert repeating(symbols, per_doc) < 2 and len(symbols) + len(rules) < 60
        assert len(repair.expand(symbols, rules, repair.rule_lengths(rules, 1), 1)) == n


def test_grammar_of_a_table(spark, word):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(300).collect()
    rows = [ids for _, ids in expected_words(word, docs)]
    symbols, per_doc, rules = repair.compress(np.concatenate(rows), np.array(list(map(len, rows))), 49_408)
    assert repeating(symbols, per_doc) < 2 and len(symbols) + 2 * len(rules) < 0.7 * sum(map(len, rows))


def test_a_range_reads_its_symbols_only():
    ids = np.tile(np.arange(12, dtype=np.uint32), 40)
    symbols, per_doc, rules = repair.compress(ids, np.full(40, 12), 12)
    lengths = repair.rule_lengths(rules, 12)
    # Another symbol of the right length, whose rule leads nowhere.
    bad = np.concatenate([rules, [[2**31, 2**31]]]).astype(np.uint32)
    longer = np.append(lengths, 12)
    spoilt = np.full(40, 12 + len(rules), np.uint32)
    spoilt[17] = symbols[17]
    assert (repair.expand_range(spoilt, bad, longer, 12, 17 * 12 + 3, 5) == np.arange(3, 8)).all()
    with pytest.raises(IndexError):
        repair.expand(spoilt, bad, longer, 12)


def test_grammar_compresses_and_stays_in_documents():
    ids = np.tile(np.array([3, 4, 5, 3, 4, 5, 9], np.uint32), 500)
    symbols, per_doc, rules = repair.compress(ids, np.full(500, 7), 10)
    assert len(rules) and len(symbols) < len(ids) / 2 and (per_doc >= 1).all()


def expected_words(word, docs):
    return [(d.doc_id, np.array([*word.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4")) for d in docs]


def test_id_files(spark, word, tmp_path):
    docs = edge_docs(spark)
    grammar_ids.write_ids(docs, str(tmp_path / "ids"))
    rows = sorted(grammar_ids.read_ids(spark, str(tmp_path / "ids"), with_ids=True).collect(), key=lambda r: r.start)
    held = sorted(docs.collect(), key=lambda d: (d.doc_id is not None, d.doc_id or 0, d.text or ""))
    start = 0
    for r, (doc, ids) in zip(rows, expected_words(word, held), strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, list(r.ids)) == (doc, start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist())
        start += len(ids)
    by_id = {r.doc_id: list(r.ids) for r in rows if r.doc_id not in (None, 1)}
    for doc in (0, 6, 8, 12):
        assert list(grammar_ids.read_range(spark, str(tmp_path / "ids"), doc).first().ids) == by_id[doc]
        assert list(grammar_ids.read_range(spark, str(tmp_path / "ids"), doc, 1, 3).first().ids) == by_id[doc][1:4]
    assert grammar_ids.read_range(spark, str(tmp_path / "ids"), 1).count() == 2 and grammar_ids.read_range(spark, str(tmp_path / "ids"), 77).count() == 0
    grammar_ids.write_ids(empty_docs(spark), str(tmp_path / "none"))
    assert grammar_ids.read_ids(spark, str(tmp_path / "none")).count() == 0


def check_packing(rows, words, window=2048):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for pieces in by_seq.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= window
    assert set(by_doc) == {d for d, _ in words}
    for doc, ids in words:
        mine = [r for r in by_doc[doc] if r.doc_tokens == len(ids)]
        assert any(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in mine)
    assert sum(r.length for r in rows) == sum(len(i) for _, i in words)
    return len(by_seq)


def test_packing_edges(spark, word):
    docs = edge_docs(spark)
    check_packing(packing.pack_documents(docs).collect(), expected_words(word, docs.collect()))
    assert packing.pack_documents(empty_docs(spark)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=80))
def test_pack_invariants(lengths):
    p = packing.pack(np.array(lengths, np.int64), 256, 64)
    sums = np.bincount(p["window"], p["length"]) if len(lengths) else np.zeros(0)
    assert (sums <= 256).all() and p["length"].sum() == sum(lengths)
    for t, n in enumerate(lengths):
        mine = sorted(zip(p["start"][p["text"] == t].tolist(), p["length"][p["text"] == t].tolist()))
        at = 0
        for start, size in mine:
            assert start == at
            at += size
        assert at == n
    for w in set(p["window"].tolist()):
        mine = sorted(zip(p["offset"][p["window"] == w].tolist(), p["length"][p["window"] == w].tolist()))
        assert [o for o, _ in mine] == np.concatenate([[0], np.cumsum([n for _, n in mine])[:-1]]).tolist()


def test_differencing_is_near_equal():
    sizes = np.random.default_rng(3).integers(50, 385, 4000)
    part, sums = packing.differencing(sizes, 400)
    assert (np.bincount(part, sizes) == sums[: part.max() + 1]).all()
    assert sums.max() - sums.min() <= 0.02 * sums.mean()


def test_queries_over_a_table(spark, sf_dir, word):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    words = expected_words(word, docs)
    used = check_packing(QUERIES["op8_packing"](spark, sf_dir).collect(), words)
    assert sum(len(i) for _, i in words) / (2048 * used) > 0.95
    start = 0
    for r, (doc, ids) in zip(sorted(QUERIES["op4_grammar_ids"](spark, sf_dir).collect(), key=lambda r: r.doc_id), words, strict=True):
        assert tuple(r) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_piece_query(spark, sf_dir, piece):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op10_piece_coding"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = piece.encode(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(piece.decode(ids).encode()).hexdigest())
