"""Fingerprints: sums of paragraphs, edited texts, likeness."""

import hashlib

import pytest
from pyspark.sql import functions as F

from logweave.llm import fingerprints as P
from logweave.llm.queries import QUERIES

from .helpers import edge_docs, empty_docs


def prints(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id: r.fingerprint for r in P.document_fingerprints(docs).collect()}


def successors(rows):
    """(id, text, next text) by falling id, then any order of equal ids."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    return [(a[0], a[1] or "", b[1] or "") for a, b in zip(rows, [*rows[1:], *rows[:1]])]


def edited(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def test_order_does_not_count_but_everything_else_does(spark):
    f = prints(spark, ["a b\nc d\na b", "c d\na b\na b", "a b\nc d", "a b\nc  d\na b", "a\nb c d\na b", "a b\nc d\na b\n", None, ""])
    assert f[0] == f[1] and f[6] == f[7]
    assert len({f[k] for k in (0, 2, 3, 4, 5, 6)}) == 6


def test_paragraphs_are_added_and_taken_away(spark):
    f = prints(spark, ["one two\nthree four five", "six\nseven eight", "one two\nthree four five\nsix\nseven eight", "x " * 3000 + "y"])
    rows = spark.createDataFrame([(f[0], f[1], f[2], f[3])], "a string, b string, ab string, long string")
    col = F.col
    r = rows.select(P.combine(col("a"), col("b")).alias("sum"), P.combine(col("ab"), col("b"), -1).alias("less"), P.combine(P.combine(col("a"), col("long"), -1), col("long")).alias("back")).first()
    assert r["sum"] == f[2] and r["less"] == f[0] and r["back"] == f[0]


def test_likeness_follows_the_shared_part(spark):
    words = [" ".join(f"w{(7919 * k * (j + 1)) % 100_003}" for j in range(20)) for k in range(1, 101)]
    texts = ["\n".join(words[:50]), "\n".join(words[5:50]), "\n".join(words[25:75]), "\n".join(words[50:])]
    docs = spark.createDataFrame(list(enumerate(texts)), "k bigint, t string")
    v = {r.k: r._lanes for r in P.text_vectors(docs, ["k"], "t").collect()}
    near = lambda x, y: spark.createDataFrame([(x, y)], "a array<bigint>, b array<bigint>").select(P.likeness(F.col("a"), F.col("b"))).first()[0]
    assert near(v[0], v[0]) == 1.0 and near(v[0], v[1]) > 0.85
    assert 0.25 < near(v[0], v[2]) < 0.75 and near(v[0], v[3]) < 0.3


@pytest.mark.parametrize("rows", [512, 2])
def test_edges_in_any_number_of_blocks(spark, monkeypatch, rows):
    monkeypatch.setattr(P, "BLOCK_ROWS", rows)
    docs = edge_docs(spark)
    # An id that fills whole blocks, and many rows without one.
    more = [(7, f"copy {k}", "en", 0.5, 7, "x") for k in range(30)] + [(None, f"lost {k}", "en", 0.5, 7, "x") for k in range(30)]
    docs = docs.union(spark.createDataFrame(more, docs.schema))
    held = [(r.doc_id, r.text) for r in docs.collect()]
    found = P.edited_fingerprints(docs).collect()
    count = lambda x: sorted(x, key=str)
    assert count((r.doc_id, r.n_chars) for r in found) == count((i, len(t or "")) for i, t in held)
    # Each row's edited text is made from some row that may follow it, and every row follows one.
    ids = sorted({i for i, _ in held if i is not None}, reverse=True) + [None]
    after = {a: {a, b} for a, b in zip(ids, [*ids[1:], *ids[:1]])}
    for r in found:
        own = [t or "" for i, t in held if i == r.doc_id and len(t or "") == r.n_chars]
        may = {hashlib.sha256(edited(x, t or "").encode()).hexdigest() for x in own for i, t in held if i in after[r.doc_id]}
        assert r.edited_sha256 in may and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert P.edited_fingerprints(empty_docs(spark)).count() == 0
    assert P.edited_fingerprints(docs.limit(1)).count() == 1


def test_query_whole(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_ROWS", 20)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {i: (len(t), hashlib.sha256(edited(t, n).encode()).hexdigest(), edited(t, n), n) for i, t, n in successors(docs)}
    found = {r.doc_id: r for r in QUERIES["op12_fingerprints"](spark, sf_dir).collect()}
    assert {i: (r.n_chars, r.edited_sha256) for i, r in found.items()} == {i: w[:2] for i, w in want.items()}
    own = prints(spark, [t for _, t in docs])
    changed = prints(spark, [want[i][2] for i, _ in docs])
    for k, (i, _) in enumerate(docs):
        assert (found[i].fingerprint, found[i].edited_fingerprint) == (own[k], changed[k])
    assert sum(r.near_edited > r.near_next for r in found.values()) > 0.95 * len(found)


def test_no_python_and_one_shuffle_of_texts(spark, sf_dir):
    plan = QUERIES["op12_fingerprints"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert sum("Exchange hashpartitioning" in x for x in plan.splitlines()) == 1 and "SinglePartition" not in plan
