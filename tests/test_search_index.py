"""Indexes of vectors and of texts against plain search."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.operators import text_search, vector_index, vectors

N, DIMS = 50_000, 32


@pytest.fixture(scope="module")
def clustered(spark):
    """Unit vectors around many centres; a tenth of them equal."""
    r = np.random.default_rng(5)
    centres = r.normal(size=(400, DIMS))
    x = centres[r.integers(0, 400, N)] + 0.35 * r.normal(size=(N, DIMS))
    x[: N // 10] = centres[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(x.astype(np.float32).tolist())], "vec_id bigint, embedding array<float>")
    return rows.repartition(8).cache()


def test_recall_with_a_tenth_of_the_vectors(spark, clustered, tmp_path):
    index = vector_index.build_vector_index(clustered, str(tmp_path / "index"))
    assert index.table().count() == N
    queries = clustered.where("vec_id % 500 = 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    exact = {(r.query_id, r.vec_id) for r in vectors.vector_topk(clustered, queries, 5).collect()}
    again = vector_index.open_vector_index(spark, str(tmp_path / "index"))
    near = vector_index.search_index(again, queries, 5).collect()
    assert len({(r.query_id, r.vec_id) for r in near} & exact) >= 0.9 * len(exact)
    # What the queries look into, as a share of all vectors.
    sizes = index.list_sizes()
    asked = np.array([r.query for r in queries.collect()], np.float32)
    touched = [sum(sizes.get(int(v), 0) for v in lists) / N for lists in vector_index.probed_lists(index, asked)]
    usual = [t for t, r in zip(touched, queries.collect()) if r.query_id >= N // 10]  # the others share one vector with a tenth of all
    assert np.mean(usual) <= 0.1
    plan = vector_index.search_index(again, queries.limit(1), 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "_list" in plan.split("PartitionFilters")[1][:200]


def test_index_edges(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (2, [0.0, 1.0, 0.0]), (None, [0.6, 0.8, 0.0]), (4, None), (5, []), (6, [1.0]), (7, [math.nan, 0.0, 0.0]), (8, [None, 1.0, 0.0]), (9, [0.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    queries = spark.createDataFrame([(0, [2.0, 0.0, 0.0]), (1, None), (2, [1.0])], "query_id int, query array<double>")
    found = vector_index.approx_topk(table, queries, 3).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id, r.similarity) for r in found] == [(0, 1, 1.0), (0, None, 0.6), (0, 2, 0.0)]
    assert vector_index.approx_topk(table.limit(0), queries, 3).count() == 0
    assert vector_index.approx_topk(table, queries.limit(0), 3).count() == 0


def cosine_hits(entries, queries, k):
    """(query, file, template, frequency, similarity, rank) by plain loops."""
    term = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    distinct = {t for _, t, _ in entries}
    df = Counter(w for t in distinct for w in set(term(t)))
    idf = {w: math.log((1 + len(distinct)) / (1 + n)) + 1 for w, n in df.items()}

    def unit(t):
        v = {w: n * idf[w] for w, n in Counter(term(t)).items() if w in idf}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    out = []
    units = [(f, t, n, unit(t)) for f, t, n in entries]
    for q, text in queries:
        a = unit(text)
        hits = [(-round(sum(x * b.get(w, 0) for w, x in a.items()), 9), f, t, n) for f, t, n, b in units]
        hits = sorted(h for h in hits if h[0] < 0)[:k]
        out += [(q, f, t, n, round(-s, 4), r) for r, (s, f, t, n) in enumerate(hits, 1)]
    return sorted(out)


@pytest.mark.parametrize(("segment", "block"), [(2048, 500), (3, 2)])
def test_text_search(spark, monkeypatch, segment, block):
    monkeypatch.setattr(text_search, "QUERY_BLOCK", block)
    texts = ["Disk full on <NUM>", "link up", "link down on wan0", "disk <NUM> ok", "--", "", "Überlauf Disk", "link link link", "user <*> logged in", "user <*> logged out", "disk full on <NUM> again and again"]
    entries = [(f, t, k + 1) for k, t in enumerate(texts) for f in (("a", "b") if k % 2 else ("a",))]
    counts = spark.createDataFrame([*entries, ("a", None, 3)], "file string, template string, count bigint").repartition(3)
    queries = [(1, "DISK full"), (2, "link"), (3, "nothing known"), (4, "user logged disk"), (5, "überlauf"), (6, ""), (7, None), (8, "on on ON <num>")]
    index = text_search.build_text_index(counts, segment=segment)
    hits = text_search.search_text(index, spark.createDataFrame(queries, "query_id bigint, text string"), 3)
    assert sorted(map(tuple, hits.collect())) == cosine_hits(entries, queries, 3)
    parsed = spark.createDataFrame([(f, k, t) for k, (f, t, _) in enumerate(entries)], "file string, line_no bigint, template string")
    lines = text_search.search_text_lines(hits.where("query_id = 2"), parsed)
    assert {(r.file, r.template) for r in lines.collect()} == {(h[1], h[2]) for h in cosine_hits(entries, queries, 3) if h[0] == 2}


@pytest.mark.parametrize(("dense", "columns", "added"), [(1, 3, 8), (6, 2, 5), (10**6, 256, 7)])
def test_scores_of_segments_against_tables_of_queries(monkeypatch, dense, columns, added):
    """Only a table's queries meet a segment at once, and a task holds no more than the best k of each."""
    for name, value in {"DENSE_PAIRS": dense, "DENSE_TERMS": columns, "ADDED_PAIRS": added}.items():
        monkeypatch.setattr(text_search, name, value)
    r, segment, k = np.random.default_rng(4), 8, 3
    w = r.integers(0, 3, (24, 12)) * (r.random((24, 12)) < 0.5) / 4  # entries by term, with many equal scores
    q = r.integers(0, 3, (5, 12)) * (r.random((5, 12)) < 0.4) / 4
    q[0, 0], q[1] = 1, 0
    query, term = np.nonzero(q)
    order = np.lexsort((query, term))
    table = text_search._Asked(0, 5, term[order], query[order], q[query, term][order], k)
    for s in (2, 0, 1):
        code, place = np.nonzero(w[s * segment : (s + 1) * segment].T)
        terms, starts, lens = np.unique(code, return_index=True, return_counts=True)
        scores = table.score(segment, terms, starts, lens, place, w[s * segment + place, code])
        assert scores.shape == (5, segment) and np.allclose(scores, q @ w[s * segment : (s + 1) * segment].T)
        table.keep(scores, s * segment + 1)
        assert len(table.best[0]) <= 5 * k
    every = np.round(q @ w.T, 9)
    want = [(a, e + 1, x) for a in range(5) for x, e in sorted(((every[a, e], e) for e in range(24) if every[a, e] > 0), key=lambda h: (-h[0], h[1]))[:k]]
    assert list(zip(*(x.tolist() for x in table.best))) == want and {a for a, _, _ in want} == {0, 2, 3, 4}


def test_empty_text_index(spark):
    index = text_search.build_text_index(spark.createDataFrame([], "file string, template string, count bigint"))
    assert text_search.search_text(index, spark.createDataFrame([(1, "disk")], "query_id int, text string")).count() == 0


def test_exact_search_with_nulls_ties_and_lengths(spark):
    one, two = [1.0, 0.0], [0.6, 0.8]
    rows = [(k, "t", one) for k in range(50)] + [(None, "t", two), (70, None, two), (70, "a", two), (80, "n", None), (81, "n", [1.0, None]), (82, "n", [1.0]), (83, "n", [])]
    table = spark.createDataFrame(rows, "vec_id bigint, file string, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 3.0]), (3, None), (4, [5.0]), (5, []), (6, [1.0, None])], "query_id int, query array<double>")
    found = {}
    for r in vectors.vector_topk(table, queries, 4).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.file, r.similarity))
    assert sorted(found[1]) == [(k + 1, k, "t", 1.0) for k in range(4)]
    assert sorted(found[2]) == [(1, None, "t", 0.8), (2, 70, None, 0.8), (3, 70, "a", 0.8), (4, 0, "t", 0.0)]
    assert sorted(found[4])[0] == (1, 82, "n", 1.0) and [x[3] for x in sorted(found[4])[1:]] == [None] * 3
    assert [x[3] for x in sorted(found[3])] == [None] * 4 and set(found) >= {1, 2, 3, 4, 6}
    assert vectors.vector_topk(table.limit(0), queries, 4).count() == 0 == vectors.vector_topk(table, queries.limit(0), 4).count()
