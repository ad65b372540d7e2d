import random

import numpy as np
import pyarrow as pa
import pytest

from logweave.llm import common, minhash, vector_links
from logweave.llm.common import connected_components
from logweave.llm.queries import QUERIES

from .helpers import components, edge_docs, empty_docs, near_copies, shingle_set


def test_components(spark):
    r = random.Random(1)
    for n, m in ((40, 0), (60, 30), (300, 290), (200, 600)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(1000, 1050)]
        got = {x.id: x.component_id for x in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
        want = components({x for e in edges for x in e}, edges)
        assert got == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_force(rows, k, percent=80):
    """Component of each id by comparing all sets; rows: (id, text)."""
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingle_set(t, k))
    ids = sorted(sets)
    links = []
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                links.append((a, b))
    return components(ids, links)


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(spark, sf_dir, k):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_force(rows, k)
    got = minhash.near_duplicates(docs, words=k).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, len(shingle_set(t, k)), want[i], want[i] == i) for i, t in rows)


def test_large_group_of_near_copies(spark):
    """Copies around the limit: many link with the middle of their group only, some with nothing."""
    texts = [*near_copies(1, 150, 60, 12), *near_copies(2, 40, 12, 2), *near_copies(3, 60, 200, 40)]
    rows = list(enumerate(texts))
    want = brute_force(rows, 2)
    assert len(set(want.values())) < len(rows) and len({v for v in want.values()}) > 3
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), words=2).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_buckets_in_chunks_without_a_sample_in_the_driver(spark, monkeypatch):
    """Ranges of buckets would send the driver a sample that grows with the number of tasks."""
    monkeypatch.setattr(minhash, "CHUNK", 8, raising=False)
    rows = list(enumerate([*near_copies(1, 150, 60, 12), *near_copies(2, 40, 12, 2)]))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.delattr(type(docs), "repartitionByRange")
    got = minhash.near_duplicates(docs, words=2).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_force(rows, 2)


def test_driver_lets_go_of_bitmaps(spark, monkeypatch):
    sent, send = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(send(self, value)) or sent[-1])
    docs = spark.createDataFrame(list(enumerate(near_copies(1, 40, 60, 12))), "doc_id bigint, text string")
    assert minhash.near_duplicates(docs, words=2).count() == 40
    assert sent and not any(x._jbroadcast.isValid() for x in sent)


def test_stars_need_no_second_round(spark, monkeypatch):
    made, make = [], common.materialise
    monkeypatch.setattr(common, "materialise", lambda df, name: made.append(name) or make(df, name))
    edges = [(k, 1000 + k) for k in range(50)] + [(1, k) for k in range(2000, 2050)]
    got = {x.id: x.component_id for x in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == components({x for e in edges for x in e}, edges)
    assert len(made) == 2


def test_edges(spark):
    got = minhash.near_duplicates(edge_docs(spark), words=2).collect()
    assert len(got) == edge_docs(spark).count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id and r.kept for k in (0, 2, 3) for r in by[k])
    assert by[11][0].component_id == 10 and not by[11][0].kept and by[10][0].kept
    assert by[5][0].component_id == 4  # one word each
    assert by[None][0].component_id is None and by[None][0].kept
    assert minhash.near_duplicates(empty_docs(spark), words=2).count() == 0


def test_estimates_are_close():
    r = random.Random(4)
    pairs = []
    for _ in range(60):
        n, share = r.choice([5, 40, 300]), r.random()
        base = [r.getrandbits(64) for _ in range(n)]
        other = [x if r.random() < share else r.getrandbits(64) for x in base]
        pairs.append((np.unique(np.array(base, np.uint64)), np.unique(np.array(other, np.uint64))))
    flat = [s for p in pairs for s in p]
    regs = minhash.registers(minhash.Ragged(np.concatenate(flat), np.array([len(s) for s in flat])))
    e = minhash.estimate(regs[::2], regs[1::2], np.array([len(a) for a, _ in pairs]), np.array([len(b) for _, b in pairs]))
    true = np.array([len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for a, b in pairs])
    assert np.abs(e - true).max() < 0.2 and abs((e - true).mean()) < 0.03


def test_sets_hold_distinct_shingles():
    texts = ["A b a b", "a  b\tA B", "b", "", None, "a b c"]
    sets = minhash.shingle_sets(pa.array([t or "" for t in texts], pa.large_string()), 2)
    assert sets.lens.tolist() == [len(shingle_set(t, 2)) for t in texts]
    assert (list(sets)[0] == list(sets)[1]).all()


def vector_rows():
    r = np.random.default_rng(8)
    rows, k = [], 0
    for label in (0, 1, None):
        for _ in range(6):
            c = r.standard_normal(16)
            for spread in (0.0, 0.02, 0.05, 0.1, 0.12, 0.15, 0.18):
                rows.append((k, [float(x) for x in c + spread * r.standard_normal(16) * np.linalg.norm(c) / 4], label))
                k += 1
    for bad in (None, [], [0.0] * 16, [None, *[1.0] * 15], [float("nan"), *[1.0] * 15], [float("inf"), *[1.0] * 15], [1.0] * 3, [2.0] * 3, [1e-30] * 16, [3e30] * 16):
        rows.append((k, bad, 0))
        k += 1
    return rows


def test_vector_links_equal_brute_force(spark):
    rows = vector_rows()
    ok = {i: np.array(v, float) for i, v, g in rows if v and g is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    group = {i: g for i, _, g in rows}
    linked = []
    for a in ok:
        for b in ok:
            x, y = (v / np.abs(v).max() for v in (ok[a], ok[b])) if len(ok[a]) == len(ok[b]) else (None, None)
            if a < b and group[a] == group[b] and x is not None and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                linked.append((a, b))
    want = components([i for i, _, _ in rows], linked)
    got = vector_links.vector_links(spark.createDataFrame([(i, v, g, 1) for i, v, g in rows], "vec_id bigint, embedding array<double>, label int, v int")).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, sum(i in p for p in linked), want[i], want[i] == i) for i, _, _ in rows)
    assert linked
    none = spark.createDataFrame([], "vec_id bigint, embedding array<double>, label int")
    assert vector_links.vector_links(none).count() == 0


def test_calibration_reaches_its_recall():
    plan = vector_links.calibrate(5000, 0.93)
    r = np.random.default_rng(2)
    x = r.standard_normal((40, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = r.standard_normal((40, 64))
    y -= (y * x).sum(1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    d = r.standard_normal((64, plan.count))
    p, q = x @ d, y @ d
    both = (np.minimum(p, q) >= plan.tail) | (np.maximum(p, q) <= -plan.tail)
    assert ((both & (np.abs(p - q) <= plan.window)).sum(1) >= vector_links.COLLISIONS).all()


def test_vector_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = QUERIES["op7_vector_links"](spark, sf_dir).collect()
    assert len(got) == len(rows) and all(r.kept == (r.component_id == r.vec_id) for r in got)


@pytest.mark.parametrize("bits", [6, 26])
def test_representatives_stay_whatever_the_bitmap_says(spark, monkeypatch, bits):
    monkeypatch.setattr(minhash, "BITMAP_BITS", bits)
    monkeypatch.setattr(common, "BITMAP_BITS", bits)
    docs = spark.createDataFrame([(r.doc_id, r.text, "x") for r in edge_docs(spark).select("doc_id", "text").collect()] + [(100 + k, t, "y") for k, t in enumerate(near_copies(3, 30, 60, 3))], "doc_id bigint, text string, _stays string")
    found = minhash.near_duplicates(docs)
    gone = {r.doc_id for r in found.where("not kept").collect()}
    kept = minhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in docs.collect() if r.doc_id not in gone)
