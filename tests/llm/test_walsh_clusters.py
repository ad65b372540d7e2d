"""Walsh-Hadamard search and clustering against plain distances."""

import hashlib
import math

import numpy as np

from logweave.llm.walsh_clusters import LIMIT, SIZE, cluster_vectors, nearest, walsh_hadamard


def plain(x, c):
    d = ((x[:, None].astype(object) - c[None].astype(object)) ** 2).sum(2)
    at = [min(range(len(c)), key=lambda k: (row[k], k)) for row in d]
    return at, [int(row[k]) for row, k in zip(d, at)]


def test_transform_keeps_distances():
    r = np.random.default_rng(1)
    a, b = r.integers(-LIMIT + 1, LIMIT, (2, 5, SIZE))
    t = walsh_hadamard(a) - walsh_hadamard(b)
    assert (t.astype(object) ** 2).sum(1).tolist() == [64 * x for x in ((a - b).astype(object) ** 2).sum(1).tolist()]
    smooth = walsh_hadamard(np.repeat(r.integers(0, 9, (1, 4)), 16, axis=1))[0]
    assert smooth[:4].any() and not smooth[4:].any()


def test_nearest_with_ties_and_large_numbers():
    r = np.random.default_rng(2)
    for scale in (2, 50, LIMIT - 1):
        x, c = r.integers(-scale, scale, (300, SIZE)), r.integers(-scale, scale, (16, SIZE))
        c[5], c[9], x[:40] = c[2], c[0], c[r.integers(0, 16, 40)]
        at, distance = nearest(x, c)
        want = plain(x, c)
        assert at.tolist() == want[0] and distance.tolist() == want[1]
    assert [len(v) for v in nearest(np.zeros((0, SIZE), int), c)] == [0, 0]


def brute(rows, k=16):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == SIZE and all(x is not None and math.isfinite(x) and abs(64 * x) < LIMIT for x in v)]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = np.array([v for _, v in named])
    x = np.array([v for _, v in kept])
    for _ in range(3):
        at = np.array(plain(x, c)[0])
        c = np.array([[sum(col) // len(col) for col in x[at == j].T.tolist()] if (at == j).any() else c[j] for j in range(len(c))])
    at, d = plain(x, c)
    inertia = [sum(e for a, e in zip(at, d) if a == j) for j in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, v.tolist())).encode()).hexdigest() for v in c]
    return sorted(((i, a, e, inertia[a], sum(d), sha[a]) for (i, _), a, e in zip(kept, at, d)), key=str)


def test_edges(spark):
    r = np.random.default_rng(3)
    vectors = r.normal(size=(200, SIZE)).astype(np.float32).tolist()
    rows = [(k, v, 1) for k, v in enumerate(vectors)]
    rows += [(5, vectors[5], 2), (5, vectors[6], None), (None, vectors[7], 1), (300, None, 1), (301, [], 1), (302, vectors[1][:63], 1), (303, [None] + vectors[1][1:], 1)]
    rows += [(304, [math.nan] + vectors[1][1:], 1), (305, [math.inf] + vectors[1][1:], 1), (306, [3e38] + vectors[1][1:], 1), (307, [0.0] * SIZE, 1), (308, vectors[9] + [1.0], 1)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, cluster int").repartition(3)
    assert sorted(map(tuple, cluster_vectors(table).collect()), key=str) == brute([(a, b) for a, b, _ in rows])
    few = table.where("vec_id < 3")
    assert sorted(map(tuple, cluster_vectors(few).collect()), key=str) == brute([(a, b) for a, b, _ in rows[:3]])
    assert cluster_vectors(table.limit(0)).count() == 0 and cluster_vectors(table.where("vec_id is null")).count() == 0
