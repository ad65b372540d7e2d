"""Search by page signatures gives the rows of the full search, and leaves pages out."""

import random

import pytest

from logweave.operators import search


@pytest.fixture(scope="module")
def stored(spark):
    r = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta"]
    rows = [(f"f{k % 3}", k // 3 + 1, " ".join(r.choice(words) for _ in range(6))) for k in range(9000)]
    rows += [("f0", 3001, "a Needle here"), ("f1", 3001, "nEEdle.and thread"), ("f2", 3001, "ﬂuss ſtraße Kelvin İx ıx"), ("f2", 3002, None), ("f2", 3003, ""), ("f2", 3004, "ab")]
    lines = spark.createDataFrame(rows, "file string, line_no bigint, line string").repartition(3)
    return lines, search.build_search_pages(lines, size=100)


@pytest.mark.parametrize("pattern", ["needle", "NEEDLE\\s", "needle[.]and|kelvin", "straße", "strasse", "st.a", "kel", "ix", "beta gamma beta gamma", "(alpha )+delta$", "", "(", "a|needle", "(?:nee|thr)(?:dle|ead)"])
def test_same_rows(spark, stored, pattern):
    lines, path = stored
    want = sorted(map(tuple, search.search_lines(lines, pattern, 100).collect()))
    assert sorted(map(tuple, search.search_pages(spark, path, pattern).collect())) == want


def test_most_pages_are_skipped(spark, stored):
    _, path = stored
    assert spark.read.parquet(f"{path}/signatures").count() == 93
    assert search.pages_for(spark, path, "needle").count() <= 4
    assert search.pages_for(spark, path, "alpha").count() >= 90
    assert search.pages_for(spark, path, "[an]") is None
