"""Queries and operators do the whole job: nothing is left out, capped or forced."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logweave.functions.entities import ANY_LEVEL, ENTITIES, REQUIRED, may_hold
from logweave.functions.text import MASKS
from logweave.operators import search, templates, vectors
from logweave.operators.templates import WILDCARD
from logweave.plans import inputs
from logweave.plans.queries import QUERIES

PARSED = "file string, line_no bigint, loglines string"


def mined(spark, lines, **options):
    rows = spark.createDataFrame([("a", k, x) for k, x in enumerate(lines)], PARSED)
    return {r.loglines: r.template for r in templates.mine_templates(rows, **options).select("loglines", "template").collect()}


def test_every_document_line_gets_a_template(spark, sf_dir):
    lines = inputs.document_lines(spark, sf_dir)
    assert lines.where("length(line) > 80").count() > 0
    found = QUERIES["mine_document_templates"](spark, sf_dir)
    assert found.where("template is not null").select("file", "line_no").distinct().count() == lines.count()


def test_full_buckets_are_split_not_forced(spark):
    names = [a + b + c for a in "qwert" for b in "zxcvb" for c in "asdfg"]
    different = [f"go {n} {n}x {n}y" for n in names]
    same = [f"user {n} logged in" for n in names]
    found = mined(spark, different + same, max_clusters=8)
    assert [found[x] for x in different] == different
    assert {found[x] for x in same} == {f"user {WILDCARD} logged in"}
    # Words with digits, which count alike at first.
    found = mined(spark, [f"x{n}1y" for n in names], max_clusters=8)
    assert all(k == v for k, v in found.items())


def test_more_queries_than_one_block(spark, sf_dir, monkeypatch):
    v = inputs.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")).repartition(3)
    want = sorted(map(tuple, vectors.vector_topk(v, q, 5).select("query_id", "vec_id", "similarity", "rank").collect()))
    monkeypatch.setattr(vectors, "MAX_QUERIES", 7)
    assert len(want) > 5 * 7
    assert sorted(map(tuple, vectors.vector_topk(v, q, 5).select("query_id", "vec_id", "similarity", "rank").collect())) == want
    assert max(b.count() for b in vectors.query_blocks(q, 7)) == 7


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_recall_of_approximate_search(spark, folder):
    exact, near = ({(r.query_id, r.vec_id) for r in QUERIES[n](spark, folder).collect()} for n in ("vector_topk_batch", "approx_topk"))
    assert {q for q, _ in near} == {q for q, _ in exact}
    assert len(exact & near) >= 0.9 * len(exact)


TEXT = [
    "2024-03-01 10:00:05 GET /var/log/a.txt from 10.0.0.1 --depth=3 -v [wifi] ERROR",
    "Mar  1 10:00:05 host 192.168.1.300 C:\\logs\\x.txt aa:bb:cc:dd:ee:ff ok",
    "net 10.1.2.3/24 and 7.8 of 99 items, aa:bb:cc:dd:ee:ff/8, at 12:13:14 done-x --flag",
]


@pytest.fixture(scope="module")
def small(spark, sf_dir, tmp_path_factory):
    """A folder with documents of TEXT and the events of the smallest tables."""
    folder = str(tmp_path_factory.mktemp("small"))
    spark.createDataFrame([(1, "s", "\n".join(TEXT))], "doc_id bigint, source string, text string").write.parquet(f"{folder}/documents.parquet")
    inputs.table(spark, sf_dir, "events").write.parquet(f"{folder}/events.parquet")
    return folder


def test_all_masks(spark, small):
    def masked(x):
        for pattern, name in MASKS:
            x = re.sub(pattern, f"<{name}>", x, flags=re.A)
        return x

    got = [r.masked for r in QUERIES["mask_all_values"](spark, small).orderBy("line_no").collect()]
    assert got == [masked(x) for x in TEXT] and any("<NUM>" in x for x in got)


def test_all_entity_kinds(spark, small):
    lines = [("s.log", x) for x in TEXT] + [(r.file, r.line) for r in inputs.event_logs(spark, small).collect()]
    want = Counter((f, kind, m[0]) for f, x in lines for kind, p in ENTITIES for m in re.finditer(p, x, re.I | re.A))
    got = {(r.file, r.kind, r.text): r["count"] for r in QUERIES["entity_counts_all"](spark, small).collect()}
    assert got == want
    assert {k for _, k, _ in got} >= {"timestamp", "ip", "path", "cli", "mac", "module", "error", "info"}


def test_entity_patterns_meet_lines_with_their_texts_only(spark):
    """No line that may match is left out, in whatever case, and a line of prose meets no pattern."""
    r, parts = random.Random(3), ["err", "Error", "ERRORS", "oFf", "passed", "Warn", "[a-b]", "]x[", "10.0.0.7", "٣.4.5.6", "/a/b", "C:\\x\\y", "c:/x", "--Go=1", " -v", "a-v", "aa:bb-cc:dd:ee:ff", "1:2:3:4:5:6:7:f", "Mar 3 10:11:12", "2024-01-02T10:11:12Z", "10:11:12.345", "_ok", "İnfo", "ınfo", "ſuccess", " ", " ", "x", "\n"]
    lines = [("a" if k % 2 else None, "".join(r.choice(parts) for _ in range(r.randrange(9)))) for k in range(600)] + [("a", None), ("a", "")]
    df = spark.createDataFrame(lines, "file string, line string")
    every = df.select("file", *[F.regexp_extract_all("line", F.lit(f"(?i)({p})"), 1).alias(f"m{k}") for k, (_, p) in enumerate(ENTITIES)]).collect()
    want = Counter((row.file, kind, x) for row in every for (kind, _), found in zip(ENTITIES, row[1:]) for x in found or [])
    for kinds in (None, ["ip", "cli"], ["error", "path"]):
        got = {(x.file, x.kind, x.text): x["count"] for x in search.entity_counts(df, kinds).collect()}
        assert got == {k: n for k, n in want.items() if kinds is None or k[1] in kinds}
    assert {k for _, k, _ in want} == {k for k, _ in ENTITIES}
    prose = spark.createDataFrame([("An offer of okra, in detailed passages.",)], "line string")
    may = [may_hold(F.col("line"), p) for _, p in ENTITIES if p in REQUIRED] + [F.col("line").rlike(ANY_LEVEL)]
    assert not any(prose.select(*[m.alias(str(k)) for k, m in enumerate(may)]).first())


def test_all_reports_and_templates(spark, small):
    events = inputs.table(spark, small, "events").collect()
    wide = {(r.device, r.report_id): (r.click, r.purchase) for r in QUERIES["telemetry_wide_all"](spark, small).collect()}
    assert set(wide) == {(str(e.user_id), e.event_id) for e in events if e.event_type in ("click", "purchase")}
    assert all((c is None) != (p is None) for c, p in wide.values())
    assert {r.line_no for r in QUERIES["drilldown_all"](spark, small).collect()} == {e.event_id for e in events}
