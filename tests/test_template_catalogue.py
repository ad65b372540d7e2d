"""Mining from run to run against one run, and against a plain sequential miner."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from logweave.operators.template_catalogue import TemplateCatalogue, mine_into
from logweave.operators.templates import mine_templates
from logweave.plans import inputs
from logweave.streaming import streams

PARSED = "file string, line_no bigint, loglines string"


def sequential(lines, similarity=0.5):
    """Templates by now after each line, as a fixed-depth miner gives them: length, first words, largest share of equal words."""
    buckets, out = {}, []
    for line in lines:
        words = line.split()
        n = min(6, max(1, len(words) // 3))
        prefix = tuple("<*>" if any(c.isdigit() for c in w) else w for w in words[:n])
        clusters = buckets.setdefault((len(words), prefix), [])
        share = [sum(a == b for a, b in zip(c, words)) / len(words) for c in clusters]
        if share and max(share) >= similarity:
            c = clusters[share.index(max(share))]
            c[:] = [a if a == b else "<*>" for a, b in zip(c, words)]
        else:
            c = list(words)
            clusters.append(c)
        out.append(c)
    return [" ".join(c) for c in out]


def lines_of(seed, n):
    r = random.Random(seed)
    return [" ".join(r.choice(w) for w in (["user", "host"], ["alice", "bob", "eve"], ["in", "out"], ["at", "from"], ["here", "there", "x"][: r.randrange(1, 4)])) for _ in range(n)]


def found(df):
    return {(r.file, r.line_no): (r.cluster_id, r.template) for r in df.collect()}


def test_runs_equal_one_run_and_the_loop(spark, tmp_path):
    rows = [(f"f{k // 60}", k, x) for k, x in enumerate(lines_of(1, 180))]
    df = spark.createDataFrame(rows, PARSED)
    whole = found(mine_into(TemplateCatalogue(spark, str(tmp_path / "one")), df))
    distinct = list(dict.fromkeys(x for *_, x in rows))  # a line that comes again stays where it went first
    want = dict(zip(distinct, sequential(distinct)))
    assert [whole[(f, k)][1] for f, k, _ in rows] == [want[x] for *_, x in rows]
    parts = TemplateCatalogue(spark, str(tmp_path / "three"))
    ids = {}
    for f in ("f0", "f1", "f2"):
        now = found(mine_into(parts, df.where(F.col("file") == f)))
        ids |= {k: v[0] for k, v in now.items()}
    assert ids == {k: v[0] for k, v in whole.items()}
    assert found(mine_into(parts, df)) == whole  # nothing new
    assert parts.last_run() == 4
    assert {(r.file, r.line_no): r.template for r in mine_templates(df).collect()} == {k: v[1] for k, v in whole.items()}


def test_runs_equal_one_run_on_the_tables(spark, sf_dir, tmp_path):
    lines = inputs.parsed_events(spark, sf_dir)
    whole = found(mine_into(TemplateCatalogue(spark, str(tmp_path / "one")), lines))
    parts = TemplateCatalogue(spark, str(tmp_path / "two"))
    first = found(mine_into(parts, lines.where("file < 'dev4.log'")))
    second = found(mine_into(parts, lines.where("file >= 'dev4.log'")))
    assert {k: v[0] for k, v in (first | second).items()} == {k: v[0] for k, v in whole.items()}
    assert len(set(whole.values())) == 5


def test_large_buckets_keep_ids(spark, tmp_path):
    names = [a + b + c for a in "qwert" for b in "zxcvb" for c in "asd"]
    catalogue = TemplateCatalogue(spark, str(tmp_path / "c"))
    frame = lambda f, lines: spark.createDataFrame([(f, k, x) for k, x in enumerate(lines)], PARSED)
    first = found(mine_into(catalogue, frame("a", ["go up now x1 y", "stop it all here z"]), max_clusters=8))
    more = [f"go up now {n} {m}" for n in names[:40] for m in ("k", "l")] + [f"stop {n} {n}x {n}y {n}z" for n in names]
    second = found(mine_into(catalogue, frame("b", more), max_clusters=8))
    assert {v[0] for k, v in second.items() if k[1] < 80} == {first[("a", 0)][0]} and second[("b", 0)][1] == "go up now <*> <*>"
    rest = [second[("b", 80 + k)] for k in range(len(names))]
    assert len(set(rest)) == len(names) and [t for _, t in rest] == more[80:] and min(i for i, _ in rest) > 2


def test_a_run_that_breaks_off_is_no_run(spark, tmp_path):
    catalogue = TemplateCatalogue(spark, str(tmp_path / "c"))
    df = spark.createDataFrame([("a", 1, "link up now"), ("a", 2, None), ("a", 3, "")], PARSED)
    one = found(mine_into(catalogue, df))
    assert one[("a", 2)] == (None, None) and one[("a", 3)][1] == ""
    catalogue.members().write.parquet(f"{catalogue.path}/members-2")  # but no clusters
    assert catalogue.last_run() == 1 and catalogue.members().count() == 2
    assert found(mine_into(catalogue, df)) == one and catalogue.last_run() == 2
    assert mine_into(catalogue, df.limit(0)).count() == 0


@pytest.mark.parametrize("ttl", [None, datetime.timedelta(days=1)])
def test_stream_equals_batch_over_a_restart(spark, tmp_path, ttl):
    (tmp_path / "in").mkdir()
    lines = lines_of(3, 120)

    def mined(total):
        out = streams.stream_mine_templates(streams.stream_log_lines(spark, str(tmp_path / "in"), max_files=1), ttl=ttl)
        writer = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
        if ttl is None:
            writer.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)
        else:  # with times to live, Spark makes batches as long as the query runs
            q = writer.trigger(processingTime="1 second").start(str(tmp_path / "out"))
            until = time.time() + 120
            while time.time() < until and (not q.lastProgress or sum(p["numInputRows"] for p in q.recentProgress) < total):
                time.sleep(1)
            q.stop()
        return [(r.bucket, r.cluster, r.template, r.lines) for r in spark.read.parquet(str(tmp_path / "out")).collect()]

    (tmp_path / "in" / "a.log").write_text("\n".join(lines[:60]) + "\n")
    first = mined(60)
    (tmp_path / "in" / "b.log").write_text("\n".join(lines[60:]) + "\n")
    second = mined(60)  # a new query on the old checkpoint
    assert len(second) > len(first) and sum(n for *_, n in second) == 120
    # The last text of each cluster, and its lines, are those of the batch in order of the files.
    latest = {}
    for bucket, cluster, template, n in second:
        t, m = latest.get((bucket, cluster), ("", 0))
        latest[(bucket, cluster)] = (max(t, template, key=lambda x: x.count("<*>")), m + n)
    want = {}
    for t in sequential(lines):
        want[t] = want.get(t, 0) + 1
    got = {}
    for t, n in latest.values():
        got[t] = got.get(t, 0) + n
    assert got == want
