from pyspark.sql import functions as F

import corpus_pipeline
from logweave.llm.common import materialise

from .helpers import edge_docs, empty_docs, shingle_set
from .test_groups import brute_force
from .test_tokens import check_packing, expected_words


def labels_dir(spark, tmp_path):
    spark.createDataFrame([(4, 1, 0), (6, 1, 0), (10, 0, 1), (9, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages_over_a_table(spark):
    from tokenizers import Tokenizer

    from logweave.llm.chunks import public_path

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialise(stage(spark, before, sf), f"test-{name}")
        assert after.columns == docs.columns
        was, now = {r.doc_id: r.text for r in before.collect()}, {r.doc_id: r.text for r in after.collect()}
        assert now.items() <= was.items() and 0 < len(now) < len(was)
        gone = set(was) - set(now)
        if name == "near_dedup":
            want = brute_force(list(was.items()), 5)
            assert set(now) == {d for d in was if want[d] == d or not shingle_set(was[d], 5)}
        else:
            column, bad = ("toxic", 1) if name == "toxicity" else ("quality", 0)
            known = [d for d in was if d in labels]
            clean = [d for d in known if labels[d][column] != bad]
            assert len([d for d in clean if d in gone]) <= 0.03 * len(clean)
            dirty = [d for d in known if labels[d][column] == bad]
            assert len([d for d in dirty if d in gone]) >= 0.6 * len(dirty)
        before = after
    word = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    words = expected_words(word, before.collect())
    check_packing(corpus_pipeline.STAGES[-1][1](spark, before, sf).collect(), words)
    assert corpus_pipeline.run(spark, sf).agg(F.sum("length")).first()[0] == sum(len(i) for _, i in words)


def test_stages_on_edge_rows(spark, tmp_path):
    sf = labels_dir(spark, tmp_path)
    for docs in (edge_docs(spark), empty_docs(spark)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            if name == "packing":
                assert (out.count() > 0) == (n > 0)
            else:
                assert out.columns == docs.columns and out.count() <= n
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, edge_docs(spark), sf).collect()}
    assert {0, 2, 3, 10, None} <= kept and 11 not in kept
