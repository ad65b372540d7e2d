"""Quality by importance resampling with hashed n-gram models and Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import Ragged, blocks
from .common import discard, free_name, materialise, ship
from .toxicity import labelled_sample
from .words import mix, word_hashes

#: Labelled rows used to fit; hash buckets of both models.
SAMPLE_ROWS, BUCKETS = 20_000, 1 << 16
#: How many times a lost good document counts against a kept bad one where the size of the sample is estimated.
GOOD_WEIGHT = 5
#: Features of a passage. A document's weight is that of a passage of this length with the
#: document's mean log ratio, so that texts of all lengths compare.
PASSAGE = 100


@dataclass(frozen=True)
class ResamplingModel:
    """ratios: log of the target's share over the raw share, by bucket; cut: log weight down to which documents count where the size of the sample is estimated; seed: of the noise."""

    ratios: np.ndarray
    cut: float
    seed: int


def _features(texts: pa.Array) -> Ragged:
    """Buckets of each text's words and pairs of neighbouring words."""
    h = word_hashes(texts)
    n = len(h.flat)
    one = (mix(h.flat) % np.uint64(BUCKETS)).astype(np.int64)
    two = (mix(h.flat * np.uint64(3) + np.roll(mix(h.flat), -1)) % np.uint64(BUCKETS)).astype(np.int64) if n else one
    inside = np.ones(n, bool)
    inside[(h.starts + h.lens - 1)[h.lens > 0]] = False  # a text's last word has no neighbour
    flat = np.stack([one, two], 1).ravel()[np.stack([np.ones(n, bool), inside], 1).ravel()]
    return Ragged(flat, np.maximum(2 * h.lens - 1, 0))


def _bucket_counts(texts: DataFrame, text_col: str) -> np.ndarray:
    """Counts of all buckets over all texts: BUCKETS numbers a task, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, block in blocks(batch, text_col):
                total += np.bincount(_features(block).flat, minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": held, "n": total[held]})

    out = np.zeros(BUCKETS)
    for r in texts.select(text_col).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def _weights(texts: pa.Array, ratios: np.ndarray) -> np.ndarray:
    """Log importance weight of a passage of each text; of a text without words 0."""
    found = _features(texts)
    sums = np.concatenate([[0.0], np.cumsum(ratios[found.flat])])
    stops = found.starts + found.lens
    whole = np.round(sums[stops] - sums[found.starts], 6)  # the same wherever the text stands in its block
    return PASSAGE * whole / np.maximum(found.lens, 1)


def _gumbel(names: np.ndarray, seed: int) -> np.ndarray:
    """Standard Gumbel noise that depends on the 64-bit hash of an id alone."""
    u = (mix(mix(names.view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)) + np.uint64(1)) >> np.uint64(11)).astype(np.float64)
    return -np.log(-np.log((u + 0.5) / 2.0**53))


def _name(id_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("string"))


def fit_resampling(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 17) -> ResamplingModel:
    """Generative models of target and raw text over hashed words and word pairs.

    At most ``sample_rows`` labelled rows are used (the documented bound). The target model is
    fitted on one half of the good ones (label 1), the raw model on all documents. ``cut`` is
    set with the other half and the bad ones (label 0): where the share of good rows kept,
    ``GOOD_WEIGHT`` times, and that of bad rows rejected have the largest sum; of equal cuts
    the lowest. It only gives the size of a sample of which no size is asked. Without good or
    without bad rows that is the whole corpus.
    """
    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels, label_col, sample_rows, id_col, text_col)
    half = F.pmod(F.xxhash64("text"), F.lit(2)) == 0
    target = _bucket_counts(sample.where((F.col("label") == 1) & half).select("text"), "text")
    raw = _bucket_counts(docs, text_col)
    if not target.sum():
        return ResamplingModel(np.zeros(BUCKETS), -np.inf, seed)
    ratios = np.log((target + 0.5) / (target.sum() + 0.5 * BUCKETS)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * BUCKETS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, block in blocks(batch, "text"):
                yield pa.RecordBatch.from_pydict({"id": batch.column("id").slice(first, len(block)), "w": _weights(block, ratios), "label": batch.column("label").slice(first, len(block))})

    others = sample.where((F.col("label") == 0) | ~half).select(F.xxhash64("_id").alias("id"), "text", "label")
    rows = others.mapInArrow(run, "id bigint, w double, label int").distinct().collect()  # at most sample_rows numbers
    good, bad = (np.sort([r["w"] for r in rows if (r["label"] == 1) == k]) for k in (True, False))
    if not len(good) or not len(bad):
        return ResamplingModel(ratios, -np.inf, seed)
    cuts = np.unique(np.concatenate([good, bad]))
    gain = GOOD_WEIGHT * (1 - np.searchsorted(good, cuts) / len(good)) + np.searchsorted(bad, cuts) / len(bad)
    at = int(np.argmax(np.round(gain, 9)))
    # Halfway to the next lower row of the sample.
    return ResamplingModel(ratios, float((cuts[at] + cuts[max(at - 1, 0)]) / 2), seed)


def resampling_keys(docs: DataFrame, model: ResamplingModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its id, ``log_weight`` (target over raw, from the whole text) and ``key`` (with Gumbel noise)."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            noise = _gumbel(batch.column("_name").to_numpy(), model.seed)
            for first, texts in blocks(batch, "_text"):
                w = _weights(texts, model.ratios)
                yield pa.RecordBatch.from_pydict({id_col: batch.column("_id").slice(first, len(texts)), "log_weight": w, "key": w + noise[first : first + len(texts)]})

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), _name(id_col).alias("_name"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, log_weight double, key double")


def kth_largest(keys: DataFrame, k: int, column: str = "key", bins: int = 4096) -> float:
    """The ``k``-th largest number of a column, exactly, without a global sort.

    Each round counts the numbers of ``bins`` equal bins (combined before the shuffle) and
    goes on in the bin that holds the one sought, until all numbers there are equal.
    """
    lo, hi = keys.agg(F.min(column), F.max(column)).first()
    inside, left = keys.select(column), k
    while lo < hi:
        width = (hi - lo) / bins
        if width == 0 or lo + width == lo:  # neighbouring numbers: few distinct ones are left
            rows = inside.groupBy(column).count().orderBy(F.desc(column)).collect()
            for value, n in rows:
                left -= n
                if left <= 0:
                    return value
        bin_of = F.least(F.floor((F.col(column) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
        counted = inside.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for r in sorted(counted, key=lambda r: -r["bin"]):
            if left <= r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            left -= r["n"]
        inside = inside.where(F.col(column).between(lo, hi))
    return lo


def _threshold(keys: DataFrame, model: ResamplingModel, k: int | None) -> float:
    """The key of the last document that top-k takes."""
    if k is None:
        k = keys.where(F.col("log_weight") >= model.cut).count()
    k = min(k, keys.count())
    return kth_largest(keys, k) if k > 0 else float("inf")


def resample(docs: DataFrame, model: ResamplingModel, k: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Gumbel top-k sample without replacement: all documents with ``log_weight``, ``key`` and ``kept``.

    Each document's key is its log importance weight plus standard Gumbel noise; kept are
    those whose key is among the ``k`` largest (with all that tie with the k-th). So documents
    are drawn one after the other in proportion to their weights. Without ``k`` the sample is
    as large as the target-like part of the corpus: the number of documents, counted over
    all, whose log weight reaches the model's cut.

    A null or empty text has log weight 0. Ids may be of any type; rows of equal id, and all
    rows without id, share their noise. Other columns are ignored; an empty table stays empty.
    """
    keys = materialise(resampling_keys(docs, model, id_col, text_col), "keys")
    return keys.withColumn("kept", F.col("key") >= F.lit(_threshold(keys, model, k)))


def keep_target_like(docs: DataFrame, model: ResamplingModel, k: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``resample`` keeps.

    Keys are computed anew where rows are filtered, so that no text is shuffled.
    """
    keys = materialise(resampling_keys(docs, model, id_col, text_col).drop(id_col), "keys")
    cut = _threshold(keys, model, k)
    discard(keys)
    names = free_name(docs, "_name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            noise = _gumbel(batch.column(names).to_numpy(), model.seed)
            rows = batch.drop_columns([names])
            for first, texts in blocks(batch, text_col):
                kept = _weights(texts, model.ratios) + noise[first : first + len(texts)] >= cut
                yield rows.slice(first, len(texts)).filter(pa.array(kept))

    return docs.withColumn(names, _name(id_col)).mapInArrow(run, docs.schema)
