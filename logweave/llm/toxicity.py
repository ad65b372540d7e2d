"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import blocks
from .common import discard, materialise, ship

#: Labelled rows used to fit, those of the smallest hash of the id; windows of each kind used
#: to train, those of the smallest hash: the documented bounds of the labelled sample.
SAMPLE_ROWS, TRAIN_WINDOWS = 8_000, 200_000
#: Words of a window that trains, and of one that is measured.
WORDS, MEASURED = 3, 1
#: Bytes of the ordinary dictionary and of each of the toxic ones; how often the toxic one is trained, in another order each time.
ORDINARY_BYTES, TOXIC_BYTES, TRAININGS = 32_000, 8_192, 8
#: How many times as large the share of toxic texts with a run of bytes has to be as that of
#: ordinary texts for the run to stay in a toxic dictionary; from half of it on, it leaves the ordinary one.
LEAN = 4.0
#: Margins (bytes) told apart in the score.
MARGINS = 8
#: Bytes of a run. A window without a run that the toxic dictionary holds and the ordinary one does not has margin 0.
GRAM = 6
#: Bytes of text handled at once.
_BLOCK = 1_000_000
#: Every window ends with this text, as both dictionaries do: a window then always compresses,
#: and its own bytes do not stand in the last few, which zstandard does not look up.
_TAIL = b"<the window ends here>"


@dataclass(frozen=True)
class ToxicityModel:
    """ordinary, toxic: the trained dictionaries, less the runs that tell nothing; weights: of the ``_features`` of a text's hits."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


def train(windows: list[bytes], size: int, segment: int = 12) -> bytes:
    """A dictionary of at most ``size`` bytes trained by zstandard; of too few or too uniform windows, their last bytes."""
    import zstandard

    size = min(size, max(512, sum(map(len, windows)) // 2))
    try:
        return zstandard.train_dictionary(size, windows, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(windows)[-size:]


class Margins:
    """By how many bytes a toxic dictionary shortens windows that the ordinary one has shortened already."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard

        level = zstandard.ZstdCompressionParameters.from_level(6, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)

        def compressor(content: bytes):
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=level)
            return zstandard.ZstdCompressor(dict_data=held, compression_params=level)

        # The ordinary text stands at the same distance in both, so that it costs the same.
        self.without = compressor(b"\n" * len(toxic) + ordinary + _TAIL)
        self.with_it = compressor(toxic + ordinary + _TAIL)
        ours = _grams(np.frombuffer(toxic, np.uint8))
        self.telling = np.zeros(1 << 23, bool)
        self.telling[ours] = True
        self.telling[_grams(np.frombuffer(ordinary, np.uint8))] = False

    def __call__(self, windows: list[bytes]) -> np.ndarray:
        if not windows:
            return np.zeros(0, np.int64)
        windows = [w + _TAIL for w in windows]
        a, b = (c.multi_compress_to_buffer(windows) for c in (self.without, self.with_it))
        return np.fromiter([len(a[k]) - len(b[k]) for k in range(len(windows))], np.int64, len(windows))


def _runs(data: np.ndarray) -> np.ndarray:
    """The ``GRAM`` bytes from each position on, as one number."""
    n = max(len(data) - GRAM + 1, 0)
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h = (h << np.uint64(8)) | data[k : k + n]
    return h


def _grams(data: np.ndarray) -> np.ndarray:
    """A 23-bit hash of the ``GRAM`` bytes from each position on."""
    return ((_runs(data) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(41)).astype(np.int64)


class Windows:
    """All windows of a block of texts: runs of so many lower-case words (letters only) with single blanks around."""

    def __init__(self, texts: pa.Array, size: int = WORDS):
        plain = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\pL]+", " "), " ")
        blank, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
        plain = pc.if_else(pc.equal(plain, none), none, pc.binary_join_element_wise(blank, plain, blank, none))
        lens = pc.binary_length(plain).to_numpy(zero_copy_only=False).astype(np.int64)
        self.bytes = b"".join(plain.cast(pa.large_binary()).to_pylist())
        self.data = np.frombuffer(self.bytes, np.uint8)
        self.lens = lens
        blanks = np.flatnonzero(self.data == 32)
        ends = np.cumsum(lens)
        first = np.searchsorted(blanks, ends - lens)
        words = np.maximum(np.searchsorted(blanks, ends) - first - 1, 0)
        #: Windows of each text; a text of fewer words is one window.
        self.counts = np.where(words > 0, np.maximum(words - size + 1, 1), 0)
        self.owner = np.repeat(np.arange(len(lens)), self.counts)
        nth = np.arange(len(self.owner)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)
        at = first[self.owner]
        self.starts = blanks[at + nth] if len(blanks) else nth
        self.stops = blanks[at + np.minimum(nth + size, words[self.owner])] + 1 if len(blanks) else nth

    def take(self, which: np.ndarray) -> list[bytes]:
        return [self.bytes[a:b] for a, b in zip(self.starts[which].tolist(), self.stops[which].tolist())]

    def hits(self, margins: Margins) -> np.ndarray:
        """Per text: the windows with a margin of at least 1, 2, .. ``MARGINS`` bytes, and all windows."""
        out = np.zeros((len(self.counts), MARGINS + 1), np.int64)
        out[:, MARGINS] = self.counts
        seen = np.concatenate([[0], np.cumsum(margins.telling[_grams(self.data)])])
        last = np.clip(self.stops - GRAM + 1, 0, len(seen) - 1)
        which = np.flatnonzero(seen[last] > seen[np.minimum(self.starts, last)])
        found = np.minimum(margins(self.take(which)), MARGINS)
        for k in range(MARGINS):
            out[:, k] = np.bincount(self.owner[which[found > k]], minlength=len(out))
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, id_col: str, text_col: str) -> DataFrame:
    """Texts and labels of at most ``rows`` labelled documents, those of the smallest id hash.

    Rows with a null id or label are left out; of contradicting labels the larger counts; of
    several texts of one id that of the smallest hash counts. Equal rows are all returned.
    Returns ``_id``, ``text`` and ``label``; texts are not shuffled.
    """
    some = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("label"))
    some = some.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(some), "_id")  # at most ``rows`` ids
    first = found.groupBy("_id").agg(F.min(F.xxhash64("text")).alias("_first"))  # at most ``rows`` rows
    return found.join(F.broadcast(first), "_id").where(F.xxhash64("text") == F.col("_first")).select("_id", "text", "label")


def _pools(texts: DataFrame) -> dict[int, list[bytes]]:
    """Windows of the texts of each ``kind``, in the order of their hashes; at most ``TRAIN_WINDOWS`` each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, block in blocks(batch, "text", _BLOCK):
                w = Windows(block)
                owner = pa.array(w.owner)
                kind, name = (batch.column(c).slice(first, len(block)).take(owner) for c in ("kind", "name"))
                yield pa.RecordBatch.from_pydict({"window": pa.array(w.take(np.arange(len(w.owner))), pa.binary()), "kind": kind, "name": name, "start": w.starts - (np.cumsum(w.lens) - w.lens)[w.owner]})

    seen = texts.select("text", "kind", F.xxhash64("text").alias("name")).mapInArrow(run, "window binary, kind int, name bigint, start bigint")
    seen = materialise(seen.select("window", "kind", F.xxhash64("name", "start").alias("at")), "windows")
    # At most ``TRAIN_WINDOWS`` windows a kind.
    out = {k: seen.where(F.col("kind") == k).orderBy("at", "window").limit(TRAIN_WINDOWS).select("window").toArrow().column("window").to_pylist() for k in (0, 1, 2)}
    discard(seen)
    return out


def _text_counts(texts: DataFrame, runs: np.ndarray) -> np.ndarray:
    """In how many texts of each kind (rows: 0, 1, 2) each of the (sorted) runs stands: at most three numbers a run and task, summed by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, len(runs)), np.int64)
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            for first, block in blocks(batch, "text", _BLOCK):
                w = Windows(block, MEASURED)
                found = _runs(w.data)
                at = np.minimum(np.searchsorted(runs, found), len(runs) - 1)
                here = np.flatnonzero(runs[at] == found)
                owner = np.searchsorted(np.cumsum(w.lens), here, "right")
                pairs = np.unique(owner * len(runs) + at[here])
                np.add.at(total, (kinds[first + pairs // len(runs)], pairs % len(runs)), 1)
        kind, run = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"kind": pa.array(kind, pa.int32()), "run": run, "n": total[kind, run]})

    out = np.zeros((3, len(runs)), np.int64)
    if len(runs):
        sums = texts.select("text", "kind").mapInArrow(count, "kind int, run bigint, n bigint").groupBy("kind", "run").agg(F.sum("n").alias("n")).toArrow()
        out[sums.column("kind").to_numpy(), sums.column("run").to_numpy()] = sums.column("n").to_numpy()
    return out


def _leaning(toxic: np.ndarray, toxic_texts: int, ordinary: np.ndarray, ordinary_texts: int, times: float) -> np.ndarray:
    """Whether a run stands in ``times`` as many toxic texts as ordinary texts let expect, and in more than chance explains (four standard deviations and one text)."""
    expected = (ordinary + 1) / max(ordinary_texts, 1) * toxic_texts
    return (toxic >= times * expected) & (toxic >= expected + 4 * np.sqrt(expected) + 1)


def _stretches(content: bytes, runs: np.ndarray, inside: bool) -> list[bytes]:
    """The stretches of a dictionary that the given runs cover, or those that they leave."""
    data = np.frombuffer(content, np.uint8)
    change = np.zeros(len(data) + 1, np.int64)
    at = np.flatnonzero(np.isin(_runs(data), runs))
    np.add.at(change, at, 1)
    np.add.at(change, at + GRAM, -1)
    chosen = (np.cumsum(change[:-1]) > 0) == inside
    edges = np.flatnonzero(np.diff(np.concatenate([[False], chosen, [False]])))
    return [content[a:b] for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]


def train_dictionaries(texts: DataFrame) -> tuple[bytes, bytes, list[bytes]]:
    """The ordinary dictionary, the toxic one, and for each half of the toxic texts one of the other half alone.

    ``texts`` holds distinct texts and their ``kind``: 0 ordinary, 1 and 2 the toxic halves.
    Dictionaries are trained on windows of one kind each. Most of what a toxic text holds is
    ordinary, and ordinary texts hold rare toxic strings, so both dictionaries are then
    cleaned by what they are to tell apart: a toxic one keeps the runs of bytes that stand in
    far more of its toxic texts than of the ordinary ones (``_leaning``), the ordinary one
    loses those that lean to toxic texts. The first 8 bytes, by which zstandard knows its
    dictionaries, stay.
    """
    pools = _pools(texts)
    sizes = {r["kind"]: r["n"] for r in texts.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    common = train(pools[0], ORDINARY_BYTES, 16)
    trained = []  # of the other half than the one at the same place
    for other in (2, 1):
        orders = (np.random.default_rng(k).permutation(len(pools[other])) for k in range(TRAININGS))
        trained.append([train([pools[other][i] for i in order], TOXIC_BYTES, 16) for order in orders] if pools[other] else [])
    runs = np.unique(np.concatenate([_runs(np.frombuffer(d, np.uint8)) for d in (common, *trained[0], *trained[1])]))
    ordinary, first, second = _text_counts(texts, runs)
    n, n1, n2 = (sizes.get(k, 0) for k in (0, 1, 2))
    each, stretches = [], []
    for dictionaries, found, size in ((trained[0], second, n2), (trained[1], first, n1)):
        lean = runs[_leaning(found, size, ordinary, n, LEAN)]
        kept = list(dict.fromkeys(x for d in dictionaries for x in _stretches(d, lean, True)))
        stretches += kept
        each.append(b"\n".join([d[:8] for d in dictionaries[:1]] + kept))
    common = b"\n".join(_stretches(common, runs[_leaning(first + second, n1 + n2, ordinary, n, LEAN / 2)], False))
    return common, b"\n".join([d[:8] for d in (trained[0] or trained[1])[:1]] + sorted(set(stretches))), each


def _features(hits: np.ndarray) -> np.ndarray:
    """Logarithms of the counts, percentages of the hits, and a constant."""
    return np.concatenate([np.log1p(hits), 100 * hits[:, :MARGINS] / np.maximum(hits[:, MARGINS:], 1), np.ones((len(hits), 1))], 1)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression with a small quadratic penalty, by Newton's method."""
    w = np.zeros(x.shape[1])
    penalty = np.ones(len(w))
    penalty[-1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Train both dictionaries and calibrate the score on labelled documents.

    At most ``sample_rows`` labelled rows are used (the documented bound of the sample), each
    with its whole text; equal texts train once. One dictionary is trained on windows of
    ordinary texts, one on windows of toxic texts (``train_dictionaries``). How many windows
    of a text reach each margin, and how many it has, give its score by a logistic
    regression, fitted on margins by dictionaries that have not seen the text's half.

    Without labels, or without toxic or ordinary ones, every document scores the (smoothed) base rate.
    """
    ship(docs.sparkSession)
    sample = materialise(labelled_sample(docs, labels, label_col, sample_rows, id_col, text_col), "sample")
    rate = sample.select("_id", "label").distinct().agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("k")).first()
    base = float(np.log((rate["k"] + 0.5) / (rate["n"] - rate["k"] + 0.5)))
    flat = ToxicityModel(b"", b"", (*[0.0] * (2 * MARGINS + 1), base))
    if rate["k"] in (0, rate["n"]):
        return flat
    half = F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")
    texts = sample.where("trim(text) <> ''").select("text", F.when(F.col("label") == 0, 0).otherwise(1 + half).cast("int").alias("kind")).distinct()
    common, final, each = train_dictionaries(texts)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margins = [Margins(common, t) for t in each]
        for batch in batches:
            half = batch.column("half").to_numpy(zero_copy_only=False)
            for first, texts in blocks(batch, "text", _BLOCK):
                by_half = np.stack([Windows(texts, MEASURED).hits(m) for m in margins])
                hits = by_half[half[first : first + len(texts)], np.arange(len(texts))]
                yield pa.RecordBatch.from_pydict({"id": batch.column("id").slice(first, len(texts)), "label": batch.column("label").slice(first, len(texts)), "hits": pa.array(list(hits), pa.list_(pa.int64()))})

    halves = sample.select(F.xxhash64("_id").alias("id"), "text", "label", half.alias("half"))
    rows = halves.mapInArrow(measured, "id bigint, label int, hits array<bigint>").distinct().toArrow()  # at most sample_rows rows of numbers
    discard(sample)
    x = np.array(rows.column("hits").to_pylist(), np.int64)
    y = np.minimum(rows.column("label").to_numpy(), 1)
    return ToxicityModel(common, final, tuple(_logistic(_features(x), y).tolist()))


def _scorer(model: ToxicityModel):
    """A function from a block of texts to their scores."""
    margins, weights = Margins(model.ordinary, model.toxic), np.array(model.weights)

    def score(texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_features(Windows(texts, MEASURED).hits(margins)) @ weights, -30, 30)))

    return score


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``score`` (0 to 1) and ``predicted`` (score >= ``threshold``) of each document, by its whole text.

    All windows of ``MEASURED`` words of a text are measured: a window's margin is the number of
    bytes that the toxic dictionary saves beyond the ordinary one. A window without a run of
    ``GRAM`` bytes that only the toxic dictionary holds has margin 0 and is not compressed.
    There is no shuffle. A null or empty text has no window. Repeated rows are scored each;
    other columns are ignored; an empty table stays empty.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(model)
        for batch in batches:
            for first, texts in blocks(batch, text_col, _BLOCK):
                found = score(texts)
                yield pa.RecordBatch.from_pydict({id_col: batch.column(id_col).slice(first, len(texts)), "score": found, "predicted": (found >= threshold).astype(np.int32)})

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")


def keep_ordinary(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``threshold``; null and empty texts have no window."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(model)
        for batch in batches:
            for first, texts in blocks(batch, text_col, _BLOCK):
                yield batch.slice(first, len(texts)).filter(pa.array(score(texts) < threshold))

    return docs.mapInArrow(run, docs.schema)


def is_held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
