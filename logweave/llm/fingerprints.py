"""Homomorphic multiset fingerprints of texts, in Spark's own functions alone.

A paragraph is a line of the text as it stands. Each paragraph is hashed to a wide vector, a
text's fingerprint is the sum of its paragraphs' vectors, each number modulo a power of two.
So the order of paragraphs does not count, and a paragraph is added or taken away by one sum.
The vector has two kinds of numbers:

* ``EXACT`` sums of uniform 32-bit hashes of the paragraphs, modulo 2**32, for equality;
* ``LANES`` sums of signs of the paragraph's word pairs, modulo 2**LANE_BITS, whose cosine
  estimates that of the texts' word-pair counts, for likeness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXACT = 4
#: Signs are taken from 63 bits of a hash. Three counters of 21 bits lie in one number while they are summed.
_BITS, _PACKED = 21, 3
HASHES = 2
LANES = HASHES * _BITS * _PACKED
LANE_BITS = 20
#: Texts dealt to one block, and the most blocks there are; beyond, blocks grow.
BLOCK_ROWS, MAX_BLOCKS = 512, 20_000


def _exact(text: Column) -> Column:
    """The numbers for equality."""
    paragraphs = F.split(text, "\n")
    add = lambda k: lambda s, p: (s + F.xxhash64(F.lit(k), p).bitwiseAND(F.lit(0xFFFFFFFF))).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.array(*[F.aggregate(paragraphs, F.lit(0).cast("bigint"), add(k)) for k in range(EXACT)])


def _pair_hashes(words: Column) -> Column:
    """A hash of each word with the one behind it. Ends of lines are words, too, so that each pair belongs to one paragraph."""
    n = F.size(words) - 1
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.xxhash64(a, b))


def _wrap(lane: Column) -> Column:
    """A number modulo 2**LANE_BITS, with its sign."""
    half = 1 << (LANE_BITS - 1)
    return F.pmod(lane + half, F.lit(1 << LANE_BITS)) - half


def text_vectors(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """The columns ``keys``, ``_exact`` and ``_lanes`` of each row of ``texts``; ``keys`` tell the rows apart.

    Word pairs are counted where they are made, in parts so small that no packed counter runs
    over; if rows are dealt out by some of the keys
    already, nothing is shuffled.
    """
    rows = texts.select(*keys, _exact(F.col(text_col)).alias("_exact"), F.split(F.concat(F.lit("\n "), F.replace(F.col(text_col), F.lit("\n"), F.lit(" \n ")), F.lit(" \n")), " +").alias("_words"))
    pairs = rows.select(*keys, "_exact", F.posexplode(_pair_hashes(F.col("_words"))).alias("_pos", "_h0"))
    pairs = pairs.select(*keys, "_exact", F.shiftright("_pos", _BITS - 1).alias("_part"), "_h0", *[F.xxhash64("_h0", F.lit(k)).alias(f"_h{k}") for k in range(1, HASHES)])
    mask = F.lit(sum(1 << (_BITS * j) for j in range(_PACKED)))
    sums = [F.sum(F.shiftrightunsigned(f"_h{h}", k).bitwiseAND(mask)).alias(f"_s{h}_{k}") for h in range(HASHES) for k in range(_BITS)]
    parts = pairs.groupBy(*keys, "_exact", "_part").agg(F.count("*").alias("_n"), *sums)
    one = F.lit((1 << _BITS) - 1)
    lanes = [
        F.sum(F.shiftrightunsigned(f"_s{h}_{k}", _BITS * j).bitwiseAND(one) * 2 - F.col("_n")).alias(f"_l{h}_{j}_{k}")
        for h in range(HASHES) for j in range(_PACKED) for k in range(_BITS)
    ]
    names = [f"_l{h}_{j}_{k}" for h in range(HASHES) for j in range(_PACKED) for k in range(_BITS)]
    whole = parts.groupBy(*keys, "_exact").agg(*lanes)
    return whole.select(*keys, "_exact", F.array(*[_wrap(F.col(n)) for n in names]).alias("_lanes"))


def fingerprint(exact: Column, lanes: Column) -> Column:
    """The fingerprint as text: the numbers in hexadecimal, each in as many digits as its modulus needs."""
    lane = lambda x: F.lpad(F.hex(F.pmod(x, F.lit(1 << LANE_BITS))), LANE_BITS // 4, "0")
    return F.lower(F.concat(F.array_join(F.transform(exact, lambda x: F.lpad(F.hex(x), 8, "0")), ""), F.array_join(F.transform(lanes, lane), "")))


def _numbers(text: Column, first: int, count: int, digits: int) -> Column:
    """``count`` numbers of ``digits`` hexadecimal digits each, from character ``first`` on."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.conv(F.substr(text, k * digits + first, F.lit(digits)), 16, 10).cast("bigint"))


def parse_fingerprint(text: Column) -> tuple[Column, Column]:
    """The numbers of a fingerprint: those for equality, those for likeness."""
    return _numbers(text, 1, EXACT, 8), F.transform(_numbers(text, 1 + EXACT * 8, LANES, LANE_BITS // 4), _wrap)


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of all paragraphs of both (``sign`` 1), or of the first's without the second's (-1)."""
    (ax, al), (bx, bl) = parse_fingerprint(a), parse_fingerprint(b)
    return fingerprint(F.zip_with(ax, bx, lambda x, y: F.pmod(x + y * sign, F.lit(1 << 32))), F.zip_with(al, bl, lambda x, y: x + y * sign))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of two vectors for likeness, from 0 to 1; 1 for equal ones, 0 where one of two different ones is zero."""
    product = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0).cast("bigint"), lambda s, v: s + v).cast("double")
    size = F.sqrt(product(a, a) * product(b, b))
    return F.when(a == b, 1.0).when(size > 0, F.least(F.greatest(product(a, b) / size, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_chars`` (code points) and ``fingerprint`` of each text.

    A null text counts as empty: one empty paragraph. Rows of one id, or without an id, stay
    rows of their own. Other columns are ignored, whatever their names. An empty table gives
    an empty result. Only sums of one row and task are shuffled, never texts.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.withColumn("_chars", F.char_length("_text").cast("bigint"))
    found = text_vectors(rows, ["_row", "_id", "_chars"], "_text")
    return found.select(F.col("_id").alias(id_col), F.col("_chars").alias("n_chars"), fingerprint(F.col("_exact"), F.col("_lanes")).alias("fingerprint"))


def _literal(values: list[int]) -> Column:
    """A constant array of numbers, as one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def _block_of(ids: Column, bounds: list[int], chunk: int = 128) -> Column:
    """How many of the ascending ``bounds`` an id reaches, found in two steps."""
    if not bounds:
        return F.lit(0)
    whole = F.size(F.filter(_literal(bounds[chunk - 1 :: chunk]), lambda b: b <= ids)) * chunk
    return whole + F.size(F.filter(F.slice(_literal(bounds), whole + 1, F.lit(chunk)), lambda b: b <= ids))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``_block``, ``_sub``, ``_row``, ``_guard``, ``_id``, ``_text``, ``_next``: each text with the next one's, by falling id.

    Rows of one id follow each other by a hash of the text, rows without an id come last; the
    first text is the next one of the last. Texts are shuffled once: rows go to blocks of
    neighbouring ids, whose bounds are quantiles of all ids, and an id that fills whole blocks,
    or none, is split by the hash. The first row of each block is sent to the block before it
    as well, as a guard (``_guard``), which has no next text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    ids = docs.select(F.col(id_col).cast("bigint").alias("_id"))
    blocks = max(1, min(MAX_BLOCKS, ids.count() // BLOCK_ROWS))
    found = ids.agg(F.percentile_approx("_id", [k / blocks for k in range(1, blocks)], max(10_000, 4 * blocks))).first()[0] if blocks > 1 else None
    found = found or []
    bounds, hot = sorted(set(found)), sorted({b for b in found if found.count(b) > 1} if len(found) != len(set(found)) else ())
    key = F.col("_id").cast("bigint")
    rows = rows.withColumn("_hash", F.xxhash64("_text"))
    split = F.when(key.isNull() | F.array_contains(_literal(hot), key), F.shiftright("_hash", 56).cast("int") + 129).otherwise(0)
    rows = rows.select("*", F.coalesce(_block_of(key, bounds), F.lit(-1)).cast("int").alias("_block"), split.alias("_sub"))
    # The first row of a block has its largest id, and of these the smallest hash.
    first = F.max(F.struct(key.alias("id"), F.bitwise_not("_hash").alias("hash"))).alias("f")
    firsts = sorted(rows.groupBy("_block", "_sub").agg(first).select("_block", "_sub", "f.id", "f.hash").collect(), key=lambda r: (-r[0], r[1]))
    guards = [(b.id, ~b.hash, a[0], a[1]) for a, b in zip(firsts, [*firsts[1:], *firsts[:1]])]
    held = F.broadcast(spark.createDataFrame(guards, "_gid bigint, _ghash bigint, _gblock int, _gsub int"))
    where = lambda block, sub, guard: F.struct(F.col(block).alias("b"), F.col(sub).alias("s"), F.lit(guard).alias("g"))
    both = rows.join(held, key.eqNullSafe(F.col("_gid")) & (F.col("_hash") == F.col("_ghash")), "left")
    places = F.when(F.col("_gblock").isNull(), F.array(where("_block", "_sub", False))).otherwise(F.array(where("_block", "_sub", False), where("_gblock", "_gsub", True)))
    both = both.select("_id", "_text", "_hash", F.explode(places).alias("_at")).select("_id", "_text", "_hash", F.col("_at.b").alias("_block"), F.col("_at.s").alias("_sub"), F.col("_at.g").alias("_guard"))
    order = Window.partitionBy("_block", "_sub").orderBy("_guard", F.desc_nulls_last("_id"), "_hash", "_text")
    return both.select("_block", "_sub", F.row_number().over(order).alias("_row"), "_guard", "_id", "_text", F.lead("_text").over(order).alias("_next"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of an edited one, and how like the text's is to the edited one's and to the next text's.

    The edited text has, in place of its last ``floor(n_chars / 2)`` code points, the first as
    many (or all) of the next text by falling id (``with_next`` on order, ties and nulls).
    Both texts' vectors are summed, and neighbours compared, in the blocks in which the texts
    lie, without another shuffle. A null text counts as empty. Other columns are ignored. An
    empty table gives an empty result.

    Returns ``id_col``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``.
    """
    rows = with_next(docs, id_col, text_col).withColumn("_chars", F.char_length("_text").cast("bigint"))
    half = F.floor(F.col("_chars") / 2).cast("int")
    edited = F.concat(F.substr("_text", F.lit(1), (F.col("_chars") - half).cast("int")), F.substr("_next", F.lit(1), half))
    rows = rows.withColumn("_edited", F.when(F.col("_guard"), F.lit("")).otherwise(edited)).withColumn("_sha", F.sha2("_edited", 256))
    pair = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("_text").alias("t")), F.struct(F.lit(1).alias("k"), F.col("_edited").alias("t"))))
    keys = ["_block", "_sub", "_row", "_guard", "_id", "_chars", "_sha", "_kind"]
    texts = rows.select(*keys[:-1], pair.alias("_p")).select(*keys[:-1], F.col("_p.k").alias("_kind"), F.col("_p.t").alias("_t"))
    found = text_vectors(texts, keys, "_t")
    order = Window.partitionBy("_block", "_sub").orderBy("_row", "_kind")
    found = found.select(*keys, "_exact", "_lanes", F.lead(F.struct("_exact", "_lanes"), 1).over(order).alias("_e"), F.lead("_lanes", 2).over(order).alias("_n"))
    return found.where("_kind = 0 and not _guard").select(
        F.col("_id").alias(id_col),
        F.col("_chars").alias("n_chars"),
        F.col("_sha").alias("edited_sha256"),
        fingerprint(F.col("_exact"), F.col("_lanes")).alias("fingerprint"),
        fingerprint(F.col("_e._exact"), F.col("_e._lanes")).alias("edited_fingerprint"),
        likeness(F.col("_lanes"), F.col("_e._lanes")).alias("near_edited"),
        likeness(F.col("_lanes"), F.col("_n")).alias("near_next"),
    )
