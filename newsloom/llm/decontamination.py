"""Benchmark decontamination by SimHash windows, natively.

1. Every document becomes an array of five-word shingle hashes. A window can
   share shingles with an item only if it holds one, and sliding it to its
   first shared shingle loses none; so windows start at positions whose
   shingle some item has, and have the size of such an item. A bit set of all
   items' shingles, tested inside the row, finds those positions; it lets
   false ones pass, never drops a true one.
2. Windows and items get 64-bit SimHash fingerprints, each shingle weighing
   as often as it occurs.
3. Multi-index Hamming blocks: of four 16-bit blocks of two fingerprints at
   most 15 bits apart, one block pair is at most 3 bits apart. Items are
   listed under every block value within 3 bits, so equal blocks find all
   item fingerprints within the radius.
4. Candidates are verified by the weighted Jaccard similarity of the window's
   and the item's shingles (sum of smaller over sum of larger counts).

Items of few shingles spread too widely for the radius: up to SHORT shingles,
a window meets every item that has its first shingle, which is exact. Items of
under five words are one shingle, their whole sequence.

At the threshold 0.8 about 98 of 100 pairs of a window and a longer item lie
within the radius, and a document has several windows around a passage; exact
passages have distance 0.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.llm.common import bounded, stage, text_or_empty

WIDTH = 5  # words per shingle
THRESHOLD = 0.8
BLOCKS, BLOCK_BITS, RADIUS = 4, 16, 15
SHORT = 7  # shingles of an item that is looked up by them
MAX_SLOTS = 1 << 16  # of the bit set, 64 bits each: the bound on what reaches the driver and the plan
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_LONGS = "array<bigint>"


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _literal(values: list[int]) -> Column:
    """One array literal, folded from a string: a literal per entry would swell the plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(_LONGS)


def with_words(df: DataFrame, text_column: str) -> DataFrame:
    """``df`` with the hash of each word as ``_words``."""
    words = F.array_remove(F.split(F.lower(text_or_empty(text_column)), SEPARATORS), "")
    return df.withColumn("_words", F.transform(words, lambda w: F.xxhash64(w)))


def with_shingles(df: DataFrame, text_column: str, name: str = "h", keep_words: bool = False) -> DataFrame:
    """``df`` with the hash of the five-word shingle at each position; none where the text has fewer words.

    Words are cut at ASCII characters that are no letter or digit, after
    lower-casing; null counts as empty. Word hashes are a column of their
    own, or they would be computed anew for every shingle.
    """
    df = with_words(df, text_column)
    shingles = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_words") - WIDTH, F.lit(0))), lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WIDTH)]))
    return df.withColumn(name, F.when(F.size("_words") < WIDTH, F.array().cast(_LONGS)).otherwise(shingles)).drop(*[] if keep_words else ["_words"])


def sequence_hash(words: Column) -> Column:
    return F.aggregate(words, _long(0), lambda acc, w: F.xxhash64(acc, w))


class BitSet:
    """Which hashes may be shingles of items: three bits in one of the slots; true ones always pass."""

    def __init__(self, shingles: DataFrame):
        rows = shingles.count()
        self.slot_bits = max(10, min(MAX_SLOTS.bit_length() - 1, (4 * rows).bit_length()))
        found = dict(shingles.groupBy(self.slot(F.col("h")).alias("slot")).agg(F.bit_or(self.bits(F.col("h")))).collect())
        self.slots = _literal([found.get(i, 0) for i in range(1 << self.slot_bits)])

    def slot(self, h: Column) -> Column:
        return F.shiftrightunsigned(h, 64 - self.slot_bits).cast("int")

    @staticmethod
    def bits(h: Column) -> Column:
        one = [F.call_function("shiftleft", _long(1), F.shiftright(h, at).bitwiseAND(_long(63)).cast("int")) for at in (0, 6, 12)]
        return one[0].bitwiseOR(one[1]).bitwiseOR(one[2])

    def has(self, h: Column) -> Column:
        return F.get(self.slots, self.slot(h)).bitwiseAND(self.bits(h)) == self.bits(h)


def simhash(shingles: Column) -> Column:
    """64-bit fingerprint of an array of hashes; a bit is set where more than half of them have it."""

    def bit(b: Column) -> Column:
        ones = F.aggregate(shingles, _long(0), lambda acc, h: acc + F.call_function("shiftrightunsigned", h, b).bitwiseAND(_long(1)))
        return F.when(ones * 2 > F.size(shingles), F.call_function("shiftleft", _long(1), b)).otherwise(_long(0))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), _long(0), lambda acc, b: acc.bitwiseOR(bit(b)))


def block_key(fingerprint: Column, block: int) -> Column:
    """Block number and value of a fingerprint's block in one number."""
    return F.shiftrightunsigned(fingerprint, BLOCK_BITS * block).bitwiseAND(_long((1 << BLOCK_BITS) - 1)) + _long(block << BLOCK_BITS)


def hamming_index(items: DataFrame) -> DataFrame:
    """(key, block, item, item_fp): each item under every block value within RADIUS // BLOCKS bits of its own."""
    flips = [sum(1 << b for b in bits) for n in range(RADIUS // BLOCKS + 1) for bits in combinations(range(BLOCK_BITS), n)]
    blocks = F.explode(F.array(*[F.struct(F.lit(b).alias("block"), block_key(F.col("fp"), b).alias("own")) for b in range(BLOCKS)]))
    rows = items.select("item", F.col("fp").alias("item_fp"), blocks.alias("b")).select("item", "item_fp", "b.block", "b.own", F.explode(_literal(flips)).alias("flip"))
    return rows.select(F.col("own").bitwiseXOR(F.col("flip")).alias("key"), "block", "item", "item_fp")


def named_index(items: DataFrame) -> DataFrame:
    """The same columns for items that windows know by their number."""
    return items.select((-1 - F.col("item")).alias("key"), F.lit(BLOCKS).alias("block"), "item", F.col("fp").alias("item_fp"))


def in_radius(windows: DataFrame, index: DataFrame) -> DataFrame:
    """Windows joined with the item they know (``known_item``), else with every item whose fingerprint is within RADIUS of fp, once."""
    blocks = F.array(*[block_key(F.col("fp"), b) for b in range(BLOCKS)])
    probes = F.explode(F.when(F.col("known_item").isNotNull(), F.array(-1 - F.col("known_item"))).otherwise(blocks))
    found = windows.withColumn("key", probes).join(bounded(index), "key")
    differ = F.col("fp").bitwiseXOR(F.col("item_fp"))
    near = [F.bit_count(F.shiftrightunsigned(differ, BLOCK_BITS * b).bitwiseAND(_long((1 << BLOCK_BITS) - 1))) <= RADIUS // BLOCKS for b in range(BLOCKS)]
    first = F.coalesce(*[F.when(n, F.lit(b)) for b, n in enumerate(near)])  # a pair that meets in several blocks counts in the first
    return found.filter(F.col("known_item").isNotNull() | ((F.bit_count(differ) <= RADIUS) & (first == F.col("block")))).drop("key", "block", "item_fp", "known_item")


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of the smaller over the sum of the larger counts of all shingles."""
    def count(values: Column, x: Column) -> Column:
        return F.size(F.filter(values, lambda y: y == x))

    common = F.aggregate(F.array_distinct(b), F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x)))
    return common / (F.size(a) + F.size(b) - common)


def contaminated(df: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 item_column: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame | None:
    """One row per document and item found in it: id, text_md5, item_id, start_word, n_words, similarity.

    start_word (from 0) is the first best window's. An item of fewer than five
    words is found where its words stand in sequence. None if no item can be
    found, because the benchmark is empty or has no item with a word. Rows
    with null ids are searched too and are told apart by their texts' digest.
    """
    every = with_shingles(benchmark.select(F.col(item_column).alias("item_id"), F.col(item_text).alias("text")), "text", keep_words=True).filter(F.size("_words") > 0)
    # a number of its own: item ids may be null or repeat
    every = stage(every.select(F.monotonically_increasing_id().alias("item"), "item_id", "h", "_words", simhash(F.col("h")).alias("fp")), "items")
    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    parts = [p for p in (_similar(rows, every.filter(F.size("h") > 0).drop("_words"), threshold), _sequences(rows, every.filter(F.size("h") == 0))) if p is not None]
    if not parts:
        return None
    found = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words")).alias("best")
    return found.groupBy("id", "text_md5", "item_id").agg(best).select(
        "id", "text_md5", "item_id", (-F.col("best.back")).cast("long").alias("start_word"), F.col("best.n_words").cast("long").alias("n_words"), F.col("best.similarity").alias("similarity"))


def _sequences(rows: DataFrame, items: DataFrame) -> DataFrame | None:
    """Places of items of under WIDTH words: (id, text_md5, item_id, start, n_words, similarity)."""
    items = items.select("item_id", F.size("_words").alias("n_words"), sequence_hash(F.col("_words")).alias("hash"))
    sizes = [r[0] for r in items.select("n_words").distinct().collect()]  # of 1 to 4
    if not sizes:
        return None
    bits = BitSet(items.select(F.col("hash").alias("h")))

    def sequences(n: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size("_words") - n, F.lit(0)))
        return F.struct(F.lit(n).alias("n_words"), F.transform(starts, lambda i: sequence_hash(F.slice("_words", i + 1, F.lit(n)))).alias("h"))

    listed = with_words(rows, "text").select("id", F.md5("text").alias("text_md5"), F.size("_words").alias("total"), F.explode(F.array(*map(sequences, sizes))).alias("part"))
    places = F.explode(F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda i: bits.has(F.get("h", i))))
    listed = listed.select("id", "text_md5", "total", "part.n_words", "part.h").filter(F.col("total") >= F.col("n_words"))
    listed = listed.select("id", "text_md5", "n_words", "h", places.alias("start")).select("id", "text_md5", "n_words", "start", F.get("h", F.col("start")).alias("hash"))
    return listed.join(bounded(items), ["n_words", "hash"]).select("id", "text_md5", "item_id", "start", "n_words", F.lit(1.0).alias("similarity"))


def _similar(rows: DataFrame, items: DataFrame, threshold: float) -> DataFrame | None:
    """Windows of at least the threshold's similarity: (id, text_md5, item_id, start, n_words, similarity)."""
    most = items.agg(F.max(F.size("h"))).first()[0]
    if not most:
        return None
    known = stage(items.select(F.explode("h").alias("h"), F.size("h").alias("n")).distinct(), "item-shingles")
    bits = BitSet(known)

    rows = with_shingles(rows, "text")
    # the generator takes an expression, not a column: then no filter is inferred that would evaluate it twice
    starts = F.explode(F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda i: bits.has(F.get("h", i))))
    starts = rows.select("id", "text", "h", starts.alias("start")).select("id", F.md5("text").alias("text_md5"), "start", F.get("h", F.col("start")).alias("first"),
                                                                   F.slice("h", F.col("start") + 1, F.lit(most)).alias("window"))
    short = items.filter(F.size("h") <= SHORT)
    sizes = known.filter(F.col("n") > SHORT).select(F.col("h").alias("first"), "n", F.lit(None).cast("long").alias("known_item"))
    named = short.select(F.explode(F.array_distinct("h")).alias("first"), F.size("h").alias("n"), F.col("item").alias("known_item"))
    windows = starts.join(bounded(stage(sizes.union(named), "item-sizes")), "first").select(
        "id", "text_md5", "start", "n", "known_item", F.slice("window", F.lit(1), F.col("n")).alias("window"))
    # of so many shingles, at least these must be some item's
    windows = windows.filter(F.size(F.filter("window", lambda h: bits.has(h))) * (1 + threshold) >= threshold * (F.size("window") + F.col("n")) - 1e-9)
    windows = windows.withColumn("fp", F.when(F.col("known_item").isNull(), simhash(F.col("window"))))
    found = in_radius(windows, stage(hamming_index(items.filter(F.size("h") > SHORT)).union(named_index(short)), "hamming-index"))
    found = found.join(bounded(items.select("item", "item_id", F.col("h").alias("shingles"))), "item")
    found = found.withColumn("similarity", weighted_similarity(F.col("window"), F.col("shingles"))).filter(F.col("similarity") >= threshold - 1e-9)
    return found.select("id", "text_md5", "item_id", "start", (F.size("window") + WIDTH - 1).alias("n_words"), "similarity")


def without_contaminated(df: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``df``, all their columns, in whose texts no benchmark item is found."""
    found = contaminated(df, benchmark, id_column, text_column)
    if found is None:
        return df
    gone = stage(found.select(F.col("id").alias("_id"), F.col("text_md5").alias("_md5")).distinct(), "contaminated")
    same = F.col(id_column).eqNullSafe(F.col("_id")) & (F.md5(text_or_empty(text_column)) == F.col("_md5"))
    return df.join(bounded(gone), same, "left_anti")
