"""Near-duplicates by b-bit MinHash.

Texts with one shingle set form a class; only its representative goes on. 160
minima per set give 32 band keys, which propose candidates, and a packed
signature of the low bits of the minima. Candidates whose similarity,
estimated from bit counts and corrected for chance agreement, is clearly too
low are dropped; the others are compared on their full shingle sets.

Pairs inside a bucket are not all built. Round one ties every member to its
bucket's smallest id. Round two looks only at buckets that still hold more
than one component, and there only at members of different components, in
cells of bounded size, where likely pairs are compared at once; every such
pair is examined, so no link that could join two components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.common import release_memory, spread_lookup, stage
from newsloom.llm.components import components

BANDS, ROWS = 32, 5  # a pair at the threshold 0.8 shares no band once in 300,000
BITS = 4  # kept of each minimum
SLACK = 4.5  # standard deviations below the threshold at which an estimate still goes on
CELL = 1024  # members of one side of a compared cell

_rng = np.random.default_rng(20240501)
MULTIPLIERS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_MIX = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        _powers[size] = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, base, np.uint64))]) for base in (_BASE, _INVERSE))
    return _powers[size]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``width``-word shingles of the whole text.

    A-Z are lower-cased, words are cut at white space; a text of fewer words
    is one shingle, one without words has none.
    """
    joined = b" ".join((text or "").encode().lower().split())
    if not joined:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer(joined, np.uint8)
    gaps = np.flatnonzero(codes == 32)
    starts, ends = np.append(0, gaps + 1), np.append(gaps, len(codes))
    if len(starts) >= width:
        starts, ends = starts[:len(starts) - width + 1], ends[width - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    power, inverse = _power_tables(len(codes))
    prefix = np.append(np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[:len(codes)]))
    return np.unique(_mixed((prefix[ends] - prefix[starts]) * inverse[starts]))


def minima(shingles: np.ndarray) -> np.ndarray:
    out = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(shingles), 256):
        np.minimum(out, (shingles[i:i + 256, None] * MULTIPLIERS).min(axis=0), out=out)
    return out


def packed(values: np.ndarray) -> bytes:
    """The low BITS bits of every minimum."""
    low = (values & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return (low[0::2] | (low[1::2] << 4)).astype(np.uint8).tobytes()


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures (uint64 words in the last axis), corrected for chance agreement of BITS bits."""
    differ = a ^ b
    differ = (differ | (differ >> np.uint64(1)) | (differ >> np.uint64(2)) | (differ >> np.uint64(3))) & np.uint64(0x1111111111111111)
    agree = 1.0 - np.bitwise_count(differ).sum(axis=-1) / (BANDS * ROWS)
    chance = 0.5 ** BITS
    return (agree - chance) / (1.0 - chance)


def least_estimate(percent: int) -> float:
    s, chance = percent / 100, 0.5 ** BITS
    p = s + (1 - s) * chance
    return s - SLACK * (p * (1 - p) / (BANDS * ROWS)) ** 0.5 / (1 - chance)


def _id_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def signatures(df: DataFrame, id_column: str, text_column: str, width: int) -> DataFrame:
    """(id, n, digest, keys, low): set size, set digest, band keys and packed signature; the last three null for an empty set."""
    schema = pa.schema([("n", pa.int64()), ("digest", pa.binary()), ("keys", pa.list_(pa.int64())), ("low", pa.binary())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(start, 256) for b in batches for start in range(0, b.num_rows, 256)):  # results in small batches
            rows = []
            for text in batch.column(1):
                shingles = shingle_set(text.as_py(), width)
                if not len(shingles):
                    rows.append({"n": 0})
                    continue
                low = minima(shingles)
                keys = _mixed((low.reshape(BANDS, ROWS) * _BAND_MIX).sum(axis=1) + np.arange(BANDS, dtype=np.uint64))
                rows.append({"n": len(shingles), "digest": blake2b(shingles.tobytes(), digest_size=16).digest(), "keys": keys.view(np.int64).tolist(), "low": packed(low)})
            made = pa.RecordBatch.from_pylist(rows, schema=schema)
            yield pa.RecordBatch.from_arrays([batch.column(0), *made.columns], names=["id", *schema.names])
        release_memory()

    return df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(
        sign, f"id {_id_type(df, id_column)}, n long, digest binary, keys array<bigint>, low binary")


def likely(pairs: DataFrame, low: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose estimated similarity is at least ``least``."""
    both = pairs.join(low.select(F.col("id").alias("a"), F.col("low").alias("low_a")), "a").join(low.select(F.col("id").alias("b"), F.col("low").alias("low_b")), "b")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("low_a", "low_b"))
            yield batch.select(["a", "b"]).filter(pa.array(estimated(a, b) >= least))

    return both.mapInArrow(choose, f"a {_id_type(pairs, 'a')}, b {_id_type(pairs, 'b')}")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, other = None, None
        for batch in batches:
            keep = []
            for b, text_a, text_b in zip(batch.column("b").to_pylist(), batch.column("text_a"), batch.column("text_b")):
                if b != last:  # rows come sorted by b where the join sorts them
                    last, other = b, shingle_set(text_b.as_py(), width)
                mine = shingle_set(text_a.as_py(), width)
                common = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(100 * common >= percent * (len(mine) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        release_memory()

    return both.mapInArrow(compare, f"a {_id_type(pairs, 'a')}, b {_id_type(pairs, 'b')}")


def cell_links(members: DataFrame, low: DataFrame, texts: DataFrame, least: float, width: int, percent: int) -> DataFrame:
    """Links between members of one bucket in different components.

    members: (key, id, component, size). A bucket of many members is cut into
    parts of about CELL; every two parts meet in one cell, which one task
    compares block by block: likely pairs by signature, then on full sets,
    where the cell's links so far have not joined the two already. So a cell
    gives fewer links than it has members, and no pair leaves it unconfirmed.
    """
    kind = _id_type(members, "id")
    parts = F.ceil(F.col("size") / F.lit(CELL)).cast("int")
    rows = members.join(low, "id").join(texts, "id").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", "component", "low", "text")
    cells = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            marks = [np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("key", "i", "j")]
            cuts = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
            if not len(cuts):
                continue
            table = pa.Table.from_batches(held)
            for a, b in zip(np.append(0, cuts[:-1]), cuts):
                yield from _link_cell(table.slice(a, b - a), least, width, percent)
            held = table.slice(cuts[-1]).to_batches()
        if held:
            yield from _link_cell(pa.Table.from_batches(held), least, width, percent)
        release_memory()

    return cells.mapInArrow(compare, f"a {kind}, b {kind}").distinct()


def _link_cell(cell: pa.Table, least: float, width: int, percent: int) -> Iterator[pa.RecordBatch]:
    component = cell.column("component").to_pylist()
    if len(set(component)) < 2:
        return
    part, i, j = (cell.column(c).to_numpy() for c in ("part", "i", "j"))
    low = np.frombuffer(b"".join(cell.column("low").to_pylist()), np.uint64).reshape(cell.num_rows, -1)
    ids, texts, sets = cell.column("id").to_pylist(), cell.column("text"), {}
    first = {c: n for n, c in reversed(list(enumerate(component)))}
    root = [first[c] for c in component]  # rows of one component are joined from the start

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def shingles(x: int) -> np.ndarray:
        if x not in sets:
            sets[x] = shingle_set(texts[x].as_py(), width)
        return sets[x]

    found: list[tuple] = []
    left, right = np.flatnonzero(part == i[0]), np.flatnonzero(part == j[0])
    for start in range(0, len(left), 64):
        block = left[start:start + 64]
        like = estimated(low[block][:, None], low[right][None])
        x, y = np.nonzero(like >= least)
        best = np.argsort(-like[x, y], kind="stable")  # the likeliest first: one link spares many comparisons
        for p, q in zip(block[x[best]].tolist(), right[y[best]].tolist()):
            if find(p) == find(q):
                continue
            common = len(np.intersect1d(shingles(p), shingles(q), assume_unique=True))
            if 100 * common >= percent * (len(shingles(p)) + len(shingles(q)) - common):
                found.append((max(ids[p], ids[q]), min(ids[p], ids[q])))
                root[find(p)] = find(q)
    if found:
        a, b = zip(*found)
        kind = cell.schema.field("id").type
        yield pa.RecordBatch.from_pydict({"a": list(a), "b": list(b)}, schema=pa.schema([("a", kind), ("b", kind)]))


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``df``: id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= percent * union of their
    shingle sets; component_id is the smallest id that links reach, kept marks
    that document. A text without words is linked with nothing. Rows with one
    id count as one document, so their texts are linked. A row without an id
    takes no part: its component is null, and it is kept. An empty table gives
    no rows; other columns are not read.
    """
    least = least_estimate(percent)
    signed = stage(signatures(df, id_column, text_column, width), "signatures")
    real = signed.filter("digest IS NOT NULL AND id IS NOT NULL")
    classes = stage(real.groupBy("digest").agg(F.min("id").alias("node"), F.count("*").alias("size")), "classes")
    total = classes.agg(F.sum("size")).first()[0] or 0

    # one row per class, from its representative: rows with its id that have another digest drop out
    chosen = real.join(classes.select(F.col("node").alias("id"), F.col("digest").alias("_digest")), "id").filter("digest = _digest")
    low = stage(chosen.select("id", "keys", "low").dropDuplicates(["id"]), "class-signatures")
    keyed = low.select("id", F.explode("keys").alias("key"))
    buckets = stage(keyed.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("size")).filter("size > 1"), "buckets")
    sum_sizes = buckets.agg(F.sum("size")).first()[0] or 0
    members = stage(spread_lookup(keyed, buckets, "key", "size", "id", sum_sizes).filter("head IS NOT NULL"), "bucket-members")
    low = low.select("id", "low")

    pairs = stage(likely(members.filter("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct(), low, least), "likely-pairs")
    wanted = members.select("id").distinct()
    texts = stage(df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(wanted, "id").join(
        real.select("id", F.lit(1).alias("_one")).distinct(), "id").drop("_one").dropDuplicates(["id"]), "candidate-texts")
    links = stage(confirmed(pairs, texts, width, percent), "confirmed-pairs")
    reached = components(links)

    tied = members.filter("size > 2").join(reached, "id", "left").select("key", "id", "size", "head", F.coalesce("component", "id").alias("component"))
    tied = stage(tied, "tied-members")
    open_keys = tied.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("key", F.lit(True).alias("open"), F.lit(1).alias("one"))
    # heads were compared with all members of their bucket in round one
    left = tied.filter("id <> head").join(open_keys, "key", "left_semi")
    more = stage(cell_links(left, low, texts, least, width, percent), "cell-links")
    if more.limit(1).count():
        reached = components(links.unionByName(more))

    named = classes.join(reached, F.col("node") == F.col("id"), "left").select("digest", "size", F.coalesce("component", "node").alias("component"))
    found = spread_lookup(signed.select("id", "n", "digest"), stage(named, "class-components"), "digest", "size", "id", total)
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return found.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
