"""Sharding by sampled splitters, natively.

A size-weighted sample of the keys gives quantile boundaries; records are
range-partitioned by them, and a range that one hot key overfills is
subdivided by the record's own hash. Exact byte counts of the ranges then
place every record on one global line, which is cut into equal lengths.

The key is the digest of the text, so equal texts stand side by side. A group
of equal texts stays in one shard, except for groups of over a hundredth of a
shard: those are cut where the line is cut, or the law could not hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom.llm.common import stage, text_or_empty

RANGES = 1024  # quantile boundaries of the sample
SAMPLES_PER_RANGE = 16  # expected number of samples in each
FANOUT = 32  # boundaries looked at per level when a row finds its range
WHOLE_GROUP = 0.01  # of a shard: larger groups may be cut


def sized(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, size, crc, digest and a number to range by, for each row; the text itself goes no further."""
    text = text_or_empty(text_column)
    return df.select(
        F.col(id_column).alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("crc"),
        F.md5(text).alias("digest"),
        F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit(""))).alias("own"),
    ).withColumn("key", F.conv(F.substring("digest", 1, 15), 16, 10).cast("long"))


def boundaries(rows: DataFrame, total: int, ranges: int = RANGES) -> tuple[list[int], list[int]]:
    """Sorted range starts, and the keys that fill more than a range alone.

    A row is drawn with a chance in proportion to its size, by its own hash,
    so a rerun draws the same. About ranges * SAMPLES_PER_RANGE keys reach
    the driver at any input size.
    """
    wanted = ranges * SAMPLES_PER_RANGE
    chance = F.pmod(F.xxhash64("digest", "own"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = sorted(r[0] for r in rows.filter(chance < F.col("size") * F.lit(wanted / max(total, 1))).select("key").collect())
    cuts = [drawn[i * len(drawn) // ranges] for i in range(1, ranges)] if drawn else []
    hot = sorted({a for a, b in zip(cuts, cuts[1:]) if a == b})
    return sorted({*cuts, *hot, *(k + 1 for k in hot)}), hot


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<bigint>")


def range_of(key: Column, cuts: list[int]) -> Column:
    """Number of cuts at or below the key, found in two short steps."""
    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda v: v <= key))

    if not cuts:
        return F.lit(0)
    blocks = [cuts[i:i + FANOUT] for i in range(0, len(cuts), FANOUT)]
    block = below(_longs([b[0] for b in blocks]))
    nested = F.array(*[_longs(b) for b in blocks])
    return F.when(block == 0, 0).otherwise((block - 1) * FANOUT + below(F.element_at(nested, F.greatest(block, F.lit(1)))))


def shard_by_bytes(df: DataFrame, shards: int = 16, id_column: str = "doc_id", text_column: str = "text", ranges: int = RANGES) -> DataFrame:
    """One row per input row: id, size, crc, shard (0 to shards - 1), slot (from 0, without gaps in a shard).

    Null texts count as empty and have size 1; null ids, repeated ids and
    repeated rows each keep their own slot; an empty table gives no rows;
    other columns are not read.
    """
    rows = stage(sized(df, id_column, text_column), "shard-rows")
    total = rows.agg(F.sum("size")).first()[0] or 1
    cuts, hot = boundaries(rows, total, ranges)
    is_hot = F.array_contains(_longs(hot), F.col("key")) if hot else F.lit(False)
    rows = rows.withColumn("range", range_of(F.col("key"), cuts)).withColumn(
        "sub", F.when(is_hot, F.conv(F.substring("own", 1, 2), 16, 10).cast("int")).otherwise(0))

    # at most ranges * 256 rows at any input size
    chunks = rows.groupBy("range", "sub").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("range", "sub").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("range", "sub", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
                           F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"))

    line = Window.partitionBy("range", "sub").orderBy("digest", "own", "id")
    group = Window.partitionBy("range", "sub", "digest")
    placed = (
        rows.withColumn("run", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("nth", F.row_number().over(line))
        .withColumn("group_start", F.min("run").over(group))
        .withColumn("group_bytes", F.sum("size").over(group))
        .join(F.broadcast(chunks), ["range", "sub"])
    )
    whole = (F.col("group_bytes") <= F.lit(total / shards * WHOLE_GROUP)) & (F.col("sub") == 0) & ~is_hot
    at = F.col("bytes_before") + F.when(whole, F.col("group_start")).otherwise(F.col("run"))
    placed = placed.select("id", "size", "crc", F.least(F.floor(at / F.lit(total / shards)), F.lit(shards - 1)).cast("int").alias("shard"),
                           (F.col("rows_before") + F.col("nth") - 1).alias("place"))
    placed = stage(placed, "shard-places")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # a row per shard
    return placed.join(F.broadcast(first), "shard").select("id", "size", "crc", "shard", (F.col("place") - F.col("first")).alias("slot"))
