"""Joins that stay balanced when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# rows above which hot keys are routed apart; None leaves skewed joins to
# adaptive execution, which splits hot partitions at run time
PLAIN_ROWS: int | None = None
# a key is hot above 1/HOT_SHARE of the rows, so fewer than HOT_SHARE keys
# are hot: that bounds what is broadcast
HOT_SHARE = 1000


def hot_keys(left: DataFrame, key: str, total: int) -> DataFrame:
    """Fewer than HOT_SHARE values of ``key``, with their row counts."""
    return left.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > max(1, total // HOT_SHARE))


def lookup(left: DataFrame, right: DataFrame, key: str, total: int, plain_rows: int | None = PLAIN_ROWS) -> DataFrame:
    """Left join to ``right``, which has one row per key.

    ``total`` is the row count of ``left``. Where hot keys are routed, their
    rows meet a
    broadcast of the few right rows they need and are never shuffled by
    their key; the rest is an ordinary join.
    """
    if plain_rows is None or total < plain_rows:
        return left.join(right, key, "left")
    # null keys find nothing; in the join they would all go to one partition
    nulls = left.filter(F.col(key).isNull())
    left = left.filter(F.col(key).isNotNull())
    hot = hot_keys(left, key, total).select(key).join(right, key, "left").withColumn("_hot", F.lit(True))
    routed = left.join(F.broadcast(hot.select(key, "_hot", *[F.col(c).alias(f"_h_{c}") for c in right.columns if c != key])), key, "left")
    extra = [c for c in right.columns if c != key]
    served = routed.filter("_hot").select(*left.columns, *[F.col(f"_h_{c}").alias(c) for c in extra])
    cold = routed.filter(F.col("_hot").isNull()).select(*left.columns).join(right, key, "left").select(*left.columns, *extra)
    lost = nulls.select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in extra])
    return served.unionByName(cold).unionByName(lost)


def without(left: DataFrame, keys: DataFrame, key: str, total: int, plain_rows: int | None = PLAIN_ROWS) -> DataFrame:
    """Anti-join to distinct ``keys``; nulls of ``key`` stay."""
    marks = keys.select(key).withColumn("_gone", F.lit(True))
    return lookup(left, marks, key, total, plain_rows).filter(F.col("_gone").isNull()).drop("_gone")


def only(left: DataFrame, keys: DataFrame, key: str, total: int, plain_rows: int | None = PLAIN_ROWS) -> DataFrame:
    """Semi-join to distinct ``keys``."""
    marks = keys.select(key).withColumn("_kept", F.lit(True))
    return lookup(left, marks, key, total, plain_rows).filter("_kept").drop("_kept")
