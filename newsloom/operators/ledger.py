"""Append-only ledgers: latest-wins reads, ordered dedup, windows, merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom.functions import dates as dx, text as tx


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each key. The rank filter becomes a group limit
    that runs before the shuffle, so a hot key ships one row per task."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") == 1).drop("_rn")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence, limit: int, rank: str = "rank") -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= limit)


def latest_by_id(ledger: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """Latest record per id: one aggregate, combined before the shuffle."""
    row = F.struct(*[c for c in ledger.columns if c != key])
    return ledger.groupBy(key).agg(F.max_by(row, F.col(order)).alias("_r")).select(key, "_r.*")


def latest_where(ledger: DataFrame, predicate: Column, key: str = "id", order: str = "seq") -> DataFrame:
    return latest_by_id(ledger.filter(predicate), key, order)


def latest_in_day(ledger: DataFrame, status: str, day: str, zone: str) -> DataFrame:
    """Latest version per id among one local day's records of a status,
    with the position where the id was first seen."""
    todays = ledger.filter((F.col("status") == status) & (dx.local_day(F.col("observed_at"), zone) == F.lit(day).cast("date")))
    row = F.struct(*[c for c in ledger.columns if c != "id"])
    return todays.groupBy("id").agg(
        F.max_by(row, F.col("seq")).alias("_r"), F.min("seq").alias("first_seq")
    ).select("id", "_r.*", "first_seq")


def first_url_across_families(families: Sequence[DataFrame]) -> DataFrame:
    """Exact URL dedup over ordered families, first family wins.

    Each frame has ``url, source_pos, item_pos``; its rank is its place.
    """
    tagged = [df.withColumn("family_rank", F.lit(i)) for i, df in enumerate(families)]
    merged = tagged[0]
    for df in tagged[1:]:
        merged = merged.unionByName(df, allowMissingColumns=True)
    usable = merged.filter(F.coalesce(F.col("url"), F.lit("")) != "")
    return first_per_key(usable, ["url"], ["family_rank", "source_pos", "item_pos"])


def union_families(families: dict[str, DataFrame]) -> DataFrame:
    """Union of differently shaped families, tagged with their name."""
    merged = None
    for name, df in families.items():
        df = df.withColumn("family", F.lit(name))
        merged = df if merged is None else merged.unionByName(df, allowMissingColumns=True)
    return merged


def newest_first(items: DataFrame, limit: int, date: str = "day", tie: str = "id") -> DataFrame:
    return items.orderBy(F.col(date).desc_nulls_last(), tie).limit(limit)


def summary_items(items: DataFrame, family: str, title: Column | None = None) -> DataFrame:
    """Ledger form of feed items: fallback title and text, slug id, two
    sentence summary, lower-cased distinct tags. ``title`` is shown in place
    of the title with its fallbacks."""
    if title is None:
        title = F.coalesce(tx.non_empty(F.col("title")), F.col("id").cast("string"), F.col("source_name"))
    text = tx.strip_html(F.coalesce("transcript_summary", "transcript_text", "summary", "description", title))
    tags = F.concat(
        F.filter(F.array(F.lit("ai"), F.col("category"), F.col("topic"), F.lit(family)), lambda x: x.isNotNull() & (x != "")),
        F.coalesce("tags", F.array().cast("array<string>")),
    )
    slug_of = lambda c: tx.slug(c.cast("string"))
    return items.select(
        F.concat_ws("-", slug_of(F.lit(family)), slug_of(F.coalesce("source_id", "source_name")), slug_of(F.coalesce(F.col("id").cast("string"), F.col("url"), title))).alias("ledger_id"),
        F.coalesce("source_id", tx.slug(F.col("source_name"))).alias("source_id"), "source_name", F.lit(family).alias("kind"),
        title.alias("title"), "url", "day", tx.summarize(text, 2).alias("summary"),
        F.slice(F.array_distinct(F.transform(tags, lambda x: F.lower(x))), 1, 10).alias("tags"), F.lit("ok").alias("status"),
    )


def ledger_header(items: DataFrame) -> DataFrame:
    """One row: sources, items, window and errors. Sources are counted
    after a per-source pre-aggregation."""
    per_source = items.groupBy("source_name").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") != "ok").alias("e"), F.min("day").alias("lo"), F.max("day").alias("hi")
    )
    return per_source.agg(
        F.count("*").alias("source_count"), F.sum("n").alias("item_count"), F.sum("e").alias("error_count"),
        F.min("lo").alias("start_day"), F.max("hi").alias("end_day"),
    )


def family_health(rows: DataFrame, family: str, ok: Column) -> DataFrame:
    return rows.groupBy(family).agg(F.count("*").alias("total"), F.count_if(ok).alias("ok"))


def family_health_wide(health: DataFrame, family: str, names: Sequence[str]) -> DataFrame:
    """One row with a total and an ok column per named family."""
    out = []
    for name in names:
        hit = F.col(family) == name
        out += [F.coalesce(F.sum(F.when(hit, F.col(c))), F.lit(0)).cast("bigint").alias(f"{name}_{c}") for c in ("total", "ok")]
    return health.agg(*out)


def unchanged_skipped(incoming: DataFrame, latest: DataFrame) -> DataFrame:
    """Incoming rows whose (id, hash) is not already parsed."""
    done = latest.filter(F.col("status") == "parsed").select("id", "content_hash")
    return incoming.join(done, ["id", "content_hash"], "left_anti")


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    fresh = incoming.join(existing.select(key), key, "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """New rows replace old rows of the same key."""
    kept = existing.join(incoming.select(key), key, "left_anti")
    return incoming.unionByName(kept, allowMissingColumns=True)


def bucketed_rank(df: DataFrame, key: str, bucket: str, order: str, name: str) -> DataFrame:
    """Position of each row within its key, without sorting a whole key in
    one task: ranks inside (key, bucket) plus the sizes of earlier buckets.
    ``bucket`` must grow with ``order``."""
    inside = Window.partitionBy(key, bucket).orderBy(order)
    earlier = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(key, bucket).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    return (
        df.withColumn("_r", F.row_number().over(inside)).join(sizes.drop("_n"), [key, bucket])
        .withColumn(name, F.col("_r") + F.col("_before")).drop("_r", "_before")
    )


def bucketed_previous(df: DataFrame, key: str, bucket: str, order: str, column: str, name: str) -> DataFrame:
    """Value of the previous row of the key: a lag inside (key, bucket),
    and the last value of the nearest earlier bucket for its first row."""
    inside = Window.partitionBy(key, bucket).orderBy(order)
    earlier = Window.partitionBy(key).orderBy(bucket)
    last = df.groupBy(key, bucket).agg(F.max_by(column, order).alias("_last")).withColumn("_carry", F.lag("_last").over(earlier))
    return (
        df.withColumn("_lag", F.lag(column).over(inside)).join(last.drop("_last"), [key, bucket])
        .withColumn(name, F.coalesce("_lag", "_carry")).drop("_lag", "_carry")
    )
