"""Page queries: top rows per source, then per category or overall."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.functions import text as tx
from newsloom.operators.ledger import top_per_key


def per_category(items: DataFrame, per_source: int = 2, limit: int = 6) -> DataFrame:
    """The first ``per_source`` items of each source in feed order, then
    the newest ``limit`` of each category."""
    heads = top_per_key(items, ["source", "category"], ["item_pos"], per_source, "_s").drop("_s")
    return top_per_key(heads, ["category"], [F.desc("published_at"), "source", "item_pos"], limit)


def newest_overall(items: DataFrame, per_source: int, limit: int) -> DataFrame:
    """The first ``per_source`` items of each source, then the newest
    ``limit`` of all."""
    heads = top_per_key(items, ["source"], ["item_pos"], per_source, "_s").drop("_s")
    return heads.orderBy(F.desc("published_at"), "source", "item_pos").limit(limit)


def with_meta(items: DataFrame, title_limit: int, meta: Sequence[Column]) -> DataFrame:
    """Display title and a " - " joined meta line of the non-empty parts."""
    parts = F.filter(F.array(*meta), lambda m: F.coalesce(m, F.lit("")) != "")
    return items.withColumns({"display_title": tx.ellipsis(F.col("title"), title_limit), "meta": F.array_join(parts, " - ")})


def first_rows(items: DataFrame, order: Sequence, limit: int = 8) -> DataFrame:
    return items.orderBy(*order).limit(limit)


def day_index(stubs: DataFrame) -> DataFrame:
    """One row per day, newest first: counts and the leading story.

    ``stubs`` has ``day, rank, slug, title, source_items``.
    """
    lead = F.min_by(F.struct("slug", "title"), "rank")
    return stubs.groupBy("day").agg(
        F.count("*").alias("article_count"), F.max("source_items").alias("source_item_count"), lead.alias("_l")
    ).select("day", "article_count", "source_item_count", F.col("_l.slug").alias("lead_slug"), F.col("_l.title").alias("lead_title")).orderBy(F.desc("day"))


def pick_brief(days: DataFrame, current: str) -> DataFrame:
    """The current day when it has articles, else the latest day that has."""
    usable = days.filter(F.col("article_count") > 0)
    row = F.struct(*usable.columns)
    return usable.agg(
        F.coalesce(F.max_by(row, F.when(F.col("day") == current, F.col("day"))), F.max_by(row, "day")).alias("r")
    ).filter(F.col("r").isNotNull()).select("r.*")


def static_paths(briefs: DataFrame) -> DataFrame:
    """One (date, slug) route per story of the archived days."""
    return briefs.filter(F.col("day").isNotNull()).select("day", F.explode("stubs").alias("s")).select("day", F.col("s.slug").alias("slug"))
