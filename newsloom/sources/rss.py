"""RSS items from XML text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsloom import schemas
from newsloom.functions import dates as dx, html as hx, text as tx, urls as ux
from newsloom.sources.feeds import clean_categories

_OPTIONS = {"ignoreNamespace": "true", "mode": "PERMISSIVE"}


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Raw items of RSS files; the XML source splits at ``<item>``."""
    return spark.read.schema(schemas.RSS_ITEM).option("rowTag", "item").options(**_OPTIONS).format("xml").load(path)


def items_of_xml(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Raw items of an XML text column, the first ``limit`` per text."""
    blocks = F.regexp_extract_all(F.col(column), F.lit(r"(?is)<item\b.*?</item>"), F.lit(0))
    blocks = blocks if limit is None else F.slice(blocks, 1, limit)
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.posexplode(blocks).alias("item_pos", "_xml")).select(
        *rest, F.col("item_pos").cast("bigint").alias("item_pos"), F.from_xml("_xml", schemas.RSS_ITEM, _OPTIONS).alias("_i")
    ).select(*rest, "item_pos", "_i.*")


def _published(c: Column) -> Column:
    return F.coalesce(dx.iso(dx.parse_lenient(c)), tx.non_empty(F.trim(c)))


def publication_items(raw: DataFrame, source_title: Column) -> DataFrame:
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    keep = [c for c in raw.columns if c not in ("title", "link", "guid", "pubDate", "creator", "author", "description", "category")]
    return raw.select(
        *keep, text("title").alias("title"), text("link").alias("link"),
        F.coalesce(tx.non_empty(text("guid")), text("link")).alias("id"), _published(F.col("pubDate")).alias("published_at"),
        F.coalesce(tx.non_empty(text("creator")), tx.non_empty(text("author")), source_title).alias("author"),
        tx.collapse(F.col("description")).alias("summary"), clean_categories(F.col("category")).alias("categories"),
        F.coalesce(source_title, F.lit("Publication Feed")).alias("source"),
    )


def profile_items(raw: DataFrame, handle: Column, source_title: Column) -> DataFrame:
    """Social profile feed: markup out of title and text, mirror hosts
    rewritten, missing links from the handle."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    keep = [c for c in raw.columns if c not in ("title", "link", "guid", "pubDate", "creator", "author", "description", "category")]
    return raw.select(
        *keep, hx.visible_text(text("title")).alias("title"), ux.profile_link(text("link"), handle).alias("link"),
        F.coalesce(tx.non_empty(text("guid")), text("link")).alias("id"), _published(F.col("pubDate")).alias("published_at"),
        source_title.alias("author"), hx.visible_text(text("description")).alias("summary"),
        F.coalesce(source_title, F.lit("X")).alias("source"),
    )
