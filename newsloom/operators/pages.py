"""Crawled pages to documents: metadata, text spans, media."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsloom.functions import dates as dx, html as hx, text as tx, urls as ux


def page_metadata(pages: DataFrame) -> DataFrame:
    html, url = F.col("html"), F.col("url")
    site = hx.meta_content(html, "property", "og:site_name")
    time = tx.non_empty(F.regexp_extract(html, r'(?is)<time\b[^>]*?\sdatetime\s*=\s*["\']([^"\']*)["\']', 1))
    published = F.coalesce(hx.meta_content(html, "property", "article:published_time"), time)
    return pages.select(
        "page_id", "url",
        F.coalesce(tx.non_empty(F.trim(hx.page_title(html))), url).alias("title"),
        F.coalesce(site, ux.bare_host(url)).alias("publisher"),
        F.coalesce(hx.meta_content(html, "name", "author"), hx.meta_content(html, "property", "article:author")).alias("author"),
        dx.iso(dx.parse_lenient(published)).alias("published_at"),
    )


def text_spans(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Ordered text spans with hashed ids; cut before the explode."""
    spans = pages.select("page_id", "url", F.posexplode(hx.text_spans(F.col("html"), limit)).alias("pos", "text"))
    number = (F.col("pos") + 1).cast("string")
    mark = F.concat("url", F.lit(":span-"), number, F.lit(":"), "text")
    return spans.select(
        "page_id", "url", (F.col("pos") + 1).cast("bigint").alias("span_no"), "text",
        F.concat(F.lit("text-span:"), tx.stable_hash(mark, 20)).alias("span_id"),
        F.concat("url", F.lit("#span-"), number).alias("citation_url"),
    )


def media(pages: DataFrame, kind: str, tag: str, attribute: str, limit: int | None = None) -> DataFrame:
    """The page's card media and its tagged media, resolved and numbered."""
    html = F.col("html")
    card = F.filter(F.array(hx.meta_content(html, "property", f"og:{kind}")), lambda x: x.isNotNull())
    found = F.filter(F.concat(card, hx.attribute_values(html, tag, attribute)), lambda x: x != "")
    rows = pages.select("page_id", "url", F.posexplode(found if limit is None else F.slice(found, 1, limit)).alias("pos", "src"))
    return rows.select(
        "page_id", (F.col("pos") + 1).cast("bigint").alias("media_no"),
        F.concat(F.lit(f"{kind}:"), tx.stable_hash(F.concat("url", F.lit(f":{kind}:"), "src"), 20)).alias("media_id"),
        ux.resolve(F.col("src"), F.col("url")).alias("uri"),
    )


def excerpts(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", tx.excerpt(F.col("html")).alias("excerpt"))


def web_items(pages: DataFrame, source_id, source_name) -> DataFrame:
    """Ledger items of whole pages."""
    html = F.col("html")
    title = F.coalesce(tx.non_empty(hx.visible_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))), source_name)
    return pages.select(
        "page_id", F.concat(source_id, F.lit("-"), tx.slug(title)).alias("id"), title.alias("title"), "url",
        tx.summarize(hx.body_text(html), 4).alias("summary"),
    )
