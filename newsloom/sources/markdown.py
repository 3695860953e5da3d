"""Markdown articles: front matter and body, in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_FRONT = r"(?s)^---\r?\n(.*?)\r?\n---"


def read_markdown(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(glob).select(F.col("_metadata.file_name").alias("path"), F.col("value").alias("text"))


def split_articles(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``front``, ``body`` and the URLs listed in each."""
    front = F.regexp_extract(text, _FRONT, 1)
    body = F.regexp_replace(text, r"(?s)^---\r?\n.*?\r?\n---\r?\n?", "")
    return df.withColumns({
        "front": front, "body": body,
        "listed_urls": F.regexp_extract_all(front, F.lit(r'url:\s+"([^"]+)"'), F.lit(1)),
        "body_urls": F.regexp_extract_all(body, F.lit(r"\]\((https?://[^)]+)\)"), F.lit(1)),
    })


def unlisted_links(articles: DataFrame, key: str) -> DataFrame:
    """Body links that the front matter does not list, and articles that
    list none."""
    missing = articles.filter(F.size("listed_urls") == 0).select(key, F.lit("missing citation URLs").alias("problem"), F.lit(None).cast("string").alias("url"))
    used = articles.select(key, F.explode("body_urls").alias("url"))
    listed = articles.select(key, F.explode("listed_urls").alias("url"))
    stray = used.join(listed, [key, "url"], "left_anti").select(key, F.lit("body URL is not listed").alias("problem"), "url")
    return missing.unionByName(stray)


def _scalar(c: Column) -> Column:
    """Quoted, escaped text of a front-matter value."""
    escaped = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.replace(F.replace(escaped, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")), F.lit('"'))


def to_markdown(title: Column, description: Column, day: Column, tags: Column, citations: Column, body: Column) -> Column:
    """Article text: YAML front matter, a blank line, the body."""
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\n"))
    tag_lines = F.array_join(F.transform(tags, lambda t: F.concat(F.lit("  - "), _scalar(t), F.lit("\n"))), "")
    citation_lines = F.array_join(
        F.transform(
            citations,
            lambda c: F.concat(F.lit("  - title: "), _scalar(c.title), F.lit("\n    url: "), _scalar(c.url), F.lit("\n    source: "), _scalar(c.source), F.lit("\n")),
        ), "")
    return F.concat(
        F.lit("---\n"), line("title", _scalar(title)), line("description", _scalar(description)), line("pubDate", _scalar(day)),
        line("sourceCount", F.size(citations).cast("string")), F.lit("tags:\n"), tag_lines, F.lit("citations:\n"), citation_lines,
        F.lit("---\n\n"), F.trim(body), F.lit("\n"),
    )
