"""Monitored sources from a nested catalogue: one row per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsloom import schemas
from newsloom.functions import text as tx, urls as ux

COLUMNS = ["id", "family", "category", "title", "handle", "source_url", "feed_url", "item_limit"]


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CATALOGUE).option("multiLine", True).json(path)


def query_feed_url(topic: Column) -> Column:
    return F.concat(F.lit("https://news.google.com/rss/search?q="), F.url_encode(topic), F.lit("&hl=en-US&gl=US&ceid=US%3Aen"))


def _rows(df: DataFrame, **cols) -> DataFrame:
    text = {"id", "family", "category", "title", "handle", "source_url", "feed_url"}
    out = []
    for name in COLUMNS:
        value = cols.get(name)
        value = F.lit(value) if not isinstance(value, Column) else value
        out.append(value.cast("string" if name in text else "int").alias(name))
    return df.select(*out)


def _plain_slug(c: Column) -> Column:
    return tx.slug(c, cap=None, drop_quotes=False)


def expand(catalogue: DataFrame, today: str) -> DataFrame:
    """Every monitored source of every family."""
    c = catalogue
    channels = c.select(F.explode("youtube").alias("category", "handles")).select("category", F.explode("handles").alias("handle"))
    name = ux.handle_name(F.col("handle"))
    parts = [
        _rows(channels, id=F.concat(F.lit("youtube-"), _plain_slug(F.col("category")), F.lit("-"), _plain_slug(name)), family="youtube",
              category=F.col("category"), title=name, handle=F.col("handle"), source_url=F.concat(F.lit("https://www.youtube.com/@"), name)),
    ]
    topics = c.select(F.explode("googleNewsTopics").alias("topic"))
    parts.append(_rows(topics, id=F.concat(F.lit("google-news-"), _plain_slug(F.col("topic"))), family="googleNews", title=F.col("topic"),
                       feed_url=query_feed_url(F.col("topic"))))
    papers = c.filter(F.col("huggingFaceDailyPapers").isNotNull()).select(
        F.coalesce("huggingFaceDailyPapers.date", F.lit(today)).alias("d"), F.coalesce("huggingFaceDailyPapers.limit", F.lit(20)).alias("n"))
    parts.append(_rows(papers, id=F.concat(F.lit("huggingface-daily-papers-"), "d"), family="huggingFacePapers", category="academics",
                       title="Hugging Face Daily Papers", source_url=F.concat(F.lit("https://huggingface.co/papers/date/"), "d"),
                       feed_url=F.concat(F.lit("https://huggingface.co/api/daily_papers?p=0&limit="), F.col("n").cast("string"), F.lit("&date="), "d", F.lit("&sort=publishedAt")),
                       item_limit=F.col("n")))
    # --- fixed values: single-page sources (field, id, category, title, url, feed, limit) ---
    singles = [
        ("googleResearchBlog", "google-research-blog", "research", "Google Research Blog", "https://research.google/blog/", "https://research.google/blog/rss/", 10),
        ("anthropicResearch", "anthropic-research", "research", "Anthropic Research", "https://www.anthropic.com/research", None, 10),
        ("anthropicNews", "anthropic-news", "news", "Anthropic News", "https://www.anthropic.com/news", None, 10),
        ("metaAiResearch", "meta-ai-research", "research", "Meta AI Research", "https://ai.meta.com/research/", None, 1),
    ]
    for field, id_, category, title, url, feed, limit in singles:
        row = c.filter(F.col(field).isNotNull())
        feed_url = F.coalesce(f"{field}.rssUrl", F.lit(feed)) if feed else F.lit(None)
        parts.append(_rows(row, id=id_, family=field, category=category, title=title, source_url=F.coalesce(f"{field}.url", F.lit(url)),
                           feed_url=feed_url, item_limit=F.coalesce(f"{field}.limit", F.lit(limit))))
    vercel = c.select(F.col("vercelAnnouncements.limit").alias("n"), F.explode("vercelAnnouncements.feeds").alias("f"))
    parts.append(_rows(vercel, id=F.col("f.id"), family="vercelAnnouncements", category="announcements", title=F.col("f.title"),
                       source_url=F.col("f.url"), feed_url=F.col("f.rssUrl"), item_limit=F.coalesce("f.limit", "n", F.lit(10))))
    orgs = c.select(F.explode("githubOrganizations").alias("g")).select("g.*", F.coalesce("g.organization", "g.id").alias("org"))
    limit = F.coalesce("limit", F.lit(12))
    parts.append(_rows(orgs, id=F.concat(F.lit("github-"), "org"), family="githubOrganizations", category="github",
                       title=F.concat("org", F.lit(" GitHub")), source_url=F.coalesce("url", F.concat(F.lit("https://github.com/"), "org")),
                       feed_url=F.concat(F.lit("https://api.github.com/orgs/"), "org", F.lit("/repos?sort=updated&per_page="), limit.cast("string")), item_limit=limit))
    for field, family, category in (("metaResearchFeeds", "metaResearch", "research"), ("publicationFeeds", "publicationFeeds", "publications")):
        feeds = c.select(F.explode(field).alias("f"))
        parts.append(_rows(feeds, id=F.col("f.id"), family=family, category=category, title=F.col("f.title"), source_url=F.col("f.url"),
                           feed_url=F.col("f.rssUrl"), item_limit=F.coalesce("f.limit", F.lit(10))))
    queries = c.select(F.col("xaiResearchFeeds.limit").alias("n"), F.explode("xaiResearchFeeds.queries").alias("f"))
    parts.append(_rows(queries, id=F.col("f.id"), family="xaiResearch", category="research", title=F.col("f.title"), source_url=F.col("f.url"),
                       feed_url=query_feed_url(F.col("f.query")), item_limit=F.coalesce("f.limit", "n", F.lit(10))))
    profiles = c.select(
        F.coalesce("twitterProfiles.provider", F.lit("rsshub")).alias("provider"),
        F.regexp_replace(F.coalesce("twitterProfiles.rssBaseUrl", F.lit("https://rsshub-boost.23751.net")), "/$", "").alias("base"),
        F.coalesce("twitterProfiles.limit", F.lit(5)).alias("n"), F.explode("twitterProfiles.handles").alias("handle"))
    feed = F.when(F.col("provider") == "rsshub", F.concat(F.lit("/twitter/user/"), F.url_encode(name))).otherwise(F.concat(F.lit("/"), F.url_encode(name), F.lit("/rss")))
    parts.append(_rows(profiles, id=F.concat(F.lit("twitter-"), _plain_slug(name)), family="twitterFeeds", category="twitter",
                       title=F.concat(F.lit("@"), name), handle=F.col("handle"), source_url=F.concat(F.lit("https://x.com/"), name),
                       feed_url=F.concat("base", feed), item_limit=F.col("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def category_counts(catalogue: DataFrame) -> DataFrame:
    """Sources per family and category."""
    return expand(catalogue, "1970-01-01").groupBy("family", "category").agg(F.count("*").alias("n_sources"))


def enabled_sources(config: DataFrame) -> DataFrame:
    """RSS, web and video sources tagged with their kind, disabled ones out."""
    out = None
    for kind in ("rss", "web", "youtube"):
        part = config.select(F.explode(kind).alias("s")).select(F.lit(kind).alias("kind"), "s.*")
        out = part if out is None else out.unionByName(part)
    return out.filter(~F.coalesce("disabled", F.lit(False)))
