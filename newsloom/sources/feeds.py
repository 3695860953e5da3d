"""Feed item normalisers. One transform over the item array, cut before
anything is exploded; families differ only in their defaults."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.functions import html as hx, text as tx, urls as ux


@dataclass(frozen=True)
class Variant:
    author: str | None = None        # default author; "@title" = feed title
    source: str | None = None        # default source label
    categories: str = "none"         # none, raw or cleaned
    limit: int = 10


# --- fixed values: per-family defaults ---
VARIANTS = {
    "generic": Variant(),
    "googleResearch": Variant("Google Research", None, "raw"),
    "vercelAnnouncements": Variant("Vercel", "Vercel"),
    "metaResearch": Variant("Meta Research", "Meta Research", "cleaned"),
    "publicationFeeds": Variant("@title", "Publication Feed", "cleaned"),
    "xaiResearch": Variant("xAI", "xAI Research"),
}


def clean_categories(c: Column) -> Column:
    def clean(x: Column) -> Column:
        x = F.regexp_replace(F.regexp_replace(x, r"^<!\[CDATA\['?", ""), r"'?\]\]>$", "")
        return F.trim(F.replace(x, F.lit("&amp;"), F.lit("&")))

    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), clean), lambda x: x != "")


def normalize_items(raw: Column, variant: Variant, feed_title: Column, limit: int | None = None) -> Column:
    """Array of normalised items from an array of raw feed entries."""
    blank = F.lit("")
    default_author = feed_title if variant.author == "@title" else F.lit(variant.author)

    def one(x: Column) -> Column:
        fields = [
            F.coalesce(x.title, blank).alias("title"), F.coalesce(x.link, blank).alias("link"),
            F.coalesce(x.id, x.guid, x.link, blank).alias("id"), F.coalesce(x.isoDate, x.pubDate).alias("publishedAt"),
            F.coalesce(x.creator, x.author, default_author).alias("author"),
            F.coalesce(x.contentSnippet, x.summary, blank).alias("summary"),
        ]
        if variant.categories == "raw":
            fields.append(F.coalesce(x.categories, F.array().cast("array<string>")).alias("categories"))
        elif variant.categories == "cleaned":
            fields.append(clean_categories(x.categories).alias("categories"))
        if variant.source is not None:
            fields.append(F.coalesce(feed_title, F.lit(variant.source)).alias("source"))
        return F.struct(*fields)

    return F.transform(F.slice(raw, 1, limit or variant.limit), one)


def papers(raw: Column, limit: int = 20) -> Column:
    def one(x: Column) -> Column:
        p = x.paper
        paper_id = F.coalesce(p.id, x.id, F.lit(""))
        names = F.filter(
            F.transform(F.filter(F.coalesce(p.authors, F.array()), lambda a: ~F.coalesce(a.hidden, F.lit(False))), lambda a: a["name"]),
            lambda n: n.isNotNull() & (n != ""),
        )
        return F.struct(
            F.coalesce(p.title, x.title, F.lit("")).alias("title"),
            F.when(paper_id != "", F.concat(F.lit("https://huggingface.co/papers/"), paper_id)).otherwise("").alias("link"),
            paper_id.alias("id"), F.coalesce(p.publishedAt, x.publishedAt).alias("publishedAt"),
            F.coalesce(p.submittedOnDailyAt, x.publishedAt).alias("submittedAt"),
            F.array_join(F.slice(names, 1, 3), ", ").alias("author"), names.alias("authors"),
            F.coalesce(p.ai_summary, p.summary, x.summary, F.lit("")).alias("summary"),
            F.coalesce(p.upvotes, F.lit(0)).cast("bigint").alias("upvotes"),
            F.coalesce(x.numComments, F.lit(0)).cast("bigint").alias("comments"), x.thumbnail.alias("thumbnail"),
            p.projectPage.alias("projectPage"), p.githubRepo.alias("githubRepo"),
            F.coalesce(p.ai_keywords, F.array().cast("array<string>")).alias("keywords"),
        )

    return F.transform(F.slice(raw, 1, limit), one)


def repositories(raw: Column, limit: int = 12) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.transform(
        F.slice(raw, 1, limit),
        lambda r: F.struct(
            F.coalesce(r.full_name, r["name"], F.lit("")).alias("title"), F.coalesce(r.html_url, F.lit("")).alias("link"),
            F.coalesce(F.nullif(r.id, F.lit(0)).cast("string"), r.html_url, r["name"], F.lit("")).alias("id"),
            F.coalesce(r.pushed_at, r.updated_at).alias("publishedAt"), r.updated_at.alias("updatedAt"),
            r.owner.login.alias("author"), F.coalesce(r.description, F.lit("")).alias("summary"),
            F.coalesce(r.stargazers_count, zero).alias("stars"), F.coalesce(r.forks_count, zero).alias("forks"),
            r.language.alias("language"), F.coalesce(r.open_issues_count, zero).alias("openIssues"),
        ),
    )


def page_row(pages: DataFrame, default_url: str, title_suffix: str = r"\s+\|\s+AI at Meta$", author: str = "Meta AI") -> DataFrame:
    """One item per page from its meta tags; pages without a title go."""
    html = F.col("html")
    title = F.regexp_replace(
        F.coalesce(hx.meta_content(html, "property", "og:title"), hx.meta_content(html, "name", "title"), "source_title", F.lit("")),
        title_suffix, "")
    summary = F.coalesce(hx.meta_content(html, "property", "og:description"), hx.meta_content(html, "name", "description"), F.lit(""))
    link = F.coalesce(hx.json_ld_url(html), "source_url", F.lit(default_url))
    return pages.select(
        "page_id", title.alias("title"), link.alias("link"), link.alias("id"), F.lit(author).alias("author"), summary.alias("summary")
    ).filter(F.col("title") != "")


def index_cards(pages: DataFrame, base_path: str, index_path: str, skip_prefix: str, limit: int = 10, text_titles: bool = False) -> DataFrame:
    """Best record per link of each index page, newest first.

    The longest record of a link wins, the first on ties. With
    ``text_titles`` an anchor without headings is titled by its text.
    """
    from newsloom.functions.dates import iso, parse_lenient
    from newsloom.operators.ledger import first_per_key, top_per_key

    anchors = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode(hx.anchors(F.col("html"))).alias("pos", "a"))
    inner = F.col("a.inner")
    link = ux.resolve(F.col("a.href"), F.col("page_url"))
    headings = F.coalesce(tx.non_empty(hx.classed_text(inner, "title")), tx.non_empty(hx.element_text(inner, ["h1", "h2", "h3"])))
    title = F.coalesce(headings, tx.non_empty(hx.visible_text(inner)) if text_titles else F.lit(None).cast("string"))
    stamp = tx.non_empty(hx.element_text(inner, ["time"]))
    kind = F.coalesce(tx.non_empty(hx.classed_text(inner, "subject")), tx.non_empty(hx.classed_text(inner, "meta")), tx.non_empty(hx.classed_text(inner, "caption")), F.lit(""))
    cards = anchors.select(
        "page_id", "page_url", "pos", link.alias("link"), title.alias("title"), iso(parse_lenient(stamp)).alias("published_at"),
        kind.alias("category"), hx.element_text(inner, ["p"]).alias("summary"),
    )
    same_host = ux.hostname(F.col("link")) == ux.hostname(F.col("page_url"))
    target = ux.path(F.col("link"))
    kept = cards.filter(same_host & F.startswith(target, F.lit(base_path)) & (target != index_path) & ~F.startswith(target, F.lit(skip_prefix)))
    kept = kept.filter(F.col("title").isNotNull() & (F.col("title") != "Research")).drop("page_url")
    weight = F.length(F.concat_ws("", "title", "published_at", "category", "summary"))
    best = first_per_key(kept.withColumn("weight", weight), ["page_id", "link"], [F.desc("weight"), "pos"])
    # a link keeps the place of its first record
    first = kept.groupBy("page_id", "link").agg(F.min("pos").alias("first_pos"))
    return top_per_key(best.join(first, ["page_id", "link"]), ["page_id"], [F.col("published_at").desc_nulls_last(), "first_pos"], limit)
