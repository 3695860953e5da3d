"""Page, feed, transcript, source and sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import sqltext as q
from newsloom.catalog.base import register
from newsloom.operators import citations as ct, pages as pg, transcripts as tr
from newsloom.operators.ledger import latest_by_id
from newsloom.session import new_stage_path, stage
from newsloom.sources import catalogue, feeds, markdown, rss, sinks, snapshots, versions

TITLE = q.visible("regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')")


@register("page_metadata", "P12", f"""
SELECT page_id, url, coalesce(nullif({TITLE}, ''), url) AS title, {q.bare_host('url')} AS publisher,
  CAST(NULL AS VARCHAR) AS author, CAST(NULL AS VARCHAR) AS published_at FROM pages""")
def _(t):
    return pg.page_metadata(t.pages)


SPANS = f"""spans AS (
  SELECT page_id, url, unnest(s) AS text, unnest(range(1, len(s) + 1)) AS span_no
  FROM (SELECT page_id, url, ({q.text_spans('html')}) AS s FROM pages))"""


@register("page_text_spans", "P11", q.with_([SPANS], f"""
SELECT page_id, span_no, text, 'text-span:' || {q.hash_id("url || ':span-' || span_no || ':' || text", 20)} AS span_id,
  url || '#span-' || span_no AS citation_url FROM spans"""))
def _(t):
    return pg.text_spans(t.pages).drop("url")


@register("page_media", "P13", q.with_([q.PAGE_LINKS], f"""
SELECT page_id, pos AS media_no, 'image:' || {q.hash_id("page_url || ':image:' || href", 20)} AS media_id, url AS uri
FROM page_links"""))
def _(t):
    # the given pages have no images, so their anchors stand in
    return pg.media(t.pages, "image", "a", "href")


@register("page_excerpts", "P28", f"""
SELECT page_id, CASE WHEN length(body) < 120 THEN '' ELSE {q.ellipsis('body', 800)} END AS excerpt FROM (
  SELECT page_id, {q.collapse("regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + q.strip_html('html') + r", 'https?://\S+', ' ', 'gi'), '([a-z])([A-Z])', '\1 \2', 'g'), '\.([A-Z])', '. \1', 'g'), '\bOpen AI\b', 'OpenAI', 'g')")} AS body FROM pages)""")
def _(t):
    return pg.excerpts(t.pages)


@register("page_feed_rows", "P9", f"""
SELECT page_id, {TITLE} AS title, url AS link, '' AS summary FROM pages WHERE {TITLE} <> ''""")
def _(t):
    from newsloom.functions import html as hx

    rows = t.pages.withColumns({"source_title": hx.page_title(F.col("html")), "source_url": F.col("url")})
    return feeds.page_row(rows, "https://ai.meta.com/research/").select("page_id", "title", "link", "summary")


CARDS = rf"""raw_cards AS (
  SELECT page_id, page_url, unnest(range(len(hrefs))) AS pos, unnest(hrefs) AS href, unnest(inners) AS inner_html
  FROM (SELECT page_id, url AS page_url, regexp_extract_all(html, '<a\b[^>]*?\shref\s*=\s*["'']([^"'']*)["''][^>]*>.*?</a\s*>', 1, 'is') AS hrefs,
               regexp_extract_all(html, '<a\b[^>]*?\shref\s*=\s*["''][^"'']*["''][^>]*>(.*?)</a\s*>', 1, 'is') AS inners FROM pages)),
cards AS (SELECT page_id, pos, {q.scheme('page_url')} || '://' || {q.authority('page_url')} || href AS link, {q.visible('inner_html')} AS title
  FROM raw_cards WHERE starts_with(href, '/') AND href <> '/the' AND NOT starts_with(href, '/th'))"""


@register("link_cards", "P10", q.with_([CARDS], """
SELECT page_id, link, title FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY first_pos) AS rank FROM (
    SELECT *, min(pos) OVER (PARTITION BY page_id, link) AS first_pos,
      row_number() OVER (PARTITION BY page_id, link ORDER BY length(title) DESC, pos) AS rn FROM cards WHERE title <> '' AND title <> 'Research')
  WHERE rn = 1) WHERE rank <= 10"""))
def _(t):
    cards = feeds.index_cards(t.pages, "/", "/the", "/th", 10, text_titles=True)
    return cards.select("page_id", "link", "title")


@register("citation_previews", "P20", q.with_([q.PAGE_LINKS], f"""
SELECT page_id, pos, 'source' AS kind, 'Source' AS label, {q.bare_host('url')} AS host, {q.ellipsis("href || ' ' || url", 140)} AS preview_title,
  {q.ellipsis('repeat(url || chr(32), 6)', 220)} AS snippet FROM page_links"""))
def _(t):
    cited = t.page_links.select("page_id", "pos", "url", F.concat("href", F.lit(" "), "url").alias("title"),
                                F.lit(None).cast("string").alias("source_name"), F.repeat(F.concat("url", F.lit(" ")), 6).alias("summary"))
    return ct.previews(cited).select("page_id", "pos", "kind", "label", "host", "preview_title", "snippet")


@register("social_posts", "P21 P20", q.with_([q.ITEMS], f"""
SELECT id, CASE WHEN kind = 'en' THEN 'retweet' WHEN kind = 'fr' THEN 'quote' ELSE 'post' END AS post_kind,
  CASE WHEN kind = 'en' THEN 'author' || source_name END AS original_author,
  CASE WHEN kind IN ('en', 'fr') THEN 'https://x.com/' || source_name || '/status/' || id END AS quoted_url,
  CASE WHEN kind = 'en' THEN 'Retweet' WHEN kind = 'fr' THEN 'Quote' ELSE 'X post' END AS label
FROM items"""))
def _(t):
    words = F.regexp_replace(F.regexp_replace("title", "[^A-Za-z ]", ""), "^$", "note")
    link = F.concat(F.lit(" https://x.com/"), "source_name", F.lit("/status/"), F.col("id").cast("string"), F.lit("?s=20 "))
    text = (
        F.when(F.col("kind") == "en", F.concat(F.lit("RT @author"), "source_name", F.lit(": "), words, link))
        .when(F.col("kind") == "fr", F.concat(words, link)).otherwise(words))
    posts = t.items.select("id", F.lit("Post").alias("title"), text.alias("summary"), "source_name",
                           F.concat(F.lit("https://twitter.com/me/status/"), F.col("id").cast("string")).alias("url"))
    return ct.previews(posts).select("id", "post_kind", "original_author", "quoted_url", "label")


TRANSCRIPT = f"""transcript AS (
  SELECT conv_id, {q.collapse("string_agg(text, ' ' ORDER BY turn)")} AS text FROM conversations GROUP BY conv_id)"""


@register("transcript_sentences", "P16", q.with_([TRANSCRIPT], f"""
SELECT conv_id, unnest(s) AS sentence, unnest(range(1, len(s) + 1)) AS sentence_no FROM (SELECT conv_id, {q.sentences('text')} AS s FROM transcript)"""))
def _(t):
    return tr.sentences(t.turns)


@register("transcript_items", "P16", q.with_([TRANSCRIPT], f"""
SELECT conv_id, 'video-' || conv_id AS title, 'yt-' || conv_id || '-video-' || conv_id AS id, {q.summarize('text', 5)} AS summary FROM transcript WHERE text <> ''"""))
def _(t):
    conv = F.col("conv_id").cast("string")
    return tr.ingest_items(stage(tr.sentences(t.turns), "sentences"), F.concat(F.lit("yt-"), conv), F.concat(F.lit("video-"), conv))


PICKED = f"""parts AS (SELECT conv_id, unnest(s) AS sentence, unnest(range(1, len(s) + 1)) AS no
  FROM (SELECT conv_id, list_filter({q.raw_sentences('text')}, lambda s: length(s) > 35) AS s FROM transcript)),
graded AS (SELECT conv_id, sentence, no, 0 AS grade FROM parts WHERE no <= 2
  UNION ALL SELECT conv_id, sentence, no, 1 FROM parts WHERE regexp_matches(sentence, '(?i)\\b(tion|eau|ung|ther|with)\\b')),
uniq AS (SELECT conv_id, arg_min(sentence, grade * 1000000 + no) AS sentence, min(grade * 1000000 + no) AS place FROM graded GROUP BY conv_id, lower(sentence)),
top AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS rank FROM uniq),
summed AS (SELECT conv_id, coalesce(string_agg(sentence, ' ' ORDER BY place) FILTER (WHERE rank <= 5), max(substring(text, 1, 500))) AS transcript_summary
  FROM transcript LEFT JOIN top USING (conv_id) WHERE text <> '' GROUP BY conv_id)"""


@register("transcript_enrichment", "P14 E3", q.with_([q.ITEMS, TRANSCRIPT, PICKED], """
SELECT id, coalesce(nullif(CASE WHEN kind = 'en' THEN '' ELSE summary END, ''), transcript_summary, '') AS summary,
  CASE WHEN transcript_summary IS NULL THEN 'unavailable' ELSE 'ok' END AS transcript_status
FROM items LEFT JOIN summed ON conv_id = id"""))
def _(t):
    found = tr.highlights(stage(tr.sentences(t.turns), "sentences"), r"\b(tion|eau|ung|ther|with)\b").withColumnRenamed("conv_id", "video_id")
    items = t.items.select("id", F.col("id").alias("video_id"), F.when(F.col("kind") == "en", "").otherwise(F.col("summary")).alias("summary"))
    return tr.enrich(items, found).select("id", "summary", "transcript_status")


@register("web_items", "P16", f"""
SELECT page_id, {TITLE} AS title, 'web-' || {q.slug(TITLE)} AS id, url FROM pages WHERE {TITLE} <> ''""")
def _(t):
    return pg.web_items(t.pages, F.lit("web"), F.col("url")).select("page_id", "id", "title", "url")


ENTRIES, TAKEN = 3, 2  # entries of a feed, and how many of them a query takes


def raw_entry(t):
    """Documents as feeds of several raw entries with missing fields."""
    none = F.lit(None).cast("string")
    even = F.col("id") % 2 == 0
    entry = lambda k: F.struct(
        F.when(even, F.col("title")).alias("title"), F.concat("url", F.lit(f"?e={k}")).alias("link"), none.alias("id"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("guid-"), F.col("id").cast("string"), F.lit(f"-{k}"))).alias("guid"),
        F.when(even, F.col("day").cast("string")).alias("isoDate"), F.lit("2024-02-01").alias("pubDate"),
        F.when(F.col("id") % 5 == 0, F.col("source_name")).alias("creator"), none.alias("author"),
        F.when(F.col("id") % 4 == 0, F.col("title")).alias("contentSnippet"), F.col("title").alias("summary"),
        F.concat(F.array(F.concat(F.lit("<![CDATA['"), "kind", F.lit("']]>")), F.lit(" ")), F.array("source_name")).alias("categories"),
    )
    return t.items.select("id", "source_name", F.array(*map(entry, range(ENTRIES))).alias("raw"))


FEED_SQL = q.with_([q.ITEMS], """
SELECT id, CAST(entry AS INTEGER) AS entry, CASE WHEN id % 2 = 0 THEN title ELSE '' END AS title, url || '?e=' || entry AS link,
  CASE WHEN id % 3 = 0 THEN 'guid-' || id || '-' || entry ELSE url || '?e=' || entry END AS item_id,
  CASE WHEN id % 2 = 0 THEN strftime(day, '%Y-%m-%d') ELSE '2024-02-01' END AS published_at,
  CASE WHEN id % 5 = 0 THEN source_name ELSE {author} END AS author, {categories} AS categories, {source} AS source FROM items, range(2) r(entry)""")


def feed_query(t, family):
    variant = feeds.VARIANTS[family]
    taken = feeds.normalize_items(F.col("raw"), variant, F.col("source_name"), TAKEN)
    rows = raw_entry(t).select("id", F.posexplode(taken).alias("entry", "i"))
    cats = F.array_join("i.categories", "|") if variant.categories != "none" else F.lit("")
    source = F.col("i.source") if variant.source else F.lit("")
    return rows.select("id", "entry", "i.title", "i.link", F.col("i.id").alias("item_id"), F.col("i.publishedAt").alias("published_at"), "i.author",
                       cats.alias("categories"), source.alias("source"))


RAW_CATS = "'<![CDATA[''' || kind || ''']]>| |' || source_name"
for _name, _family, _ids, _author, _cats, _source in [
    ("feed_items", "generic", "P1", "NULL", "''", "''"),
    ("blog_feed_items", "googleResearch", "P2", "'Google Research'", RAW_CATS, "''"),
    ("announcement_feed_items", "vercelAnnouncements", "P3", "'Vercel'", "''", "source_name"),
    ("research_feed_items", "metaResearch", "P4", "'Meta Research'", "kind || '|' || source_name", "source_name"),
    ("publication_feed_items", "publicationFeeds", "P5", "source_name", "kind || '|' || source_name", "source_name"),
    ("query_feed_items", "xaiResearch", "P6", "'xAI'", "''", "source_name"),
]:
    register(_name, _ids, FEED_SQL.format(author=_author, categories=_cats, source=_source))(lambda t, f=_family: feed_query(t, f))


@register("paper_items", "P7", q.with_([q.ITEMS], """
SELECT id, CAST(entry AS INTEGER) AS entry, title, 'https://huggingface.co/papers/' || id || '-' || entry AS link, strftime(day, '%Y-%m-%d') AS published_at,
  CASE WHEN kind = 'en' THEN source_name || ', ' || kind ELSE kind END AS author, id % 7 AS upvotes, CASE WHEN id % 2 = 0 THEN 3 ELSE 0 END AS comments FROM items, range(2) r(entry)"""))
def _(t):
    none = F.lit(None).cast("string")
    authors = F.array(F.struct(F.col("source_name").alias("name"), (F.col("kind") != "en").alias("hidden")), F.struct(F.col("kind").alias("name"), F.lit(None).cast("boolean").alias("hidden")))
    paper = lambda k: F.struct(F.concat(F.col("id").cast("string"), F.lit(f"-{k}")).alias("id"), F.col("title").alias("title"), authors.alias("authors"), F.col("day").cast("string").alias("publishedAt"),
                     none.alias("submittedOnDailyAt"), F.col("title").alias("summary"), none.alias("ai_summary"), (F.col("id") % 7).alias("upvotes"),
                     F.array("kind").alias("ai_keywords"), none.alias("projectPage"), none.alias("githubRepo"))
    entry = lambda k: F.struct(none.alias("id"), none.alias("title"), none.alias("publishedAt"), none.alias("summary"),
                     F.when(F.col("id") % 2 == 0, F.lit(3).cast("bigint")).alias("numComments"), none.alias("thumbnail"), paper(k).alias("paper"))
    return t.items.select("id", F.posexplode(feeds.papers(F.array(*map(entry, range(ENTRIES))), TAKEN)).alias("entry", "p")).select(
        "id", "entry", "p.title", "p.link", F.col("p.publishedAt").alias("published_at"), "p.author", "p.upvotes", "p.comments")


@register("repository_items", "P8", q.with_([q.ITEMS], """
SELECT id, CAST(entry AS INTEGER) AS entry, source_name || '/' || kind AS title, url || '?e=' || entry AS link,
  CASE WHEN id * 10 + entry = 0 THEN url || '?e=' || entry ELSE CAST(id * 10 + entry AS VARCHAR) END AS repo_id, strftime(day, '%Y-%m-%d') AS published_at,
  source_name AS author, id % 11 AS stars, 0 AS forks FROM items, range(2) r(entry)"""))
def _(t):
    none = F.lit(None).cast("string")
    repo = lambda k: F.struct(
                    (F.col("id") * 10 + k).alias("id"), F.concat("source_name", F.lit("/"), "kind").alias("full_name"), none.alias("name"), F.concat("url", F.lit(f"?e={k}")).alias("html_url"), none.alias("description"),
                    (F.col("id") % 11).alias("stargazers_count"), F.lit(None).cast("bigint").alias("forks_count"), F.lit(1).cast("bigint").alias("open_issues_count"),
                    F.col("kind").alias("language"), none.alias("pushed_at"), F.col("day").cast("string").alias("updated_at"), F.struct(F.col("source_name").alias("login")).alias("owner"))
    return t.items.select("id", F.posexplode(feeds.repositories(F.array(*map(repo, range(ENTRIES))), TAKEN)).alias("entry", "r")).select(
        "id", "entry", "r.title", "r.link", F.col("r.id").alias("repo_id"), F.col("r.publishedAt").alias("published_at"), "r.author", "r.stars", "r.forks")


def item_xml(t):
    """Documents as RSS item text."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    day = F.date_format("day", "EEE, dd MMM yyyy")
    xml = F.concat(
        F.lit("<item><title>"), esc(F.col("title")), F.lit("</title><link>"), "url", F.lit("</link><guid>g-"), F.col("id").cast("string"),
        F.lit("</guid><pubDate>"), day, F.lit(" 06:30:00 GMT</pubDate><dc:creator>"), "source_name",
        F.lit("</dc:creator><category><![CDATA['"), "kind", F.lit("']]></category><category>"), "source_name", F.lit("</category><description>"),
        esc(F.col("summary")), F.lit("</description></item>"))
    return t.items.select("id", xml.alias("xml"))


RSS_SQL = q.with_([q.ITEMS], """
SELECT {key}'g-' || id AS item_id, title, url AS link, strftime(day, '%Y-%m-%d') || 'T06:30:00.000Z' AS published_at, source_name AS author, summary,
  '''' || kind || '''|' || source_name AS categories FROM items""")


def rss_view(rows, *keys):
    return rows.select(*keys, F.col("id").alias("item_id"), "title", "link", "published_at", "author", "summary", F.array_join("categories", "|").alias("categories"))


@register("rss_items", "S4 X18", RSS_SQL.format(key="id, "))
def _(t):
    raw = rss.items_of_xml(item_xml(t).withColumnRenamed("id", "doc"), "xml")
    return rss_view(rss.publication_items(raw, F.lit("Feed")), F.col("doc").alias("id"))


@register("rss_scan", "S4", RSS_SQL.format(key=""))
def _(t):
    path = new_stage_path(t.spark, "rss")
    rows = t.items.select(
        "title", F.col("url").alias("link"), F.concat(F.lit("g-"), F.col("id").cast("string")).alias("guid"),
        F.concat(F.date_format("day", "EEE, dd MMM yyyy"), F.lit(" 06:30:00 GMT")).alias("pubDate"), F.col("source_name").alias("creator"),
        F.array(F.concat(F.lit("'"), "kind", F.lit("'")), F.col("source_name")).alias("category"), F.col("summary").alias("description"))
    rows.write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(path)
    return rss_view(rss.publication_items(rss.read_rss(t.spark, path), F.lit("Feed")))


@register("profile_feed_items", "S4 X23", q.with_([q.ITEMS], """
SELECT id, 'https://x.com/' || source_name || '/status/' || id AS link, kind || ' bold' AS title, source_name AS author FROM items"""))
def _(t):
    xml = F.concat(F.lit("<item><title>&lt;b&gt;"), "kind", F.lit("&lt;/b&gt; bold</title><link>https://nitter.net/"), "source_name", F.lit("/status/"),
                   F.col("id").cast("string"), F.lit("</link><description>d</description></item>"))
    raw = rss.items_of_xml(t.items.select(F.col("id").alias("doc"), "source_name", xml.alias("xml")), "xml", 5)
    return rss.profile_items(raw, F.col("source_name"), F.col("source_name")).select(F.col("doc").alias("id"), "link", "title", "author")


@register("snapshot_scan", "S1 K2", q.with_([q.ITEMS], """
SELECT CASE kind WHEN 'en' THEN 'youtube' WHEN 'fr' THEN 'googleNews' WHEN 'de' THEN 'metaResearch' ELSE 'twitterFeeds' END AS family,
  CASE kind WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 8 ELSE 11 END AS family_rank,
  source_name AS source_id, title, url, kind AS tags FROM items WHERE status = 'ok'"""))
def _(t):
    """Write one snapshot per family in the three shapes, then scan them."""
    family = F.when(F.col("kind") == "en", "youtube").when(F.col("kind") == "fr", "googleNews").when(F.col("kind") == "de", "metaResearch").otherwise("twitterFeeds")
    item = F.struct(F.col("title"), F.col("url").alias("link"), F.array("kind").alias("categories"))
    src = F.struct(F.col("source_name").alias("id"), F.col("source_name").alias("title"), "status", F.array(item).alias("items"))
    rows = t.items.select(
        family.alias("family"), F.when(F.col("kind") == "en", F.array(src)).alias("sources"),
        F.when(F.col("kind").isin("fr", "es"), src).alias("source"), F.when(F.col("kind") == "de", src).alias("aiResearch"))
    path = new_stage_path(t.spark, "snapshots")
    sinks.write_families(rows, path)
    found = snapshots.snapshot_items(snapshots.snapshot_sources(snapshots.read_snapshots(t.spark, path, multi_line=False)))
    return found.select("family", F.col("family_rank").cast("bigint").alias("family_rank"), "source_id", "title", "url", F.array_join("tags", "|").alias("tags"))


def catalogue_rows(t):
    """A catalogue whose entries come from the documents' sources."""
    pair = t.read("documents").select("lang", "source").distinct()
    return pair.select(
        F.create_map("lang", F.array(F.concat(F.lit("@"), "source"))).alias("youtube"), F.array(F.concat("source", F.lit(" "), "lang")).alias("googleNewsTopics"),
        F.lit(None).cast("struct<date: string, limit: int>").alias("huggingFaceDailyPapers"),
        F.when(F.col("lang") == "en", F.struct(F.concat(F.lit("https://"), "source").alias("url"), F.lit(None).cast("string").alias("rssUrl"), F.lit(7).alias("limit"))).alias("googleResearchBlog"),
        *[F.lit(None).cast("struct<url: string, rssUrl: string, limit: int>").alias(n) for n in ("anthropicResearch", "anthropicNews", "metaAiResearch")],
        F.lit(None).cast("struct<limit: int, feeds: array<struct<id: string, title: string, url: string, rssUrl: string, limit: int>>>").alias("vercelAnnouncements"),
        F.array(F.struct(F.col("source").alias("id"), F.lit(None).cast("string").alias("organization"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("int").alias("limit"))).alias("githubOrganizations"),
        *[F.lit(None).cast("array<struct<id: string, title: string, url: string, rssUrl: string, limit: int>>").alias(n) for n in ("metaResearchFeeds", "publicationFeeds")],
        F.lit(None).cast("struct<limit: int, queries: array<struct<id: string, title: string, url: string, query: string, limit: int>>>").alias("xaiResearchFeeds"),
        F.struct(F.lit(None).cast("string").alias("provider"), F.lit(None).cast("string").alias("rssBaseUrl"), F.lit(None).cast("int").alias("limit"),
                 F.lit(None).cast("int").alias("timeoutMs"), F.array(F.concat(F.lit("@"), "source", F.lit("_"), "lang")).alias("handles")).alias("twitterProfiles"))


@register("catalogue_sources", "S5 S6", """
WITH pair AS (SELECT DISTINCT lang, source FROM documents)
SELECT 'youtube-' || lang || '-' || source AS id, 'youtube' AS family, lang AS category, 'https://www.youtube.com/@' || source AS source_url, NULL AS feed_url FROM pair
UNION ALL SELECT 'google-news-' || source || '-' || lang, 'googleNews', NULL, NULL, 'https://news.google.com/rss/search?q=' || source || '+' || lang || '&hl=en-US&gl=US&ceid=US%3Aen' FROM pair
UNION ALL SELECT 'google-research-blog', 'googleResearchBlog', 'research', 'https://' || source, 'https://research.google/blog/rss/' FROM pair WHERE lang = 'en'
UNION ALL SELECT 'github-' || source, 'githubOrganizations', 'github', 'https://github.com/' || source, 'https://api.github.com/orgs/' || source || '/repos?sort=updated&per_page=12' FROM pair
UNION ALL SELECT 'twitter-' || source || '-' || lang, 'twitterFeeds', 'twitter', 'https://x.com/' || source || '_' || lang, 'https://rsshub-boost.23751.net/twitter/user/' || source || '_' || lang FROM pair""")
def _(t):
    return catalogue.expand(catalogue_rows(t), "2024-01-01").select("id", "family", "category", "source_url", "feed_url")


@register("catalogue_counts", "A4 S5", """
WITH pair AS (SELECT DISTINCT lang, source FROM documents)
SELECT 'youtube' AS family, lang AS category, count(*) AS n_sources FROM pair GROUP BY lang
UNION ALL SELECT 'googleNews', NULL, count(*) FROM pair UNION ALL SELECT 'googleResearchBlog', 'research', count(*) FROM pair WHERE lang = 'en'
UNION ALL SELECT 'githubOrganizations', 'github', count(*) FROM pair UNION ALL SELECT 'twitterFeeds', 'twitter', count(*) FROM pair""")
def _(t):
    return catalogue.category_counts(catalogue_rows(t))


@register("enabled_sources", "S7", """
WITH pair AS (SELECT DISTINCT lang, source FROM documents)
SELECT CASE lang WHEN 'en' THEN 'rss' WHEN 'fr' THEN 'web' ELSE 'youtube' END AS kind, source || '-' || lang AS id FROM pair WHERE lang <> 'es'""")
def _(t):
    lang = F.col("lang")
    entry = F.array(F.struct(F.concat("source", F.lit("-"), "lang").alias("id"), F.col("source").alias("name"), F.when(lang == "es", True).alias("disabled")))
    config = t.read("documents").select("lang", "source").distinct().select(
        F.when(lang == "en", entry).alias("rss"), F.when(lang == "fr", entry).alias("web"), F.when(lang.isin("de", "es"), entry).alias("youtube"))
    return catalogue.enabled_sources(config).select("kind", "id")


def articles(t):
    """Items as markdown articles; even items cite their link."""
    url = F.col("url")
    cites = F.when(F.col("id") % 2 == 0, F.array(F.struct(F.col("title").alias("title"), url.alias("url"), F.col("source_name").alias("source")))).otherwise(
        F.expr("cast(array() as array<struct<title: string, url: string, source: string>>)"))
    body = F.concat(F.lit("Read ["), "source_name", F.lit("]("), url, F.lit(") and ["), "kind", F.lit("](https://other.example/"), "kind", F.lit(").\n\n"), "summary")
    text = markdown.to_markdown(F.col("title"), F.substring("summary", 1, 80), F.col("day").cast("string"), F.col("tags"), cites, body)
    return t.items.select("id", F.concat(F.lit("item-"), F.col("id").cast("string")).alias("slug"), text.alias("markdown"), "summary")


@register("markdown_articles", "K6 S8", q.with_([q.ITEMS], """
SELECT id, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS n_listed, 2 AS n_body_links, trim(summary) AS tail FROM items"""))
def _(t):
    path = new_stage_path(t.spark, "articles")
    sinks.write_markdown(articles(t).select("slug", "markdown"), path)
    stored = t.spark.read.schema("slug string, markdown string").parquet(path)
    found = markdown.split_articles(stored, "markdown")
    return found.select(
        F.substring_index("slug", "-", -1).cast("bigint").alias("id"), F.size("listed_urls").cast("bigint").alias("n_listed"),
        F.size("body_urls").cast("bigint").alias("n_body_links"), F.trim(F.regexp_replace(F.regexp_replace("body", r"(?s)^.*?\n\n(?=[^\n]*$)", ""), "\n", "")).alias("tail"))


@register("unlisted_article_links", "J5 S8", q.with_([q.ITEMS], """
SELECT id, 'body URL is not listed' AS problem, 'https://other.example/' || kind AS url FROM items
UNION ALL SELECT id, 'body URL is not listed', url FROM items WHERE id % 2 = 1
UNION ALL SELECT id, 'missing citation URLs', NULL FROM items WHERE id % 2 = 1"""))
def _(t):
    return markdown.unlisted_links(markdown.split_articles(articles(t), "markdown"), "id")


@register("latest_snapshot_round_trip", "K1", q.with_([q.OK_ITEMS], "SELECT id, title, url FROM ok_items"))
def _(t):
    path = new_stage_path(t.spark, "latest")
    for rows in (t.items.filter(F.col("status") != "ok"), t.ok_items):  # the second version replaces the first
        versions.publish(rows.select("id", "title", "url"), path)
    return versions.read_version(t.spark, path)


@register("dated_archive_round_trip", "K3", """
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date, count(*) AS n, CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN 'second' ELSE 'first' END AS version FROM events GROUP BY 1, 3""")
def _(t):
    path = new_stage_path(t.spark, "archive")
    rows = t.events.select(F.to_date("ts").cast("string").alias("date"), "event_id", F.lit("first").alias("version"))
    versions.publish_days(rows, path)
    versions.publish_days(rows.filter(F.col("date") >= "2024-01-15").withColumn("version", F.lit("second")), path)
    return versions.read_version(t.spark, path).groupBy("date", "version").agg(F.count("*").alias("n"))


@register("guarded_publish", "Q15 A5 K1", q.with_([q.OK_ITEMS], """
SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS n, (SELECT count(*) FROM ok_items) AS header_items, (SELECT strftime(min(day), '%Y-%m-%d') FROM ok_items) AS header_start,
  (SELECT strftime(max(day), '%Y-%m-%d') FROM ok_items) AS header_end FROM ok_items GROUP BY ok_items.day"""))
def _(t):
    """Three deliveries of a snapshot: the second has too few items and is refused."""
    path = new_stage_path(t.spark, "guarded")
    header = {"items": F.count("*"), "start": F.min("day"), "end": F.max("day")}
    least = t.ok_items.count() // 4
    refuse = lambda found: None if found["items"] >= least else f"{found['items']} items of at least {least}"
    rows = t.ok_items.select("id", "day", "title")
    for part in (rows.filter("id % 2 = 0"), rows, rows.filter("id % 10 = 0")):
        try:
            versions.publish(part, path, header, refuse)
        except versions.Rejected:
            continue  # readers keep the version before
    found = versions.VersionLog(t.spark, path).latest()[1]["metrics"]
    stored = versions.read_version(t.spark, path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))
    return stored.select("day", "n", F.lit(int(found["items"])).cast("bigint").alias("header_items"), F.lit(found["start"]).alias("header_start"), F.lit(found["end"]).alias("header_end"))


@register("ledger_append_round_trip", "K4 S2", q.with_([q.LEDGER], """
SELECT CAST(id AS VARCHAR) AS id, seq, status FROM ledger QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1"""))
def _(t):
    path = new_stage_path(t.spark, "ledger")
    rows = t.ledger.select("seq", F.col("id").cast("string").alias("id"), "status")
    half = F.col("seq") < 500
    sinks.append_ledger(rows.filter(half), path)
    sinks.append_ledger(rows.filter(~half), path)
    return latest_by_id(sinks.read_ledger(t.spark, path, "seq bigint, id string, status string"))


@register("raw_archive_round_trip", "K7", "SELECT source AS source_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY source")
def _(t):
    path = new_stage_path(t.spark, "raw")
    sinks.write_raw(t.documents.select(F.col("source").alias("source_id"), F.col("text").alias("payload")), path)
    stored = t.spark.read.schema("payload string, source_id string").parquet(path)
    return stored.groupBy("source_id").agg(F.count("*").alias("n"), F.sum(F.length("payload")).alias("n_chars"))
