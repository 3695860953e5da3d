"""Jobs that surface the scalar expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import sqltext as q
from newsloom.catalog.base import CORPUS_TERMS, register
from newsloom.functions import dates as dx, text as tx, urls as ux
from newsloom.operators import recovery, rollups

big = lambda c: c.cast("bigint")


@register("slug_groups", "X1", q.with_([q.ITEMS], f"""
SELECT slug, count(*) AS n_items, count(DISTINCT title) AS n_titles
FROM (SELECT {q.slug('title')} AS slug, title FROM items) GROUP BY slug"""))
def _(t):
    return rollups.slug_groups(t.items, "title")


@register("part_slugs", "X1 X15", f"""
SELECT DISTINCT p_name AS name, {q.slug('p_name', None, False)} AS slug,
  {q.slug('p_name', 80, False, 'topic')} AS topic_slug,
  {q.slug('p_name', 64, False, 'untitled')} AS short_slug,
  array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title_cased,
  array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS topic_title
FROM part""")
def _(t):
    name = F.col("p_name")
    return t.read("part").select("p_name").distinct().select(
        name.alias("name"), tx.slug(name, None, False).alias("slug"), tx.topic_slug(name).alias("topic_slug"),
        tx.slug(name, 64, False, "untitled").alias("short_slug"),
        tx.title_case(name).alias("title_cased"), tx.topic_title(name).alias("topic_title"),
    )


@register("document_summaries", "X2", f"""
SELECT doc_id, {q.summarize('text', 3)} AS summary FROM documents""")
def _(t):
    return t.documents.select("doc_id", tx.summarize(F.col("text"), 3).alias("summary"))


@register("page_text", "X3 X24", f"""
SELECT page_id, {q.strip_html('html')} AS text,
  replace(replace(replace({q.strip_html('html')}, '&amp;', '&'), '&quot;', '"'), '&#39;', '''') AS decoded
FROM pages""")
def _(t):
    body = tx.strip_html(F.col("html"))
    return t.pages.select("page_id", body.alias("text"), tx.decode_basic_entities(body).alias("decoded"))


@register("sentences", "X4", f"""
SELECT doc_id, unnest(s) AS sentence, unnest(range(1, len(s) + 1)) AS pos
FROM (SELECT doc_id, {q.sentences('text')} AS s FROM documents)""")
def _(t):
    return t.documents.select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence")).select(
        "doc_id", "sentence", big(F.col("pos") + 1).alias("pos"))


@register("page_identifiers", "X5 X8", f"""
SELECT page_id, canonical, 'source-doc:' || {q.hash_id('canonical', 16)} AS doc_key,
  {q.hash_id('url', 20)} AS url_hash, {q.hash_id('html', 32)} AS body_hash
FROM (SELECT *, {q.canonical_uri('url')} AS canonical FROM pages)""")
def _(t):
    return t.pages.select(
        "page_id", "url", "html", ux.canonical_uri(F.col("url")).alias("canonical")
    ).select(
        "page_id", "canonical",
        F.concat(F.lit("source-doc:"), tx.stable_hash(F.col("canonical"))).alias("doc_key"),
        tx.stable_hash(F.col("url"), 20).alias("url_hash"), tx.stable_hash(F.col("html"), 32).alias("body_hash"),
    )


@register("duplicate_url_groups", "X6", f"""
SELECT url_key, count(*) AS n_pages, min(page_id) AS first_page
FROM (SELECT page_id, {q.canonical_key('url')} AS url_key FROM pages) GROUP BY url_key""")
def _(t):
    return t.pages.select("page_id", ux.canonical_key(F.col("url")).alias("url_key")).groupBy("url_key").agg(
        F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"))


@register("link_key_groups", "X6", q.with_([q.PAGE_LINKS], f"""
SELECT url_key, count(*) AS n_links, count(DISTINCT page_id) AS n_pages
FROM (SELECT page_id, {q.canonical_key('url')} AS url_key FROM page_links) GROUP BY url_key"""))
def _(t):
    return t.page_links.select("page_id", ux.canonical_key(F.col("url")).alias("url_key")).groupBy("url_key").agg(
        F.count("*").alias("n_links"), F.count_distinct("page_id").alias("n_pages"))


@register("url_classes", "X7", rf"""
SELECT host, source_type, is_post, is_video, count(*) AS n_pages FROM (
  SELECT {q.bare_host('url')} AS host,
    CASE WHEN regexp_matches({q.hostname('url')}, 'youtube\.com|youtu\.be') THEN 'youtube'
         WHEN regexp_matches({q.hostname('url')}, 'x\.com|twitter\.com') THEN 'x'
         WHEN regexp_matches({q.path('url')}, '(?i)rss|feed|xml') THEN 'rss' ELSE 'web' END AS source_type,
    {q.hostname('url')} IN ('x.com', 'www.x.com', 'twitter.com', 'www.twitter.com') AS is_post,
    regexp_matches({q.path('url')}, '(?i)\.(mp4|webm|mov)$') AS is_video
  FROM pages) GROUP BY ALL""")
def _(t):
    url = F.col("url")
    return t.pages.select(
        ux.host_label(url).alias("host"), ux.source_type(url).alias("source_type"),
        ux.is_post_url(url).alias("is_post"), ux.is_video_url(url).alias("is_video"),
    ).groupBy("host", "source_type", "is_post", "is_video").agg(F.count("*").alias("n_pages"))


@register("trimmed_texts", "X9", f"""
SELECT doc_id, {q.ellipsis('text', 92)} AS title, {q.ellipsis('text', 280)} AS description FROM documents""")
def _(t):
    return t.documents.select("doc_id", tx.ellipsis(F.col("text"), 92).alias("title"),
                              tx.ellipsis(F.col("text"), 280).alias("description"))


@register("word_frequencies", "X10", f"""
SELECT word, count(*) AS n_uses, count(DISTINCT doc_id) AS n_documents
FROM (SELECT doc_id, unnest({q.words('text')}) AS word FROM documents) GROUP BY word""")
def _(t):
    return rollups.document_frequency(t.documents, "doc_id", tx.content_words(F.col("text")), "word")


@register("search_token_frequencies", "X11", f"""
SELECT token, count(*) AS n_uses, count(DISTINCT doc_id) AS n_documents
FROM (SELECT doc_id, unnest({q.search_tokens('text')}) AS token FROM documents) GROUP BY token""")
def _(t):
    return rollups.document_frequency(t.documents, "doc_id", tx.search_tokens(F.col("text")), "token")


@register("keyword_frequencies", "X11", f"""
SELECT keyword, count(*) AS n_uses, count(DISTINCT doc_id) AS n_documents
FROM (SELECT doc_id, unnest({q.keywords('text')}) AS keyword FROM documents) GROUP BY keyword""")
def _(t):
    return rollups.document_frequency(t.documents, "doc_id", tx.relevance_keywords(F.col("text")), "keyword")


@register("exact_copy_groups", "X12", f"""
SELECT kind, key, count(*) AS n_documents, min(doc_id) AS first_document FROM (
  SELECT doc_id, 'fingerprint' AS kind, {q.alnum_key('text', 180)} AS key FROM documents
  UNION ALL SELECT doc_id, 'block', {q.block_key('text')} FROM documents
  UNION ALL SELECT doc_id, 'content', {q.content_key('text')} FROM documents)
WHERE key <> '' GROUP BY kind, key HAVING count(*) > 1""")
def _(t):
    return rollups.copy_groups(t.documents, "doc_id", "text")


NOISY = "'The post ' || title || ' appeared first on ' || source_name || '. ' || summary"
SOCIAL = "'RT ' || title || ' https://t.example/' || id"


@register("boilerplate_removal", "X13", q.with_([q.ITEMS], f"""
SELECT id, {q.strip_noise('noisy')} AS text, length(noisy) - length({q.strip_noise('noisy')}) AS removed,
  {q.headline("title || ' - ' || source_name")} AS headline,
  {q.collapse("regexp_replace(regexp_replace(" + q.strip_noise(SOCIAL) + ", '^rt\\s+', '', 'i'), '\\s*https?://\\S+', '', 'gi')")} AS social_title
FROM (SELECT *, {NOISY} AS noisy FROM items)"""))
def _(t):
    noisy = F.concat(F.lit("The post "), "title", F.lit(" appeared first on "), "source_name", F.lit(". "), "summary")
    social = F.concat(F.lit("RT "), "title", F.lit(" https://t.example/"), F.col("id").cast("string"))
    clean = tx.strip_noise(F.col("noisy"))
    return t.items.withColumn("noisy", noisy).select(
        "id", clean.alias("text"), big(F.length("noisy") - F.length(clean)).alias("removed"),
        tx.source_headline(F.concat("title", F.lit(" - "), "source_name")).alias("headline"),
        tx.clean_title(social).alias("social_title"),
    )


@register("reader_text", "X14", q.with_([q.ITEMS], r"""
SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  'topic:' || source_name || ' graph node GitHub ' || url || ' ' || summary,
  'https?://\S+', ' ', 'gi'), '\b(?:claim|topic|community|source-doc):[a-z0-9_.:-]+', ' ', 'gi'),
  '\bgraph\b', 'source corpus', 'gi'), '\bnode\b', 'source', 'gi'),
  '([a-z])([A-Z])', '\1 \2', 'g'), '\.([A-Z])', '. \1', 'g'), '\bGit Hub\b', 'GitHub', 'g'), '\s+', ' ', 'g')) AS text
FROM items"""))
def _(t):
    raw = F.concat(F.lit("topic:"), "source_name", F.lit(" graph node GitHub "), "url", F.lit(" "), "summary")
    return t.items.select("id", tx.reader_text(raw).alias("text"))


@register("json_recovery", "X16", r"""
WITH raw AS (SELECT event_id, CASE event_type
    WHEN 'view' THEN props WHEN 'click' THEN 'Answer:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```'
    WHEN 'purchase' THEN 'The result is ' || props || ' as asked.' WHEN 'signup' THEN '{"k": ' ELSE 'none' END AS raw FROM events),
parsed AS (SELECT event_id, CASE WHEN json_valid(trim(raw)) THEN trim(raw)
    WHEN regexp_matches(raw, '```') THEN trim(regexp_extract(raw, '```(?:json)?\s*(.*?)\s*```', 1, 's'))
    WHEN regexp_matches(raw, '\{.*\}', 's') THEN regexp_extract(raw, '\{.*\}', 0, 's') END AS body,
    CASE WHEN json_valid(trim(raw)) THEN 'whole' WHEN regexp_matches(raw, '```') THEN 'fenced'
    WHEN regexp_matches(raw, '\{.*\}', 's') THEN 'braces' ELSE 'rejected' END AS form FROM raw)
SELECT event_id, form, CAST(json_extract(body, '$.k') AS BIGINT) AS k FROM parsed""")
def _(t):
    props, kind = F.col("props"), F.col("event_type")
    raw = (
        F.when(kind == "view", props)
        .when(kind == "click", F.concat(F.lit("Answer:\n```json\n"), props, F.lit("\n```")))
        .when(kind == "purchase", F.concat(F.lit("The result is "), props, F.lit(" as asked.")))
        .when(kind == "signup", F.lit('{"k": ')).otherwise(F.lit("none"))
    )
    return recovery.recover_json(t.events.select("event_id", raw.alias("raw")), "raw", "struct<k: bigint>").select(
        "event_id", "form", F.col("payload.k").alias("k"))


@register("term_statistics", "X17", f"""
SELECT doc_id, {q.word_count('text')} AS n_words, {q.term_hits('text', CORPUS_TERMS + ['of the'])} AS n_term_hits FROM documents""")
def _(t):
    return t.documents.select("doc_id", tx.word_count(F.col("text")).alias("n_words"),
                              tx.term_hits(F.col("text"), CORPUS_TERMS + ["of the"]).alias("n_term_hits"))


@register("lenient_dates", "X18", """
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE strftime(CASE event_type
   WHEN 'view' THEN date_trunc('second', ts) WHEN 'click' THEN date_trunc('second', ts)
   ELSE CAST(CAST(ts AS DATE) AS TIMESTAMP) END, '%Y-%m-%dT%H:%M:%S.000Z') END AS parsed FROM events""")
def _(t):
    ts, kind = F.col("ts"), F.col("event_type")
    raw = (
        F.when(kind == "view", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == "click", F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
        .when(kind == "purchase", F.date_format(ts, "MMM d, yyyy"))
        .when(kind == "signup", F.date_format(ts, "yyyy-MM-dd")).otherwise(F.lit("soon"))
    )
    return t.events.select("event_id", dx.iso(dx.parse_lenient(raw)).alias("parsed"))


@register("window_starts", "X20", """
SELECT DISTINCT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS window_end, strftime(CAST(ts AS DATE) - 7, '%Y-%m-%d') AS window_start FROM events""")
def _(t):
    day = F.to_date("ts")
    return t.events.select(day.cast("string").alias("window_end"), F.date_sub(day, 7).cast("string").alias("window_start")).distinct()


@register("link_validity", "X21", q.with_([q.PAGE_LINKS], f"""
SELECT page_id, count(*) AS n_links, count(*) FILTER (WHERE NOT ({q.is_url('href')} AND {q.scheme('href')} IN ('http', 'https'))) AS n_relative,
  count(*) FILTER (WHERE NOT ({q.is_url('url')} AND {q.scheme('url')} IN ('http', 'https'))) AS n_bad,
  bool_and(target = url) AS round_trips
FROM (SELECT *, regexp_extract('[' || href || '](' || url || ')', '\\]\\(([^)]+)\\)', 1) AS target FROM page_links) GROUP BY page_id"""))
def _(t):
    markdown = F.concat(F.lit("["), "href", F.lit("]("), "url", F.lit(")"))
    return t.page_links.select(
        "page_id", ux.is_http_url(F.col("href")).alias("absolute"), ux.is_http_url(F.col("url")).alias("good"),
        (F.get(ux.markdown_targets(markdown), F.lit(0)) == F.col("url")).alias("same"),
    ).groupBy("page_id").agg(
        F.count("*").alias("n_links"), F.count_if(~F.col("absolute")).alias("n_relative"),
        F.count_if(~F.col("good")).alias("n_bad"), F.every("same").alias("round_trips"))


@register("mirror_links", "X22 X23", rf"""
SELECT page_id, CASE WHEN contains({q.hostname('url')}, 'spam-farm') THEN {q.scheme('url')} || '://x.com' || {q.path('url')}
    || regexp_replace(url, '^[^?#]*', '') ELSE url END AS link,
  'https://x.com/' || {q.bare_host('url')} AS profile,
  substring({q.hash_id('url', 20)}, 1, 11) AS video_id
FROM pages""")
def _(t):
    url = F.col("url")
    watch = F.concat(F.lit("https://www.youtube.com/watch?v="), tx.stable_hash(url, 11), F.lit("&t=3"))
    return t.pages.select(
        "page_id", ux.profile_link(url, F.lit("x"), mirror="spam-farm").alias("link"),
        ux.profile_link(F.lit(""), ux.handle_name(F.concat(F.lit("@"), ux.bare_host(url)))).alias("profile"),
        ux.video_id_from_input(watch).alias("video_id"),
    )
