"""Join and set queries over links and items."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import sqltext as q
from newsloom.catalog.base import register
from newsloom.functions import text as tx, urls as ux
from newsloom.operators import search as se


@register("ungrounded_links", "J6 Q4", q.with_([q.PAGE_LINKS], """
SELECT page_id, url FROM page_links l WHERE regexp_matches(url, '^https?://') AND page_id IN (SELECT page_id FROM page_links WHERE pos <= 3 AND page_id % 4 <> 0)
  AND url NOT IN (SELECT url FROM page_links a WHERE a.page_id = l.page_id AND a.pos <= 3) GROUP BY ALL"""))
def _(t):
    from newsloom.operators.quality import outside_links

    allowed = t.page_links.filter((F.col("pos") <= 3) & (F.col("page_id") % 4 != 0)).select("page_id", "url")
    return outside_links(t.page_links.select("page_id", "url"), allowed, "page_id")


@register("url_linkage", "J13", q.with_([q.PAGE_LINKS], f"""
SELECT item, anchor FROM (SELECT DISTINCT page_id AS item, min(page_id) OVER (PARTITION BY key) AS anchor FROM (
  SELECT page_id, {q.canonical_key('url')} AS key FROM (
    SELECT page_id, url FROM pages UNION ALL SELECT page_id, 'https://shared.example' || href FROM page_links))) WHERE item <> anchor"""))
def _(t):
    own = t.read("pages").select("page_id", "url")
    related = t.page_links.select("page_id", F.concat(F.lit("https://shared.example"), "href").alias("url"))
    keyed = own.unionByName(related).select(F.col("page_id").alias("id"), ux.canonical_key(F.col("url")).alias("url_key"))
    return se.url_linkage(keyed)


@register("word_set_overlap", "U4", q.with_([q.ITEMS], f"""
SELECT id, len(list_intersect(list_distinct({q.words('title')}), list_distinct({q.words('summary')}))) AS shared FROM items"""))
def _(t):
    return t.items.select("id", F.size(F.array_intersect(tx.content_words(F.col("title")), tx.content_words(F.col("summary")))).cast("bigint").alias("shared"))


@register("merged_keywords", "A15", q.with_([q.OK_ITEMS], f"""
SELECT source_name, string_agg(w, '|' ORDER BY first) AS keywords FROM (
  SELECT source_name, w, min(id * 100 + pos) AS first, row_number() OVER (PARTITION BY source_name ORDER BY min(id * 100 + pos)) AS rank
  FROM (SELECT source_name, id, unnest(l) AS w, unnest(range(len(l))) AS pos FROM (SELECT *, {q.words('title')} AS l FROM ok_items)) GROUP BY source_name, w) WHERE rank <= 12 GROUP BY source_name"""))
def _(t):
    from newsloom.plans.daily_brief import merged_terms

    rows = t.ok_items.select("source_name", "id", tx.content_words(F.col("title")).alias("terms"))
    return merged_terms(rows, "source_name", "id", "terms", 12).select("source_name", F.array_join("terms", "|").alias("keywords"))
