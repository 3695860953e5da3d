"""Knowledge model queries over the item view."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import sqltext as q
from newsloom.catalog.base import CORPUS_ENTITIES, register
from newsloom.functions import text as tx
from newsloom.operators import knowledge as kn

CLAIMS = f"""claims AS (
  SELECT id || ':claim-' || pos AS claim_id, pos, text, id AS evidence_id, title, source_name, url, tags
  FROM (SELECT *, unnest(s) AS text, unnest(range(1, len(s) + 1)) AS pos
        FROM (SELECT *, ({q.sentences('summary')})[1:4] AS s FROM ok_items)))"""

DOCS = f"""docs AS (
  SELECT 'source-doc:' || {q.hash_id('url', 20)} AS id, id AS summary_id, url AS canonical_uri, title, source_name,
    kind AS source_kind, day AS published_on, tags, coalesce(nullif(summary, ''), title) AS text,
    {q.hash_id("title || chr(10) || coalesce(nullif(summary, ''), title)", 32)} AS content_hash FROM ok_items)"""

KNOWLEDGE = [q.OK_ITEMS, CLAIMS, DOCS, q.NAMES]

PAIRS = """first_names AS (
  SELECT id, url, name, row_number() OVER (PARTITION BY id ORDER BY pos) AS rank
  FROM (SELECT id, url, name, min(pos) AS pos FROM names GROUP BY id, url, name)),
pairs AS (
  SELECT least(l.name, r.name) AS "left", greatest(l.name, r.name) AS "right", l.id AS evidence_id, l.url
  FROM first_names l JOIN first_names r ON l.id = r.id AND l.rank < r.rank WHERE l.rank <= 8 AND r.rank <= 8)"""


@register("entity_mentions", "T2 A1", q.with_([q.OK_ITEMS, q.NAMES], """
SELECT name, count(*) AS mentions, count(DISTINCT id) AS n_evidence, count(DISTINCT url) AS n_citations FROM names GROUP BY name"""))
def entity_mentions(t):
    return kn.entities(kn.entity_evidence(t.ok_items))


@register("entity_evidence", "J2", q.with_(KNOWLEDGE, """
SELECT name, d.id AS doc_id, count(*) AS mentions FROM names n JOIN docs d ON d.summary_id = n.id GROUP BY ALL"""))
def _(t):
    return kn.with_evidence(kn.entity_evidence(t.ok_items), kn.source_documents(t.ok_items)).select("name", "doc_id", "mentions")


@register("entity_documents", "J2", q.with_(KNOWLEDGE, """
SELECT name, count(DISTINCT d.id) AS n_documents, min(d.id) AS first_document FROM names n JOIN docs d ON d.summary_id = n.id GROUP BY name"""))
def _(t):
    # evidence rows are unique per (name, item), so a plain count suffices
    joined = kn.with_evidence(kn.entity_evidence(t.ok_items), kn.source_documents(t.ok_items))
    return joined.groupBy("name").agg(F.count("*").alias("n_documents"), F.min("doc_id").alias("first_document"))


@register("topic_rollup", "A2", q.with_([q.OK_ITEMS], """
SELECT name, count(DISTINCT id) AS n_evidence, count(DISTINCT url) AS n_citations
FROM (SELECT id, url, unnest(tags) AS name FROM ok_items) GROUP BY name"""))
def _(t):
    return kn.topics(kn.topic_evidence(t.ok_items))


@register("topic_documents", "J3", q.with_(KNOWLEDGE, """
SELECT name, count(DISTINCT d.id) AS n_documents, min(d.id) AS first_document
FROM (SELECT id, unnest(tags) AS name FROM ok_items) x JOIN docs d ON d.summary_id = x.id GROUP BY name"""))
def _(t):
    joined = kn.with_evidence(kn.topic_evidence(t.ok_items), kn.source_documents(t.ok_items))
    return joined.groupBy("name").agg(F.count("*").alias("n_documents"), F.min("doc_id").alias("first_document"))


@register("co_mentions", "A3", q.with_([q.OK_ITEMS, q.NAMES, PAIRS], """
SELECT "left", "right", count(DISTINCT evidence_id) AS n_evidence, count(DISTINCT url) AS n_citations FROM pairs GROUP BY ALL"""))
def _(t):
    return kn.co_mentions(kn.co_mention_evidence(t.ok_items))


@register("claims", "T1 W4", q.with_([q.OK_ITEMS, CLAIMS], """
SELECT claim_id, pos, text, evidence_id, title, source_name, url FROM claims"""))
def _(t):
    return kn.claims(t.ok_items).drop("tags")


@register("claim_documents", "J1", q.with_(KNOWLEDGE, f"""
SELECT 'claim:' || {q.hash_id('claim_id', 20)} AS node_id, c.text, d.id AS doc_id, strftime(d.published_on, '%Y-%m-%d') AS published_on
FROM claims c JOIN docs d ON d.summary_id = c.evidence_id"""))
def _(t):
    return kn.with_evidence(kn.claims(t.ok_items), kn.source_documents(t.ok_items)).select(
        F.concat(F.lit("claim:"), tx.stable_hash(F.col("claim_id"), 20)).alias("node_id"), "text", "doc_id",
        F.col("published_on").cast("string").alias("published_on"))


@register("knowledge_sources", "P19", q.with_([q.OK_ITEMS], """
SELECT id, title, source_name, kind, url, strftime(day, '%Y-%m-%d') AS published_on, array_to_string(tags, '|') AS tags FROM ok_items"""))
def _(t):
    return kn.knowledge_sources(t.items).select(
        "id", "title", "source_name", "kind", "url", F.col("day").cast("string").alias("published_on"), F.array_join("tags", "|").alias("tags"))


@register("source_documents", "P18", q.with_([q.OK_ITEMS, DOCS], """
SELECT id, summary_id, canonical_uri, content_hash, id || ':span-1' AS span_id, 0 AS start_offset, length(text) AS end_offset FROM docs"""))
def _(t):
    return kn.source_documents(t.ok_items).select(
        "id", "summary_id", "canonical_uri", "content_hash", "span_id", "start_offset", "end_offset")


@register("known_entity_tags", "T3", q.with_([q.ITEMS], f"""
SELECT id, array_to_string({q.known_entities("title || ' ' || summary", CORPUS_ENTITIES)}, '|') AS entities FROM items"""))
def _(t):
    text = F.concat("title", F.lit(" "), "summary")
    return t.items.select("id", F.array_join(tx.known_entities(text, CORPUS_ENTITIES), "|").alias("entities"))


@register("nested_ids", "P24", q.with_([q.OK_ITEMS], f"""
SELECT id, array_to_string(list_transform(({q.sentences('summary')})[1:4], lambda s: 'claim:' || {q.hash_id("'brief-' || id || ':' || s", 20)}), '|') AS claim_ids,
  array_to_string(list_transform(({q.entities('summary')})[1:5], lambda s: 'entity:' || {q.slug('s')}), '|') AS entity_ids,
  'applied-opportunity:' || {q.hash_id("'brief-' || id || ':' || title", 20)} AS opportunity_id
FROM ok_items"""))
def _(t):
    parent = F.concat(F.lit("brief-"), F.col("id").cast("string"))
    claim_array = F.transform(F.slice(tx.sentences(F.col("summary")), 1, 4), lambda s: F.struct(F.lit(None).cast("string").alias("id"), s.alias("text")))
    entity_array = F.transform(F.slice(tx.entity_candidates(F.col("summary")), 1, 5), lambda s: F.struct(F.lit(None).cast("string").alias("id"), s.alias("name")))
    opportunity = F.array(F.struct(F.lit(None).cast("string").alias("id"), F.col("title").alias("title")))
    claims_out, entities_out = kn.assign_ids(parent, claim_array, entity_array)
    return t.ok_items.select(
        "id", F.array_join(F.transform(claims_out, lambda c: c.id), "|").alias("claim_ids"),
        F.array_join(F.transform(entities_out, lambda e: e.id), "|").alias("entity_ids"),
        F.get(kn.opportunity_ids(parent, opportunity), F.lit(0)).getField("id").alias("opportunity_id"))


@register("relations", "P27", q.with_([q.OK_ITEMS, DOCS], f"""
SELECT 'relation:derivedFrom:' || {q.hash_id("id || ':' || summary_id || ':' || strftime(published_on, '%Y-%m-%d')", 20)} AS id,
  'derivedFrom' AS type, id AS source, summary_id AS target FROM docs"""))
def _(t):
    docs = kn.source_documents(t.ok_items)
    target, at = F.col("summary_id").cast("string"), F.col("published_on").cast("string")
    return docs.select(
        kn.relation_id("derivedFrom", F.col("id"), target, at).alias("relation_id"), F.lit("derivedFrom").alias("type"),
        F.col("id").alias("source"), F.col("summary_id").alias("target"),
    ).withColumnRenamed("relation_id", "id")


@register("artifact_types", "P23", q.with_([q.ITEMS], """
SELECT id, CASE WHEN kind = 'en' AND status = 'ok' THEN 'SourceDocument' WHEN kind = 'fr' AND summary <> '' THEN 'Brief'
  WHEN kind = 'de' THEN 'EnrichedDocument' WHEN kind = 'es' THEN 'Article' ELSE 'Thing' END AS type FROM items"""))
def _(t):
    kind = F.col("kind")
    shaped = t.items.select(
        "id", "summary", F.when((kind == "en") & (F.col("status") == "ok"), F.col("url")).alias("canonical_uri"),
        F.when(kind == "fr", F.lit("d")).alias("source_doc_id"), F.when(kind == "de", F.lit("b")).alias("source_brief_id"),
        F.when(kind == "es", F.lit("p.md")).alias("markdown_path"))
    return shaped.select("id", kn.artifact_type(shaped).alias("type"))


DRAFT = """tagged AS (SELECT *, unnest(tags) AS topic FROM ok_items),
picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY id) AS rank FROM tagged) WHERE rank <= 8)"""


@register("draft_items", "C8", q.with_([q.OK_ITEMS, DRAFT], "SELECT topic, rank, id AS item_id FROM picked"))
def _(t):
    return kn.draft_packets(t.ok_items)["items"].withColumn("rank", F.col("rank").cast("bigint"))


@register("draft_claims", "J4 C8", q.with_([q.OK_ITEMS, DRAFT, CLAIMS], """
SELECT topic, rank, claim_id, text FROM (
  SELECT topic, claim_id, text, row_number() OVER (PARTITION BY topic ORDER BY p.rank, c.pos) AS rank
  FROM picked p JOIN claims c ON c.evidence_id = p.id) WHERE rank <= 10"""))
def _(t):
    return kn.draft_packets(t.ok_items)["claims"].withColumn("rank", F.col("rank").cast("bigint"))


@register("draft_entities", "J4 C8", q.with_([q.OK_ITEMS, q.NAMES, DRAFT], """
SELECT topic, rank, name FROM (
  SELECT topic, name, row_number() OVER (PARTITION BY topic ORDER BY mentions DESC, name) AS rank FROM (
    SELECT DISTINCT p.topic, n.name, m.mentions FROM picked p JOIN names n ON n.id = p.id
    JOIN (SELECT name, count(*) AS mentions FROM names GROUP BY name) m ON m.name = n.name)) WHERE rank <= 10"""))
def _(t):
    return kn.draft_packets(t.ok_items)["entities"].withColumn("rank", F.col("rank").cast("bigint"))


@register("draft_topics", "J4 C8", q.with_([q.OK_ITEMS, DRAFT], """
SELECT topic, rank, name FROM (
  SELECT topic, name, row_number() OVER (PARTITION BY topic ORDER BY n DESC, name) AS rank FROM (
    SELECT DISTINCT p.topic, x.topic AS name, m.n FROM picked p JOIN tagged x ON x.id = p.id
    JOIN (SELECT topic, count(*) AS n FROM tagged GROUP BY topic) m ON m.topic = x.topic)) WHERE rank <= 8"""))
def _(t):
    return kn.draft_packets(t.ok_items)["topics"].withColumn("rank", F.col("rank").cast("bigint"))


@register("draft_citations", "C8 D9", q.with_([q.OK_ITEMS, DRAFT], "SELECT topic, url, min(rank) AS rank FROM picked GROUP BY topic, url"))
def _(t):
    return kn.draft_packets(t.ok_items)["citations"].withColumn("rank", F.col("rank").cast("bigint"))
