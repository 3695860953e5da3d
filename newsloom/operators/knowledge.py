"""Claims, entities, topics and co-mentions with their evidence.

Evidence stays in long form (one row per name and item): a name that occurs
in a third of all items never becomes one array.

Items carry ``id, title, summary, url, source_name, kind, tags, status``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.functions import text as tx
from newsloom.operators.rollups import with_first_use


def knowledge_sources(items: DataFrame) -> DataFrame:
    return items.filter(F.col("status") == "ok").select(
        "id", "title", "source_name", F.coalesce("kind", F.lit("unknown")).alias("kind"), "url", "day", "tags"
    )


def first_sentences(per_item: int = 4) -> Column:
    return F.slice(tx.sentences(F.col("summary")), 1, per_item)


def claims(items: DataFrame, per_item: int = 4, sentences: Column | None = None) -> DataFrame:
    """The first sentences of every item; cut before the explode."""
    picked = first_sentences(per_item) if sentences is None else sentences
    return items.select(
        "id", "title", "source_name", "url", "tags", F.posexplode(picked).alias("pos", "text")
    ).select(
        F.concat(F.col("id").cast("string"), F.lit(":claim-"), (F.col("pos") + 1).cast("string")).alias("claim_id"),
        (F.col("pos") + 1).cast("bigint").alias("pos"), "text", F.col("id").alias("evidence_id"),
        "title", "source_name", "url", "tags",
    )


def candidates(title: str = "title", summary: str = "summary") -> Column:
    return F.concat(tx.entity_candidates(F.col(title)), tx.entity_candidates(F.col(summary)))


def entity_evidence(items: DataFrame, names: Column | None = None) -> DataFrame:
    """One row per (name, item) with the number of mentions; no shuffle.
    ``names``: the candidates, where they have been found already."""
    names = candidates() if names is None else names
    named = items.select("id", "url", "title", "source_name", F.array_sort(names).alias("names"))
    # first places of each distinct name in the sorted array; a name's
    # mentions run up to the place of the next one
    uses = F.transform(with_first_use(F.col("names")), lambda s, i: F.struct(s.token.alias("name"), s.first.alias("first"), i.alias("at")))
    starts = F.filter(uses, lambda s: s.first == 1)
    spans = named.select("id", "url", "title", "source_name", F.size("names").alias("n"), starts.alias("starts"))
    later = F.concat(F.transform(F.slice("starts", 2, 2**30), lambda s: s["at"]), F.array(F.col("n")))
    mentions = F.zip_with(
        F.col("starts"), later, lambda s, end: F.struct(s["name"].alias("name"), (end - s["at"]).cast("bigint").alias("mentions"))
    )
    mentions = F.filter(mentions, lambda m: m["name"].isNotNull())
    return spans.select("id", "url", "title", "source_name", F.explode(mentions).alias("m")).select(
        F.col("m.name").alias("name"), F.col("id").alias("evidence_id"), F.col("m.mentions").alias("mentions"), "url", "title", "source_name"
    )


def entities(evidence: DataFrame) -> DataFrame:
    """Mentions, evidence items and distinct citations per name.

    Pre-aggregated per (name, url), which also splits a hot name.
    """
    per_url = evidence.groupBy("name", "url").agg(F.sum("mentions").alias("m"), F.count("*").alias("e"))
    return per_url.groupBy("name").agg(
        F.sum("m").alias("mentions"), F.sum("e").alias("n_evidence"), F.count("*").alias("n_citations")
    )


def topic_evidence(items: DataFrame) -> DataFrame:
    return items.select(
        F.explode(F.array_distinct("tags")).alias("name"), F.col("id").alias("evidence_id"), "url", "title", "source_name"
    )


def topics(evidence: DataFrame) -> DataFrame:
    per_url = evidence.groupBy("name", "url").agg(F.count("*").alias("e"))
    return per_url.groupBy("name").agg(F.sum("e").alias("n_evidence"), F.count("*").alias("n_citations"))


def co_mention_pairs(found: Column, names_per_item: int = 8) -> Column:
    """Unordered (left, right) pairs of the first distinct names of an array (at most 28)."""
    def pairs(names: Column) -> Column:
        others = lambda x, i: F.transform(F.slice(names, i + 2, names_per_item), lambda y: F.struct(F.least(x, y).alias("left"), F.greatest(x, y).alias("right")))
        return F.flatten(F.transform(names, others))

    return tx.let(F.slice(F.array_distinct(found), 1, names_per_item), pairs)


def co_mention_evidence(items: DataFrame, names_per_item: int = 8, names: Column | None = None) -> DataFrame:
    """Unordered pairs of each item's first distinct names (at most 28)."""
    found = candidates() if names is None else names
    return items.select(F.explode(co_mention_pairs(found, names_per_item)).alias("p"), F.col("id").alias("evidence_id"), "url").select(
        "p.left", "p.right", "evidence_id", "url"
    )


def co_mentions(evidence: DataFrame) -> DataFrame:
    per_url = evidence.groupBy("left", "right", "url").agg(F.count("*").alias("e"))
    return per_url.groupBy("left", "right").agg(F.sum("e").alias("n_evidence"), F.count("*").alias("n_citations"))


def document_id() -> Column:
    key = F.coalesce(tx.non_empty(F.col("url")), F.col("id").cast("string"))
    return F.concat(F.lit("source-doc:"), tx.stable_hash(key, 20))


def source_documents(items: DataFrame) -> DataFrame:
    """Stored form of an item: hashed id, content hash, one text span."""
    text = F.coalesce(tx.non_empty(F.col("summary")), F.col("title"))
    return items.select(
        document_id().alias("id"), F.col("id").alias("summary_id"), F.col("url").alias("canonical_uri"), "title", "source_name",
        F.col("kind").alias("source_kind"), F.col("day").alias("published_on"), "tags", text.alias("text"),
    ).select(
        "*",
        tx.stable_hash(F.concat("title", F.lit("\n"), "text"), 32).alias("content_hash"),
        F.concat("id", F.lit(":span-1")).alias("span_id"),
        F.lit(0).cast("bigint").alias("start_offset"), F.length("text").cast("bigint").alias("end_offset"),
    )


def with_evidence(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows joined to the stored document of their evidence; orphans go."""
    return rows.join(
        docs.select(F.col("summary_id").alias("evidence_id"), F.col("id").alias("doc_id"), "published_on"), "evidence_id"
    )


def relation_id(kind: str, from_: Column, to: Column, at: Column) -> Column:
    return F.concat(F.lit(f"relation:{kind}:"), tx.stable_hash(F.concat_ws(":", from_, to, at), 20))


def assign_ids(parent: Column, claims_array: Column, entities_array: Column) -> tuple[Column, Column]:
    """Ids inside nested claim and entity arrays, kept where present."""
    claims_out = F.transform(
        claims_array,
        lambda c: c.withField("id", F.coalesce(c.id, F.concat(F.lit("claim:"), tx.stable_hash(F.concat(parent, F.lit(":"), c.text), 20)))),
    )
    entities_out = F.transform(
        entities_array, lambda e: e.withField("id", F.coalesce(e.id, tx.node_id("entity", e["name"])))
    )
    return claims_out, entities_out


def opportunity_ids(parent: Column, opportunities: Column) -> Column:
    return F.transform(
        opportunities,
        lambda o: o.withField("id", F.coalesce(o.id, F.concat(F.lit("applied-opportunity:"), tx.stable_hash(F.concat(parent, F.lit(":"), o.title), 20)))),
    )


def artifact_type(df: DataFrame) -> Column:
    """Node type from the fields present, in fixed precedence. Fields a
    frame lacks count as absent."""
    has = lambda name: F.col(name).isNotNull() if name in df.columns else F.lit(False)
    filled = lambda name: has(name) & (F.col(name) != "") if name in df.columns else F.lit(False)
    named = F.coalesce(F.col("type"), F.lit("Thing")) if "type" in df.columns else F.lit("Thing")
    return (
        F.when(filled("canonical_uri"), "SourceDocument")
        .when(filled("source_doc_id") & filled("summary"), "Brief")
        .when(filled("source_brief_id"), "EnrichedDocument")
        .when(has("enriched_doc_ids"), "AggregateBrief")
        .when(filled("markdown_path"), "Article")
        .otherwise(named)
    )


def draft_packets(items: DataFrame, per_topic: int = 8, n_claims: int = 10, n_entities: int = 10, n_topics: int = 8) -> dict[str, DataFrame]:
    """Per topic: its first items and what has evidence among them.

    Returns long-form frames ``items, citations, claims, entities,
    topics``; every list is cut by rank inside its topic, so the ranks are
    limited before they are shuffled.
    """
    from pyspark.sql import Window

    tagged = items.withColumn("topic", F.explode(F.array_distinct("tags")))
    by_topic = Window.partitionBy("topic").orderBy("id")
    picked = tagged.withColumn("rank", F.row_number().over(by_topic)).filter(F.col("rank") <= per_topic)

    packet_claims = claims(picked.select("id", "title", "summary", "source_name", "url", "tags").distinct())
    keyed = picked.select("topic", F.col("rank").alias("item_rank"), F.col("id").alias("evidence_id"))
    by_claim = Window.partitionBy("topic").orderBy("item_rank", "pos")
    topic_claims = (
        packet_claims.join(keyed, "evidence_id")
        .withColumn("rank", F.row_number().over(by_claim)).filter(F.col("rank") <= n_claims)
        .select("topic", "rank", "claim_id", "text")
    )

    def ranked_names(evidence: DataFrame, totals: DataFrame, order: list, limit: int) -> DataFrame:
        used = evidence.join(keyed, "evidence_id").select("topic", "name").distinct()
        window = Window.partitionBy("topic").orderBy(*order)
        return used.join(totals, "name").withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= limit).select("topic", "rank", "name")

    item_entities = entity_evidence(items)
    topic_entities = ranked_names(item_entities, entities(item_entities), [F.desc("mentions"), "name"], n_entities)
    item_topics = topic_evidence(items)
    topic_topics = ranked_names(item_topics, topics(item_topics), [F.desc("n_evidence"), "name"], n_topics)
    return {
        "items": picked.select("topic", "rank", F.col("id").alias("item_id")),
        "citations": picked.groupBy("topic", "url").agg(F.min("rank").alias("rank")),
        "claims": topic_claims, "entities": topic_entities, "topics": topic_topics,
    }
