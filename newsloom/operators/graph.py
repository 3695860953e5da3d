"""Property graph: nodes, edges, merges, ranking and neighbourhoods.

Nodes are ``id, type, name, title, text, canonical_uri, source_name,
source_kind, published_at``; citations are long form (``id, pos, title,
url, source``); edges are ``type, src, dst``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from newsloom import rules
from newsloom.functions import text as tx
from newsloom.operators import knowledge as kn, skew
from newsloom.operators.ledger import first_per_key, top_per_key
from newsloom.session import new_stage_path, small, stage

NODE_COLUMNS = ["id", "type", "name", "title", "text", "canonical_uri", "source_name", "source_kind", "published_at"]


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    citations: DataFrame

    def staged(self) -> "StagedGraph":
        return StagedGraph(self)


class StagedGraph:
    """A graph whose nodes and edges are written when they are first read: a search needs no edges. Citations are not
    written: their readers want those of a few nodes, and say so by a semi join, which comes before the grouping."""

    def __init__(self, graph: Graph):
        self._graph, self.citations = graph, graph.citations

    @cached_property
    def nodes(self) -> DataFrame:
        return stage(self._graph.nodes, "nodes")

    @cached_property
    def edges(self) -> DataFrame:
        return stage(self._graph.edges, "edges")


def _nodes(df: DataFrame, type_: str, **cols: Column) -> DataFrame:
    return df.select(*[
        F.lit(type_).alias("type") if c == "type" else cols[c].alias(c) if c in cols else F.lit(None).cast("string").alias(c)
        for c in NODE_COLUMNS
    ])


def _edges(df: DataFrame, type_: str, src: Column, dst: Column) -> DataFrame:
    return df.select(F.lit(type_).alias("type"), src.alias("src"), dst.alias("dst"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def document_graph(docs: DataFrame, texts: DataFrame | None = None) -> Graph:
    """Document, text span and temporal scope nodes with their edges. ``texts``
    (span_id, text): the spans, where the documents come without their texts."""
    at = F.col("published_on").cast("string")
    scope = F.concat("id", F.lit(":temporal-scope"))
    nodes = [
        _nodes(docs, "SourceDocument", id=F.col("id"), title=F.col("title"), canonical_uri=F.col("canonical_uri"),
               source_name=F.col("source_name"), source_kind=F.col("source_kind"), published_at=at),
        _nodes(docs if texts is None else texts, "TextSpan", id=F.col("span_id"), text=F.col("text")),
        _nodes(docs, "TemporalScope", id=scope, published_at=at),
    ]
    edges = [
        _edges(docs, "derivedFrom", F.col("span_id"), F.col("id")), _edges(docs, "cites", F.col("span_id"), F.col("id")),
        _edges(docs, "hasTemporalScope", F.col("id"), scope),
    ]
    cited = docs.select("id", F.lit(1).alias("pos"), "title", F.col("canonical_uri").alias("url"), F.col("source_name").alias("source"))
    return Graph(_union(nodes), _union(edges), cited)


def page_graph(meta: DataFrame, spans: DataFrame, images: DataFrame) -> Graph:
    """Nodes and edges of parsed pages: documents, spans, media, scopes."""
    from newsloom.functions import urls as ux

    doc = lambda c: F.concat(F.lit("source-doc:"), tx.stable_hash(ux.canonical_uri(c)))
    docs = meta.select(doc(F.col("url")).alias("doc"), "page_id", "url", "title", "publisher", "published_at")
    owners = docs.select("page_id", "doc")
    spans, images = spans.join(owners, "page_id"), images.join(owners, "page_id")
    scope = F.concat("doc", F.lit(":temporal-scope"))
    nodes = [
        _nodes(docs, "SourceDocument", id=F.col("doc"), title=F.col("title"), canonical_uri=F.col("url"), source_name=F.col("publisher"), published_at=F.col("published_at")),
        _nodes(docs, "TemporalScope", id=scope, published_at=F.col("published_at")),
        _nodes(spans, "TextSpan", id=F.col("span_id"), text=F.col("text")),
        _nodes(images.select("media_id", "uri").distinct(), "ImageAsset", id=F.col("media_id"), canonical_uri=F.col("uri")),
    ]
    edges = [
        _edges(docs, "hasTemporalScope", F.col("doc"), scope),
        _edges(spans, "derivedFrom", F.col("span_id"), F.col("doc")), _edges(spans, "cites", F.col("span_id"), F.col("doc")),
        _edges(images, "hasModality", F.col("doc"), F.col("media_id")).distinct(),
    ]
    cited = spans.select(F.col("span_id").alias("id"), F.lit(1).alias("pos"), F.lit(None).cast("string").alias("title"),
                         F.col("citation_url").alias("url"), F.lit(None).cast("string").alias("source"))
    return Graph(_union(nodes), _union(edges), cited)


def parsed_items(items: DataFrame) -> DataFrame:
    """What nodes and edges read of items, texts parsed once: (id, doc, url, title, source_name, kind, at, tags, names, said)."""
    rows = items.select("id", kn.document_id().alias("doc"), "url", "title", "source_name", "kind", F.col("day").cast("string").alias("at"), "tags",
                        kn.candidates().alias("names"), kn.first_sentences().alias("said"))
    return stage(rows, "parsed-items")


def knowledge_edges(parsed: DataFrame) -> DataFrame:
    """Distinct edges of parsed items. Every end is a node of ``knowledge_graph`` by construction."""
    doc, span, scope = F.col("doc"), F.concat("doc", F.lit(":span-1")), F.concat("doc", F.lit(":temporal-scope"))
    claim = lambda i: F.concat(F.lit("claim:"), tx.stable_hash(F.concat(F.col("id").cast("string"), F.lit(":claim-"), (i + 1).cast("string")), 20))
    entity = lambda c: tx.node_id("entity", c)
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    # ends are named once per row, then all edges of a row come out of one array
    rows = parsed.select(
        doc, span.alias("span"), scope.alias("scope"), listed(F.transform(F.array_distinct("tags"), lambda t: tx.node_id("topic", t))).alias("topics"),
        listed(F.transform(F.col("said"), lambda s, i: claim(i))).alias("claims"), F.transform(F.filter("names", lambda n: n.isNotNull()), entity).alias("mentioned"),
        F.transform(kn.co_mention_pairs(F.col("names")), lambda p: F.struct(entity(p["left"]).alias("src"), entity(p["right"]).alias("dst"))).alias("pairs"))
    edge = lambda kind, src, dst: F.struct(F.lit(kind).alias("type"), src.alias("src"), dst.alias("dst"))
    claims, topics = F.col("claims"), F.col("topics")
    said = F.flatten(F.transform(claims, lambda c: F.concat(
        F.array(edge("derivedFrom", c, doc), edge("supportsClaim", doc, c)), F.transform(topics, lambda t: edge("supportsClaim", t, c)))))
    edges = F.concat(
        F.array(edge("derivedFrom", span, doc), edge("cites", span, doc), edge("hasTemporalScope", doc, scope)), said,
        F.transform(F.concat(F.array_distinct("mentioned"), topics), lambda n: edge("mentions", doc, n)),
        F.transform("pairs", lambda p: edge("coOccursWith", p["src"], p["dst"])))
    return rows.select(F.explode(edges).alias("e")).select("e.*").distinct()


def knowledge_graph(items: DataFrame) -> Graph:
    """Documents, claims, entities and topics of usable items.

    Names that share a slug share a node; the last name in mention order
    names it.
    """
    parsed = parsed_items(items)
    docs = parsed.select(F.col("doc").alias("id"), F.concat("doc", F.lit(":span-1")).alias("span_id"), F.col("url").alias("canonical_uri"), "title", "source_name",
                         F.col("kind").alias("source_kind"), F.col("at").alias("published_on"))
    base = document_graph(docs, kn.source_documents(items).select("span_id", "text"))
    claims = parsed.select("id", "title", "url", "source_name", "at", F.posexplode("said").alias("pos", "text")).withColumn(
        "node", F.concat(F.lit("claim:"), tx.stable_hash(F.concat(F.col("id").cast("string"), F.lit(":claim-"), (F.col("pos") + 1).cast("string")), 20)))
    evidence = stage(kn.entity_evidence(parsed, F.col("names")), "entity-evidence")
    names = kn.entities(evidence).withColumn("node", tx.node_id("entity", F.col("name")))
    entity_names = names.groupBy("node").agg(F.max_by("name", F.struct(-F.col("mentions"), "name")).alias("name"))
    topic_rows = kn.topic_evidence(parsed).withColumn("node", tx.node_id("topic", F.col("name")))
    topic_names = topic_rows.groupBy("node").agg(F.max("name").alias("name"))

    nodes = [
        base.nodes,
        _nodes(claims, "Claim", id=F.col("node"), text=F.col("text"), published_at=F.col("at")),
        _nodes(entity_names, "Entity", id=F.col("node"), name=F.col("name")),
        _nodes(topic_names, "Topic", id=F.col("node"), name=F.col("name")),
    ]
    cites = [
        base.citations,
        claims.select(F.col("node").alias("id"), F.lit(1).alias("pos"), "title", "url", F.col("source_name").alias("source")),
    ]
    for rows in (evidence.withColumn("node", tx.node_id("entity", F.col("name"))), topic_rows):
        # one citation per (node, url)
        cites.append(rows.groupBy(F.col("node").alias("id"), "url").agg(
            F.min("evidence_id").cast("int").alias("pos"), F.min_by("title", "evidence_id").alias("title"), F.min_by("source_name", "evidence_id").alias("source")
        ).select("id", "pos", "title", "url", "source"))
    return Graph(_union(nodes), knowledge_edges(parsed), _union(cites))


# --- merging -----------------------------------------------------------------------

def merge_nodes(versions: DataFrame, order: str) -> DataFrame:
    """Attribute-wise merge per id: the latest non-null value wins; a
    missing type becomes Thing. Null and absent are the same here."""
    attributes = [c for c in versions.columns if c not in ("id", order)]
    merged = versions.groupBy("id").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in attributes])
    return merged.withColumn("type", F.coalesce("type", F.lit("Thing"))) if "type" in attributes else merged


def merge_edges(versions: DataFrame, order: str) -> DataFrame:
    """Edges are replaced whole by their latest version."""
    extra = [c for c in versions.columns if c not in ("type", "src", "dst", order)]
    if not extra:
        return versions.select("type", "src", "dst").distinct()
    latest = versions.groupBy("type", "src", "dst").agg(F.max_by(F.struct(*extra), order).alias("_r"))
    return latest.select("type", "src", "dst", "_r.*")


def write_buckets(nodes: DataFrame, path: str, buckets: int = 256) -> None:
    """Stores a node table by hash bucket of its ids."""
    nodes.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")).write.mode("overwrite").partitionBy("bucket").parquet(path)


def merge_into_buckets(path: str, delta: DataFrame, buckets: int = 256) -> DataFrame:
    """Merges newer node versions into a stored table: only the buckets that
    the delta touches are read and replaced. Returns the stored table."""
    spark = delta.sparkSession
    delta = stage(delta.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")), "node-delta")
    hit = [r[0] for r in delta.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    old = spark.read.schema(delta.schema).parquet(path).filter(F.col("bucket").isin(hit))
    versions = old.withColumn("_v", F.lit(0)).unionByName(delta.withColumn("_v", F.lit(1)))
    # staged: the buckets replaced are the ones just read
    merged = stage(merge_nodes(versions, "_v"), "node-buckets")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return spark.read.schema(delta.schema).parquet(path).drop("bucket")


# --- structure -----------------------------------------------------------------------

def adjacency(graph: Graph, plain_rows: int | None = skew.PLAIN_ROWS) -> DataFrame:
    """Both directions of every edge whose two ends are nodes."""
    total = graph.edges.count()
    known = graph.nodes.select("id").distinct()
    solid = skew.only(graph.edges, known.withColumnRenamed("id", "src"), "src", total, plain_rows)
    solid = skew.only(solid, known.withColumnRenamed("id", "dst"), "dst", total, plain_rows)
    return solid.select(F.col("src").alias("node"), F.col("dst").alias("neighbor"), "type").unionByName(
        solid.select(F.col("dst").alias("node"), F.col("src").alias("neighbor"), "type"))


def closed_adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of distinct edges whose ends are known to be nodes: no join with the nodes."""
    ways = F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("neighbor")), F.struct(F.col("dst").alias("node"), F.col("src").alias("neighbor"))))
    return edges.select("type", ways.alias("way")).select("way.node", "way.neighbor", "type")


def bucket_of(c: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


ADJACENCY_BUCKETS = 64


def store_adjacency(adjacent: DataFrame, buckets: int = ADJACENCY_BUCKETS) -> DataFrame:
    """Adjacency as a table in the shared folder, one folder per bucket of the node, so that a search reads the buckets of its frontier alone."""
    spark = adjacent.sparkSession
    path = new_stage_path(spark, "adjacency")
    adjacent.withColumn("bucket", bucket_of("node", buckets)).repartition(buckets, "bucket").sortWithinPartitions("bucket", "node").write.partitionBy("bucket").parquet(path)
    schema = adjacent.withColumn("bucket", bucket_of("node", buckets)).schema
    return spark.read.schema(schema).parquet(path)


def dangling_edges(graph: Graph) -> DataFrame:
    ends = graph.edges.select("type", "src", "dst", F.explode(F.array("src", "dst")).alias("id"))
    return ends.join(graph.nodes.select("id"), "id", "left_anti").select("type", "src", "dst").distinct()


def degrees(adjacent: DataFrame) -> DataFrame:
    return adjacent.groupBy(F.col("node").alias("id")).agg(F.count("*").alias("degree"))


def closed_degrees(edges: DataFrame) -> DataFrame:
    """Degrees from distinct edges alone, where every end is known to be a node."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def navigable(name: Column) -> Column:
    return ~F.coalesce(F.regexp_replace(tx.topic_slug(name), "-", "").isin(rules.NON_NAVIGABLE_TOPICS), F.lit(False))


def label() -> Column:
    return tx.ellipsis(F.coalesce("name", "title", "text", "id"), 96)


def description() -> Column:
    return tx.ellipsis(F.coalesce("text", "canonical_uri", F.lit("")), 280)


def seed_scores(graph: Graph, degree: DataFrame, seed_types: list[str] | None = None) -> DataFrame:
    kind = F.col("type")
    nodes = graph.nodes.filter(kind.isin(seed_types or rules.SEED_TYPES) & ((kind != "Topic") | navigable(F.col("name"))))
    cited = graph.citations.filter(F.coalesce("url", F.lit("")) != "")
    if seed_types:  # a few kinds: theirs alone are grouped
        cited = cited.join(small(nodes.select("id")), "id", "left_semi")
    joined = nodes.join(degree, "id", "left").join(cited.select("id").distinct().withColumn("_cited", F.lit(True)), "id", "left")
    flag = lambda c, points: F.when(c, F.lit(points)).otherwise(F.lit(0))
    score = (
        F.coalesce("degree", F.lit(0)) * 4 + flag(kind == "Topic", 24) + flag(kind.isin("Entity", "Claim"), 10)
        + flag(kind.isin("EnrichedDocument", "AggregateBrief", "Article"), 8)
        + flag(F.coalesce("_cited", F.lit(False)) | F.col("canonical_uri").isNotNull(), 6)
        + flag(F.coalesce("text", F.lit("")) != "", 4) + flag(F.col("published_at").isNotNull(), 2)
    )
    return joined.select("id", "type", label().alias("label"), description().alias("description"), score.cast("bigint").alias("score"))


def top_seeds(scores: DataFrame, limit: int = 12) -> DataFrame:
    return scores.orderBy(F.desc("score"), "label", "id").limit(limit)


def neighborhoods(seeds: DataFrame, adjacent: DataFrame, max_nodes: int = 16) -> DataFrame:
    """Members of each seed's bounded breadth-first neighbourhood in visit
    order: (seed, node, place).

    One level per round for all seeds. A parent can add at most
    ``max_nodes`` members, so only that many of its unvisited neighbours,
    in id order, are looked at; the visited table has at most
    ``max_nodes`` rows per seed. Seeds that are full leave the frontier, so
    most searches end after a level or two. Tables of members are broadcast
    only while they are small. Where the adjacency is stored by bucket, a
    round reads the folders of its frontier's buckets and no others.
    """
    buckets = ADJACENCY_BUCKETS if "bucket" in adjacent.columns else None
    visited = stage(seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(1).alias("place")), "bfs")
    frontier = visited
    for _ in range(max_nodes):
        reached = adjacent
        if buckets:
            hit = [r[0] for r in frontier.select(bucket_of("node", buckets)).distinct().collect()]  # at most ``buckets`` numbers
            reached = adjacent.filter(F.col("bucket").isin(hit)).drop("bucket")
        near = reached.join(small(frontier.select("seed", "node", F.col("place").alias("parent"))), "node").select("seed", "parent", F.col("neighbor").alias("node"))
        near = near.join(small(visited.select("seed", "node")), ["seed", "node"], "left_anti").distinct()
        near = top_per_key(near, ["seed", "parent"], ["node"], max_nodes, "_r").drop("_r")
        near = first_per_key(near, ["seed", "node"], ["parent"])
        counts = visited.groupBy("seed").agg(F.max("place").alias("_used"))
        ranked = top_per_key(near, ["seed"], ["parent", "node"], max_nodes, "_r").join(counts, "seed")
        fresh = stage(
            ranked.filter(F.col("_r") + F.col("_used") <= max_nodes).select("seed", "node", (F.col("_r") + F.col("_used")).alias("place")), "bfs")
        visited = visited.unionByName(fresh)
        open_seeds = visited.groupBy("seed").agg(F.count("*").alias("_n")).filter(F.col("_n") < max_nodes).select("seed")
        frontier = stage(fresh.join(open_seeds, "seed", "left_semi"), "bfs")
        if frontier.isEmpty():
            break
    return visited


class Communities:
    """Members (seed, node, place), and, worked out when they are first read, their summary (seed, community_id, node_ids,
    edge_types, start_at, end_at) and citations (seed, rank, place, title, url, source)."""

    def __init__(self, members: DataFrame, graph: Graph, adjacent: DataFrame, max_citations: int | None = None):
        self.members, self._graph, self._adjacent, self._max_citations = members, graph, adjacent, max_citations

    @cached_property
    def summary(self) -> DataFrame:
        return community_summary(self.members, self._graph, self._adjacent)

    @cached_property
    def citations(self) -> DataFrame:
        return stage(community_citations(self.members, self._graph, self._max_citations), "community-citations")


def community_citations(members: DataFrame, graph: Graph, limit: int | None = None) -> DataFrame:
    """First citation per URL in member order, then citation order; a
    node's own address comes after its listed citations."""
    members = small(members)
    # the semi join reaches below the grouping of citations, the join does not
    listed = graph.citations.join(small(members.select(F.col("node").alias("id")).distinct()), "id", "left_semi")
    joined = listed.join(members, listed["id"] == members["node"]).select("seed", "place", "pos", "id", "title", "url", "source")
    owners = graph.nodes.join(members, graph.nodes["id"] == members["node"])
    own = owners.filter(F.col("canonical_uri").isNotNull()).select(
        "seed", "place", F.lit(2**31 - 1).alias("pos"), "id", F.coalesce("title", "name", label()).alias("title"), F.col("canonical_uri").alias("url"),
        F.coalesce("source_name", "type").alias("source"))
    every = joined.unionByName(own).filter(F.coalesce("url", F.lit("")) != "")
    best = first_per_key(every, ["seed", "url"], ["place", "pos", "url"])
    cleaned = best.withColumns({"title": tx.ellipsis(tx.reader_text(F.col("title")), 140), "source": tx.ellipsis(tx.reader_text(F.col("source")), 96)})
    ranked = top_per_key(cleaned, ["seed"], ["place", "pos", "url"], limit or 2**31 - 1)
    return ranked.select("seed", "rank", "place", "title", "url", "source")


DATE_COLUMNS = ["published_at", "observed_at", "valid_from", "valid_until", "event_date", "ingested_at"]


def temporal_range(members: DataFrame) -> DataFrame:
    """(seed, start_at, end_at): first and last of all dates that the nodes have, in those of DATE_COLUMNS that there are."""
    dates = F.array(*[F.col(c).cast("string") for c in DATE_COLUMNS if c in members.columns])
    each = members.select("seed", F.explode(dates).alias("at"))
    order = F.struct(F.col("at").try_cast("timestamp"), "at")
    return each.filter(F.coalesce("at", F.lit("")) != "").groupBy("seed").agg(F.min_by("at", order).alias("start_at"), F.max_by("at", order).alias("end_at"))


def communities(graph: Graph, adjacent: DataFrame, seeds: DataFrame, max_nodes: int = 16, max_citations: int = 10) -> Communities:
    return Communities(stage(neighborhoods(seeds, adjacent, max_nodes), "members"), graph, adjacent, max_citations)


def community_summary(members: DataFrame, graph: Graph, adjacent: DataFrame) -> DataFrame:
    reached = adjacent
    if "bucket" in adjacent.columns:
        hit = [r[0] for r in members.select(bucket_of("node", ADJACENCY_BUCKETS)).distinct().collect()]  # at most that many numbers
        reached = adjacent.filter(F.col("bucket").isin(hit)).drop("bucket")
    inner = reached.join(small(members.select("seed", F.col("node"))), "node").join(
        small(members.select("seed", F.col("node").alias("neighbor"))), ["seed", "neighbor"])
    types = inner.select("seed", "type").distinct().groupBy("seed").agg(F.array_join(F.sort_array(F.collect_set("type")), "|").alias("edge_types"))
    attributed = graph.nodes.join(small(members), graph.nodes["id"] == members["node"])
    span = temporal_range(attributed)
    ids = members.groupBy("seed").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "node"))), lambda s: s.node), "|").alias("node_ids"))
    return ids.join(types, "seed", "left").join(span, "seed", "left").withColumn(
        "community_id", F.concat(F.lit("community:"), tx.stable_hash(F.concat("seed", F.lit(":"), "node_ids"), 16)))


# --- topic packets and pages ----------------------------------------------------------

def packet_claims(comm: Communities, graph: Graph, limit: int = 8) -> DataFrame:
    """(seed, place, id, text, rank): the first claims of every community that have a text."""
    members = graph.nodes.join(small(comm.members), graph.nodes["id"] == comm.members["node"])
    claims = members.filter((F.col("type") == "Claim") & F.col("text").isNotNull()).withColumn("text", tx.reader_text(F.col("text"))).filter(F.col("text") != "")
    return top_per_key(claims.select("seed", "place", "id", "text"), ["seed"], ["place"], limit)


def packet_parts(comm: Communities, graph: Graph) -> dict[str, DataFrame]:
    """Claims, sources, entities and evidence of every community, ranked in
    member order and cut (8, 8, 10, 10).

    A claim cites its own citations, else the packet's first; a source's
    excerpt is its text spans, and cites the source.
    """
    chosen = small(comm.members)
    members = graph.nodes.join(chosen, graph.nodes["id"] == comm.members["node"])
    sources = members.filter((F.col("type") == "SourceDocument") & F.col("canonical_uri").isNotNull()).select(
        "seed", "place", "id", tx.reader_text(F.coalesce("title", label())).alias("title"), tx.reader_text(F.coalesce("source_name", F.lit("Source"))).alias("source"),
        tx.reader_text(F.coalesce("source_kind", F.lit(""))).alias("kind"), F.col("canonical_uri").alias("url"), "published_at")
    entities = members.filter((F.col("type") == "Entity") & F.col("name").isNotNull()).select("seed", "place", tx.reader_text(F.col("name")).alias("name")).filter(F.col("name") != "")
    claims = stage(packet_claims(comm, graph), "packet-claims")
    sources = stage(top_per_key(sources, ["seed"], ["place"], 8), "packet-sources")

    own = graph.citations.filter(F.coalesce("url", F.lit("")) != "").join(small(claims.select("id").distinct()), "id", "left_semi")
    own = own.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "url"))), lambda c: c.url).alias("own_urls"))
    first = comm.citations.filter(F.col("rank") == 1).select("seed", F.array("url").alias("first_url"))
    claims = claims.join(own, "id", "left").join(first, "seed", "left").withColumn("citation_urls", F.coalesce("own_urls", "first_url", F.array().cast("array<string>"))).drop("own_urls", "first_url")
    spans = graph.edges.filter(F.col("type") == "derivedFrom").join(small(sources.select(F.col("id").alias("dst")).distinct()), "dst").select(F.col("dst").alias("id"), F.col("src").alias("span"))
    texts = graph.nodes.filter((F.col("type") == "TextSpan") & (F.coalesce("text", F.lit("")) != "")).select(F.col("id").alias("span"), "text").join(small(spans), "span")
    texts = texts.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))), lambda x: x.text), " ").alias("excerpt"))
    sources = sources.join(texts, "id", "left").withColumn("excerpt", tx.reader_text(F.coalesce("excerpt", F.lit("")))).drop("id")

    evidence = claims.select("seed", F.lit(0).alias("origin"), F.col("rank").alias("at"), F.col("text").alias("excerpt"), "citation_urls").unionByName(
        sources.select("seed", F.lit(1).alias("origin"), F.col("rank").alias("at"), F.coalesce(tx.non_empty(F.col("excerpt")), "title").alias("excerpt"), F.array("url").alias("citation_urls")))
    return {
        "claims": claims, "sources": sources, "entities": top_per_key(entities, ["seed"], ["place"], 10),
        "evidence": top_per_key(evidence.filter(F.col("excerpt") != ""), ["seed"], ["origin", "at"], 10),
    }


def topic_pages(packets: DataFrame, parts: dict[str, DataFrame], comm: Communities) -> DataFrame:
    """Facts of each topic page: developments, source names, entities."""
    from newsloom.operators.dedup import developments

    joined = lambda df, col, n, name: top_per_key(df, ["seed"], ["rank"], n, "_r").groupBy("seed").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", col))), lambda s: s[col]), "|").alias(name))
    dev = developments(
        parts["claims"].select("seed", F.col("rank").alias("pos"), "text"), parts["sources"].select("seed", F.col("rank").alias("pos"), F.col("title").alias("text")), "seed")
    dev = top_per_key(dev, ["seed"], ["origin", "pos"], 5)
    names = first_per_key(comm.citations, ["seed", "source"], ["rank"])
    return (
        packets.join(joined(dev, "text", 5, "developments"), "seed", "left").join(joined(names, "source", 4, "source_names"), "seed", "left")
        .join(joined(parts["entities"], "name", 5, "entity_names"), "seed", "left")
    )


def topic_angle(kind: Column) -> Column:
    """Label of a feed kind."""
    split = F.lower(F.regexp_replace(kind, "([a-z])([A-Z])", "$1 $2"))
    low = F.lower(kind)
    return (
        F.when(F.contains(low, F.lit("github")), "open-source developer tooling").when(F.contains(low, F.lit("youtube")), "developer education and demos")
        .when(F.contains(low, F.lit("twitter")), "real-time product chatter").when(F.contains(low, F.lit("google")), "news coverage")
        .when(F.contains(low, F.lit("publication")), "technical analysis").otherwise(split)
    )


DEFAULT_ANGLE = "product releases, model work, and developer adoption"


def topic_angles(kinds: DataFrame, packet: str, order: str, limit: int = 4) -> DataFrame:
    """Distinct source-mix labels per packet, first seen first, at most
    four; packets without kinds get the default."""
    rows = kinds.select(packet, order, "kind").filter(F.coalesce("kind", F.lit("")) != "")
    labels = rows.withColumn("angle", topic_angle(F.col("kind"))).groupBy(packet, "angle").agg(F.min(order).alias(order))
    top = top_per_key(labels, [packet], [order, "angle"], limit)
    joined = top.groupBy(packet).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "angle"))), lambda s: s.angle), "|").alias("angles"))
    return kinds.select(packet).distinct().join(joined, packet, "left").withColumn("angles", F.coalesce("angles", F.lit(DEFAULT_ANGLE)))


def topic_words(c: Column) -> Column:
    words = F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: (F.length(w) > 3) & ~w.isin("topic", "brief", "current"))
    return F.array_distinct(words)


def related_topics(pages: DataFrame, citations: DataFrame, limit: int = 5) -> DataFrame:
    """(page, candidate, rank, reason): the first pages in page order that
    share a citation or a word of title and dek.

    ``pages`` has ``slug, place, title, dek``; ``citations`` has ``slug,
    rank, url, source``. A candidate among a page's first ``limit`` is
    among the first ``limit + 1`` holders of the link or word they share,
    so each key lists only those: no key pairs up all its holders.
    """
    words = pages.select("slug", "place", F.posexplode(topic_words(F.concat("title", F.lit(" "), "dek"))).alias("word_pos", "word"))
    held = words.select("slug", "place", F.concat(F.lit("w:"), "word").alias("key")).unionByName(
        citations.join(pages.select("slug", "place"), "slug").select("slug", "place", F.concat(F.lit("u:"), "url").alias("key"))).distinct()
    heads = top_per_key(held, ["key"], ["place", "slug"], limit + 1, "_r").select("key", F.col("slug").alias("candidate"), F.col("place").alias("candidate_place"))
    near = held.join(heads, "key").filter(F.col("slug") != F.col("candidate")).select("slug", "candidate", "candidate_place").distinct()
    chosen = top_per_key(near, ["slug"], ["candidate_place", "candidate"], limit)
    link = (
        chosen.join(citations.select(F.col("slug").alias("candidate"), F.col("rank").alias("at"), "url", "source"), "candidate")
        .join(citations.select("slug", "url").distinct(), ["slug", "url"], "left_semi")
        .groupBy("slug", "candidate").agg(F.min_by("source", "at").alias("cited"))
    )
    word = (
        chosen.join(words.select("slug", "word_pos", "word"), "slug").join(words.select(F.col("slug").alias("candidate"), "word"), ["candidate", "word"], "left_semi")
        .groupBy("slug", "candidate").agg(F.min_by("word", "word_pos").alias("word"))
    )
    reason = F.coalesce(F.concat(F.lit("Both topics cite "), "cited", F.lit(".")), F.concat(F.lit("Both topics discuss "), "word", F.lit(".")))
    return chosen.join(link, ["slug", "candidate"], "left").join(word, ["slug", "candidate"], "left").select("slug", "candidate", "rank", reason.alias("reason"))


def enforce_grounding(pages: DataFrame, packets: DataFrame) -> DataFrame:
    """Page citations (``slug, url``) kept only where the packet of the
    same slug cites them, with one verdict row per page."""
    have = packets.select("slug").distinct().withColumn("matched", F.lit(True))
    allowed = packets.select("slug", "url").distinct().withColumn("ok", F.lit(True))
    per_page = pages.join(allowed, ["slug", "url"], "left").groupBy("slug").agg(F.count("url").alias("n_cited"), F.count("ok").alias("n_kept"))
    verdict = F.when(F.col("matched").isNull(), "no packet").when(F.col("n_kept") == 0, "no packet citations").otherwise("ok")
    return per_page.join(have, "slug", "left").select("slug", "n_cited", "n_kept", verdict.alias("verdict"))


def overlay(stubs: DataFrame, generated: DataFrame, key: str = "slug") -> DataFrame:
    """Generated rows in place of their stubs; other stubs stay."""
    columns = [c for c in stubs.columns if c != key]
    marked = generated.select(key, *[F.col(c).alias(f"_g_{c}") for c in columns], F.lit(True).alias("_g"))
    joined = stubs.join(marked, key, "left")
    return joined.select(key, *[F.when(F.col("_g"), F.col(f"_g_{c}")).otherwise(F.col(c)).alias(c) for c in columns], F.coalesce("_g", F.lit(False)).alias("generated"))


def enrichment_budget(sources: DataFrame, per_packet: int = 2, overall: int = 12) -> DataFrame:
    """Sources to enrich: the first two of each packet until the overall
    budget is spent, in packet order."""
    ranked = top_per_key(sources, ["packet_place"], ["rank"], per_packet, "_r")
    return ranked.orderBy("packet_place", "_r").limit(overall).drop("_r")


def table_hash(df: DataFrame, buckets: int = 256) -> DataFrame:
    """One content hash of a table, independent of row order: row digests
    are summed per bucket as 64-bit limbs, then bucket digests combined, so
    no list of rows is ever gathered."""
    digest = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    limbs = [F.conv(F.substring("d", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)") for i in range(8)]
    rows = df.select(digest.alias("d")).withColumn("bucket", F.pmod(F.xxhash64("d"), F.lit(buckets)))
    per_bucket = rows.groupBy("bucket").agg(F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(limbs)])
    line = F.concat_ws(":", F.col("bucket").cast("string"), F.col("n").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(8)])
    return per_bucket.groupBy().agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "|"), 256).alias("table_hash"), F.sum("n").alias("n_rows"))
