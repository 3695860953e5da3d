"""Queries over artifacts of mixed shape, made from the items as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newsloom.catalog import sqltext as q
from newsloom.catalog.base import register
from newsloom.catalog.graph import recursive
from newsloom.operators import artifacts as ar, graph as gr
from newsloom.session import stage


def _id(kind: str, id_: Column | None = None) -> Column:
    return F.concat(F.lit(kind + ":"), (F.col("id") if id_ is None else id_).cast("string"))


def _every(n: int, value: Column) -> Column:
    """``value`` for ids divisible by ``n``, else absent."""
    return F.when(F.col("id") % n == 0, value)


def _day(add: int) -> Column:
    return F.date_format(F.date_add("day", add), "yyyy-MM-dd")


def artifact_lines(t):
    """JSON lines of seven shapes: (seq, value). Every item gives a document; briefs, enriched documents,
    aggregates and articles follow from ever fewer of them, and some documents are updated later."""
    rows = t.ok_items.select("id", "title", "url", "source_name", "kind", "day", F.substring("summary", 1, 200).alias("start"))
    part = lambda **cols: F.struct(*[c.alias(n) for n, c in cols.items()])
    shapes = [
        (1, None, dict(id=_id("doc"), canonicalUri=F.col("url"), title=F.col("title"), sourceName=F.col("source_name"), sourceKind=F.col("kind"), publishedAt=_day(0),
                       observedAt=_every(3, _day(1)),
                       textSpans=F.when(F.col("id") % 2 == 0, F.array(part(id=_id("span-a"), text=F.col("title")), part(id=_id("span-b"), text=F.col("start")))).otherwise(
                           F.array(part(id=_id("span-a"), text=F.col("title")))),
                       media=part(images=_every(4, F.array(part(id=_id("image"), uri=F.concat("url", F.lit("/i.png"))))),
                                  videos=_every(5, F.array(part(id=_id("video"), url=F.concat("url", F.lit("/v.mp4")))))),
                       transcriptSegments=_every(6, F.array(part(id=_id("segment"), text=F.col("start")))))),
        (2, 2, dict(id=_id("brief"), sourceDocId=_id("doc"), summary=F.col("title"), eventDate=_every(3, _day(-2)), validUntil=_every(4, _day(9)))),
        (3, 4, dict(id=_id("enriched"), sourceBriefId=_id("brief"), headline=F.col("title"), evidenceIds=F.array(_id("span-a"), _id("span-b")), ingestedAt=_day(3),
                    appliedOpportunities=F.array(
                        part(title=F.concat(F.lit("Use "), F.col("source_name")), id=F.lit(None).cast("string"), evidenceIds=F.array(_id("span-a")),
                             appliedOpportunities=F.array(part(id=_id("deep"), label=F.lit("Deeper use")))),
                        part(title=F.lit("Second use"), id=_id("use"), evidenceIds=F.array().cast("array<string>"),
                             appliedOpportunities=F.array().cast("array<struct<id:string,label:string>>"))))),
        (4, 8, dict(id=_id("aggregate"), enrichedDocIds=F.array(_id("enriched"), _id("enriched", F.col("id") + 4)))),
        (5, 8, dict(id=_id("article"), markdownPath=F.concat(F.lit("articles/"), F.col("id").cast("string"), F.lit(".md")), aggregateBriefId=_id("aggregate"), description=F.col("start"))),
        (6, 10, dict(id=_id("doc"), type=F.lit("SourceDocument"), title=F.concat(F.lit("Updated "), "title"), ingestedAt=_day(5))),
        (7, 40, dict(title=F.lit("No id"), evidenceIds=F.array(_id("span-a")))),
    ]
    out = None
    for place, every, cols in shapes:
        lines = (rows if every is None else rows.filter(F.col("id") % every == 0)).select(
            (F.col("id") * 10 + place).alias("seq"), F.to_json(part(**cols)).alias("value"))
        out = lines if out is None else out.union(lines)
    return out


def artifacts_of(t):
    if not hasattr(t, "_artifacts"):
        t._artifacts = ar.unfold(ar.parse_artifacts(artifact_lines(t)))
    return t._artifacts


def artifact_graph_of(t):
    if not hasattr(t, "_artifact_graph"):
        nodes, edges = stage(ar.artifact_nodes(artifacts_of(t)), "artifact-nodes"), stage(ar.artifact_edges(artifacts_of(t)), "artifact-edges")
        t._artifact_graph = gr.Graph(nodes, edges, nodes.select("id", F.lit(1).alias("pos"), "title", "url", "source").limit(0))
    return t._artifact_graph


START = "substring(summary, 1, 200)"
ENRICHED = "(SELECT * FROM ok_items WHERE id % 4 = 0)"
USE = f"'applied-opportunity:enriched:' || id || ':' || coalesce(nullif(substring({q.slug(chr(39) + 'Use ' + chr(39) + ' || source_name', None, False)}, 1, 64), ''), 'untitled')"

EDGES = f"""edges AS (SELECT DISTINCT type, src, dst FROM (
  SELECT 'hasTemporalScope' AS type, 'doc:' || id AS src, 'doc:' || id || ':temporal-scope' AS dst FROM ok_items
  UNION ALL SELECT unnest(['derivedFrom', 'cites']), 'span-a:' || id, 'doc:' || id FROM ok_items
  UNION ALL SELECT unnest(['derivedFrom', 'cites']), 'span-b:' || id, 'doc:' || id FROM ok_items WHERE id % 2 = 0
  UNION ALL SELECT 'hasModality', 'doc:' || id, 'image:' || id FROM ok_items WHERE id % 4 = 0
  UNION ALL SELECT 'hasModality', 'doc:' || id, 'video:' || id FROM ok_items WHERE id % 5 = 0
  UNION ALL SELECT 'hasModality', 'doc:' || id, 'segment:' || id FROM ok_items WHERE id % 6 = 0
  UNION ALL SELECT 'derivedFrom', 'segment:' || id, 'doc:' || id FROM ok_items WHERE id % 6 = 0
  UNION ALL SELECT 'derivedFrom', 'brief:' || id, 'doc:' || id FROM ok_items WHERE id % 2 = 0
  UNION ALL SELECT 'derivedFrom', 'enriched:' || id, 'brief:' || id FROM {ENRICHED}
  UNION ALL SELECT 'cites', 'enriched:' || id, unnest(['span-a:' || id, 'span-b:' || id]) FROM {ENRICHED}
  UNION ALL SELECT 'suggestsOpportunity', 'enriched:' || id, unnest([{USE}, 'use:' || id]) FROM {ENRICHED}
  UNION ALL SELECT 'cites', {USE}, 'span-a:' || id FROM {ENRICHED}
  UNION ALL SELECT 'suggestsOpportunity', {USE}, 'deep:' || id FROM {ENRICHED}
  UNION ALL SELECT 'derivedFrom', 'aggregate:' || id, unnest(['enriched:' || id, 'enriched:' || (id + 4)]) FROM ok_items WHERE id % 8 = 0
  UNION ALL SELECT 'derivedFrom', 'article:' || id, 'aggregate:' || id FROM ok_items WHERE id % 8 = 0))"""


def _date(add: int, when: str | None = None) -> str:
    day = f"strftime(day + {add}, '%Y-%m-%d')"
    return f"CASE WHEN {when} THEN {day} END" if when else day


def _node(id_: str, type_: str, where: str = "true", **cols: str) -> str:
    names = ["label", "description", *ar.DATES]
    return f"SELECT {id_} AS id, '{type_}' AS type, " + ", ".join(f"{cols.get(n, 'NULL')} AS {n}" for n in names) + f" FROM ok_items WHERE {where}"


DOC_TITLE = "CASE WHEN id % 10 = 0 THEN 'Updated ' || title ELSE title END"
DOC_DATES = dict(published_at=_date(0), observed_at=_date(1, "id % 3 = 0"), ingested_at=_date(5, "id % 10 = 0"))
NODES = "nodes AS (\n  " + "\n  UNION ALL ".join([
    _node("'doc:' || id", "SourceDocument", label=q.ellipsis(DOC_TITLE, 96), description=q.ellipsis("url", 280), **DOC_DATES),
    _node("'doc:' || id || ':temporal-scope'", "TemporalScope", label=q.ellipsis("'doc:' || id || ':temporal-scope'", 96), description="''", valid_from=_date(0), **DOC_DATES),
    _node("'span-a:' || id", "TextSpan", label=q.ellipsis("title", 96), description=q.ellipsis("title", 280)),
    _node("'span-b:' || id", "TextSpan", "id % 2 = 0", label=q.ellipsis(START, 96), description=q.ellipsis(START, 280)),
    _node("'image:' || id", "ImageAsset", "id % 4 = 0", label="'image:' || id", description=q.ellipsis("url || '/i.png'", 280)),
    _node("'video:' || id", "VideoAsset", "id % 5 = 0", label="'video:' || id", description=q.ellipsis("url || '/v.mp4'", 280)),
    _node("'segment:' || id", "TranscriptSegment", "id % 6 = 0", label=q.ellipsis(START, 96), description=q.ellipsis(START, 280)),
    _node("'brief:' || id", "Brief", "id % 2 = 0", label=q.ellipsis("title", 96), description=q.ellipsis("title", 280), event_date=_date(-2, "id % 3 = 0"), valid_until=_date(9, "id % 4 = 0")),
    _node("'enriched:' || id", "EnrichedDocument", "id % 4 = 0", label=q.ellipsis("title", 96), description="''", ingested_at=_date(3)),
    _node(USE, "AppliedOpportunity", "id % 4 = 0", label=q.ellipsis("'Use ' || source_name", 96), description="''"),
    _node("'use:' || id", "AppliedOpportunity", "id % 4 = 0", label="'Second use'", description="''"),
    _node("'deep:' || id", "AppliedOpportunity", "id % 4 = 0", label="'Deeper use'", description="''"),
    _node("'aggregate:' || id", "AggregateBrief", "id % 8 = 0", label="'aggregate:' || id", description="''"),
    _node("'article:' || id", "Article", "id % 8 = 0", label="'article:' || id", description=q.ellipsis(START, 280)),
]) + ")"
GRAPH = [q.OK_ITEMS, EDGES, NODES]


@register("artifact_edges", "G1", q.with_([q.OK_ITEMS, EDGES], "SELECT type, src, dst FROM edges"))
def _(t):
    return ar.artifact_edges(artifacts_of(t))


@register("artifact_summaries", "G1 P22 U3", q.with_([q.OK_ITEMS, NODES], f"SELECT id, type, label, description, {', '.join(ar.DATES)} FROM nodes"))
def _(t):
    return ar.summaries(ar.artifact_nodes(artifacts_of(t))).select("id", "type", "label", "description", "temporal.*")


# breadth-first from the aggregates with the smallest ids, one queue step per recursion
WALK = """seeds AS MATERIALIZED (SELECT 'aggregate:' || id AS id FROM ok_items WHERE id % 8 = 0 ORDER BY 1 LIMIT 24),
adj AS MATERIALIZED (SELECT src AS node, dst AS neighbor FROM edges UNION ALL SELECT dst, src FROM edges),
near AS MATERIALIZED (SELECT node, list(DISTINCT neighbor ORDER BY neighbor)[1:40] AS around FROM adj
  WHERE node IN (SELECT id FROM nodes) AND neighbor IN (SELECT id FROM nodes) GROUP BY node),
walk AS (SELECT id AS seed, 1 AS head, [id] AS seen FROM seeds
  UNION ALL SELECT w.seed, w.head + 1, (list_concat(w.seen, list_filter(coalesce(n.around, CAST([] AS VARCHAR[])), lambda x: NOT list_contains(w.seen, x))))[1:16]
  FROM walk w LEFT JOIN near n ON n.node = w.seen[w.head] WHERE w.head <= len(w.seen) AND len(w.seen) < 16),
final AS (SELECT seed, arg_max(seen, head) AS seen FROM walk GROUP BY seed),
dated AS (SELECT seed, unnest([published_at, observed_at, valid_from, valid_until, event_date, ingested_at]) AS moment
  FROM (SELECT seed, unnest(seen) AS node FROM final) JOIN nodes ON nodes.id = node)"""


@register("artifact_communities", "A11 A12 G5 J11", recursive([*GRAPH, WALK], """
SELECT seed, array_to_string(seen, '|') AS node_ids,
  (SELECT string_agg(DISTINCT e.type, '|' ORDER BY e.type) FROM edges e WHERE list_contains(seen, e.src) AND list_contains(seen, e.dst)) AS edge_types,
  (SELECT min(moment) FROM dated d WHERE d.seed = final.seed) AS start_at, (SELECT max(moment) FROM dated d WHERE d.seed = final.seed) AS end_at FROM final"""))
def _(t):
    graph = artifact_graph_of(t)
    seeds = graph.nodes.filter(F.col("type") == "AggregateBrief").orderBy("id").limit(24).select("id")
    return gr.communities(graph, stage(gr.adjacency(graph), "artifact-adjacency"), stage(seeds, "seeds")).summary.select("seed", "node_ids", "edge_types", "start_at", "end_at")


@register("artifact_counts", "A6 G1", q.with_(GRAPH, """
SELECT 'node' AS kind, type, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type"""))
def _(t):
    graph = artifact_graph_of(t)
    count = lambda df, kind: df.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "type", "n")
    return count(graph.nodes, "node").unionByName(count(graph.edges, "edge"))
