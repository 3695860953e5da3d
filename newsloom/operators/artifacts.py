"""Records of mixed shape to graph nodes and edges.

An artifact is one VARIANT value; its kind is read from the fields it has.
Nested lists (spans, media, transcript segments, opportunities, which are
artifacts themselves) are unfolded level by level with lateral joins, so any
number of them in one artifact becomes rows, never one wide value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.functions import text as tx
from newsloom.operators.graph import merge_nodes
from newsloom.session import stage

#: Node columns and the artifact fields they come from.
NODE_FIELDS = {
    "name": "name", "title": "title", "headline": "headline", "label": "label", "text": "text", "summary": "summary", "description": "description",
    "canonical_uri": "canonicalUri", "url": "url", "uri": "uri", "source_name": "sourceName", "source": "source", "source_kind": "sourceKind", "kind": "kind",
    "published_at": "publishedAt", "observed_at": "observedAt", "valid_from": "validFrom", "valid_until": "validUntil", "event_date": "eventDate",
    "ingested_at": "ingestedAt", "supersedes": "supersedes", "source_doc_id": "sourceDocId",
}
DATES = ["published_at", "observed_at", "valid_from", "valid_until", "event_date", "ingested_at"]

# place of a part's nodes among those of its artifact: later ones win a merge
SCOPE, SPANS, IMAGES, VIDEOS, SEGMENTS, OPPORTUNITIES = range(6)

#: (path in the artifact, node type, place, edge types as (type, from the part to its owner)).
PARTS = [
    ("$.textSpans", "TextSpan", SPANS, [("derivedFrom", True), ("cites", True)]),
    ("$.media.images", "ImageAsset", IMAGES, [("hasModality", False)]),
    ("$.media.videos", "VideoAsset", VIDEOS, [("hasModality", False)]),
    ("$.transcriptSegments", "TranscriptSegment", SEGMENTS, [("derivedFrom", True), ("hasModality", False)]),
]

#: Single references and lists of references of an artifact: (path, edge type).
REFERENCES = [("$.sourceDocId", "derivedFrom"), ("$.sourceBriefId", "derivedFrom"), ("$.aggregateBriefId", "derivedFrom")]
REFERENCE_LISTS = [("$.enrichedDocIds", "derivedFrom"), ("$.evidenceIds", "cites")]


def field(path: str, of: str | Column = "artifact") -> Column:
    """A scalar field as a string; null where it is missing, null or a container."""
    return F.try_variant_get(of, path, "string")


def parse_artifacts(lines: DataFrame, json_column: str = "value", order: str = "seq") -> DataFrame:
    """(order, artifact) of JSON lines; a line that is no JSON object is an error, as in the ledgers."""
    return lines.select(order, F.parse_json(json_column).alias("artifact"))


def _present(path: str) -> Column:
    """Whether a field is there and not empty (JSON null, "" and missing count as absent)."""
    return F.coalesce(field(path) != "", F.lit(False))


def kind_of() -> Column:
    """The artifact's own type, else the kind that its fields show."""
    listed = F.try_variant_get("artifact", "$.enrichedDocIds", "array<variant>").isNotNull()
    return F.coalesce(
        field("$.type"),
        F.when(_present("$.canonicalUri"), "SourceDocument").when(_present("$.sourceDocId") & _present("$.summary"), "Brief")
        .when(_present("$.sourceBriefId"), "EnrichedDocument").when(listed, "AggregateBrief").when(_present("$.markdownPath"), "Article"),
        F.lit("Thing"))


def exploded(df: DataFrame, path: str) -> DataFrame:
    """``df`` with (pos, value) of each element of a list inside the artifact; rows without the list give none."""
    listed = df.withColumn("_list", F.try_variant_get("artifact", path, "variant"))
    parts = df.sparkSession.tvf.variant_explode(F.col("_list").outer())
    # an object at this place has keys; only a list's elements have none
    return listed.lateralJoin(parts).filter(F.col("key").isNull()).drop("_list", "key")


def unfold(records: DataFrame, order: str = "seq") -> DataFrame:
    """Every artifact, nested opportunities included: (place, id, type, artifact).

    ``place`` orders versions as they are visited: the record's order, then
    its way through nested lists. One round per nesting level.
    """
    level = records.select(
        F.struct(F.col(order).cast("long").alias("seq"), F.array().cast("array<int>").alias("way")).alias("place"),
        F.coalesce(field("$.id"), field("$['@id']")).alias("id"), kind_of().alias("type"), "artifact")
    level = stage(level.filter(F.col("artifact").isNotNull()), "artifacts")
    found = level
    while True:
        nested = exploded(level, "$.appliedOpportunities")
        own = field("$.id", "value")
        name = F.coalesce(field("$.title", "value"), F.lit(""))
        slug = F.coalesce(F.nullif(F.substring(tx.slug(name, cap=None, drop_quotes=False), 1, 64), F.lit("")), F.lit("untitled"))
        level = stage(nested.select(
            F.struct(F.col("place.seq").alias("seq"), F.concat("place.way", F.array(F.lit(OPPORTUNITIES), F.col("pos").cast("int"))).alias("way")).alias("place"),
            F.coalesce(own, F.concat(F.lit("applied-opportunity:"), F.coalesce("id", F.lit("undefined")), F.lit(":"), slug)).alias("id"),
            F.lit("AppliedOpportunity").alias("type"), F.col("value").alias("artifact"), F.col("id").alias("owner")), "artifacts")
        if level.isEmpty():
            return found
        found = found.unionByName(level, allowMissingColumns=True)


def _versions(df: DataFrame, id_: Column, type_: Column, place: Column, own: str | None, **fixed: Column) -> DataFrame:
    """Node versions whose attributes are the fields of the variant ``own``, but for ``fixed`` ones."""
    return df.select(id_.alias("id"), type_.alias("type"), place.alias("place"), *[
        fixed.get(name, field(f"$.{path}", own) if own else F.lit(None).cast("string")).alias(name) for name, path in NODE_FIELDS.items()])


def _at(part: int) -> Column:
    way = F.array(F.lit(part), F.col("pos").cast("int")) if part != SCOPE else F.array(F.lit(SCOPE))
    return F.struct(F.col("place.seq").alias("seq"), F.concat("place.way", way).alias("way"))


def artifact_nodes(artifacts: DataFrame) -> DataFrame:
    """One row per node id of unfolded artifacts: the latest non-null value of each attribute."""
    frames = [_versions(artifacts, F.col("id"), F.col("type"), F.col("place"), "artifact")]
    sources = artifacts.filter(F.col("type") == "SourceDocument")
    dates = {name: field(f"$.{NODE_FIELDS[name]}") for name in [*DATES, "supersedes"]}
    dates["valid_from"] = F.coalesce(dates["valid_from"], dates["published_at"], dates["observed_at"])
    frames.append(_versions(sources, F.concat("id", F.lit(":temporal-scope")), F.lit("TemporalScope"), _at(SCOPE), None, **dates))
    for path, type_, part, _ in PARTS:
        frames.append(_versions(exploded(sources, path), field("$.id", "value"), F.lit(type_), _at(part), "value", source_doc_id=F.col("id")))
    every = reduce(DataFrame.unionByName, frames).filter(F.coalesce("id", F.lit("")) != "")
    return merge_nodes(every, "place")


def artifact_edges(artifacts: DataFrame) -> DataFrame:
    """(type, src, dst) of unfolded artifacts, each once; edges without an end are none."""
    def edges(df: DataFrame, type_: str, src: Column, dst: Column) -> DataFrame:
        return df.select(F.lit(type_).alias("type"), src.alias("src"), dst.alias("dst"))

    sources = artifacts.filter(F.col("type") == "SourceDocument")
    frames = [edges(sources, "hasTemporalScope", F.col("id"), F.concat("id", F.lit(":temporal-scope")))]
    for path, _, _, kinds in PARTS:
        part = field("$.id", "value")
        rows = exploded(sources, path).select("id", part.alias("part"))
        frames += [edges(rows, type_, F.col("part"), F.col("id")) if out else edges(rows, type_, F.col("id"), F.col("part")) for type_, out in kinds]
    frames += [edges(artifacts, type_, F.col("id"), field(path)) for path, type_ in REFERENCES]
    for path, type_ in REFERENCE_LISTS:
        frames.append(edges(exploded(artifacts, path).withColumn("to", F.try_variant_get("value", "$", "string")), type_, F.col("id"), F.col("to")))
    if "owner" in artifacts.columns:
        frames.append(edges(artifacts.filter(F.col("owner").isNotNull()), "suggestsOpportunity", F.col("owner"), F.col("id")))
    every = reduce(DataFrame.unionByName, frames)
    return every.filter((F.coalesce("src", F.lit("")) != "") & (F.coalesce("dst", F.lit("")) != "")).distinct()


def label() -> Column:
    """First of seven fields, at most 96 characters."""
    return tx.ellipsis(F.coalesce("name", "title", "headline", "label", "text", "summary", "id"), 96)


def description() -> Column:
    return tx.ellipsis(F.coalesce("description", "summary", "text", "canonical_uri", "url", "uri", F.lit("")), 280)


def summaries(nodes: DataFrame) -> DataFrame:
    """Display row of each node: id, type, label, description and the six dates as one struct."""
    return nodes.select("id", "type", label().alias("label"), description().alias("description"), F.struct(*DATES).alias("temporal"))
