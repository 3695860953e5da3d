"""Feed snapshots in their three JSON shapes, exploded to items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom import rules, schemas


def read_snapshots(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Snapshot rows tagged with the family named by their folder or file."""
    found = spark.read.schema(schemas.SNAPSHOT).option("multiLine", multi_line).json(path)
    if "family" in found.columns:  # partition folder family=...
        return found
    return found.select("*", F.regexp_extract("_metadata.file_name", r"^(.+?)(?:\.jsonl?)?$", 1).alias("family"))


def snapshot_sources(snapshots: DataFrame) -> DataFrame:
    """One row per source: the source list, else the single source, plus
    the separate research source where a snapshot has one."""
    base = F.coalesce("sources", F.when(F.col("source").isNotNull(), F.array("source")), F.expr("slice(array(source), 1, 0)"))
    extra = F.filter(F.array("aiResearch"), lambda s: s.isNotNull())
    return snapshots.select(
        "family", "generatedAt", F.posexplode(F.concat(base, extra)).alias("source_pos", "src")
    ).select("family", "generatedAt", F.col("source_pos").cast("bigint").alias("source_pos"), "src.*")


def snapshot_items(sources: DataFrame, families: list[tuple[str, str]] = rules.FEED_FAMILIES) -> DataFrame:
    """Items of the usable sources with the columns the ledger needs."""
    rank = F.create_map(*[F.lit(x) for i, (key, _) in enumerate(families) for x in (key, i)])
    label = F.create_map(*[F.lit(x) for key, name in families for x in (key, name)])
    ok = sources.filter(F.coalesce(F.nullif("status", F.lit("")), F.lit("ok")) == "ok")
    return ok.select(
        "family", "source_pos", F.col("id").alias("source_id"), "category", "topic",
        F.coalesce("title", "topic", "handle", F.element_at(label, F.col("family"))).alias("source_name"),
        F.element_at(rank, F.col("family")).alias("family_rank"), F.posexplode("items").alias("item_pos", "item"),
    ).select(
        "family", "family_rank", "source_pos", F.col("item_pos").cast("bigint").alias("item_pos"),
        "source_id", "source_name", "category", "topic",
        F.col("item.id").alias("id"), F.col("item.title").alias("title"),
        F.coalesce("item.link", "item.url", "item.projectPage", "item.githubRepo", F.lit("")).alias("url"),
        F.coalesce("item.publishedAt", "item.updatedAt", "item.submittedAt").alias("published_at"),
        F.col("item.transcriptSummary").alias("transcript_summary"), F.col("item.transcript.text").alias("transcript_text"),
        F.col("item.summary").alias("summary"), F.col("item.description").alias("description"),
        F.concat(F.coalesce("item.categories", F.array().cast("array<string>")), F.coalesce("item.keywords", F.array().cast("array<string>"))).alias("tags"),
    )
