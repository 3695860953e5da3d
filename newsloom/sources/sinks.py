"""Sinks. All writes are partitioned; nothing is gathered into one file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsloom import rules


def write_families(df: DataFrame, path: str, family: str = "family") -> None:
    """One folder per feed family in a single job."""
    df.write.mode("overwrite").partitionBy(family).json(path)


def append_ledger(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Append-only ledger; order lives in the ``seq`` column, never in file
    positions. A line that does not parse is an error: nothing is lost silently."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_raw(df: DataFrame, path: str, source: str = "source_id") -> None:
    """Raw payloads by source."""
    df.write.mode("append").partitionBy(source).parquet(path)


def json_ld_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON object per node and edge; the context is constant and
    written once by ``json_ld_context``."""
    node_rest = [c for c in nodes.columns if c not in ("id", "type")]
    edge_rest = [c for c in edges.columns if c not in ("id", "type", "src", "dst")]
    node_line = F.to_json(F.struct(F.col("id").alias("@id"), F.col("type").alias("@type"), *node_rest))
    edge_line = F.to_json(F.struct(F.col("id").alias("@id"), F.col("type").alias("@type"), F.col("src").alias("from"), F.col("dst").alias("to"), *edge_rest))
    return nodes.select(node_line.alias("value")).unionByName(edges.select(edge_line.alias("value")))


def json_ld_context() -> dict:
    context: dict = {"@vocab": rules.GRAPH_VOCAB}
    context.update({term: {"@type": "@id"} for term in rules.EDGE_TERMS})
    return context


def write_json_ld(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    json_ld_lines(nodes, edges).write.mode("overwrite").text(path)


def artifact_document(graph: Column) -> Column:
    """Self-contained JSON-LD text of one artifact's small graph array."""
    import json

    return F.concat(F.lit('{"@context":' + json.dumps(json_ld_context(), separators=(",", ":")) + ',"@graph":'), F.to_json(graph), F.lit("}"))


def write_markdown(articles: DataFrame, path: str) -> None:
    """(slug, markdown) rows; a file per slug is a later export of a slice."""
    articles.select("slug", "markdown").write.mode("overwrite").parquet(path)
