"""JSON-LD graphs as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom import schemas


def read_graph_document(spark: SparkSession, path: str) -> DataFrame:
    """Entries of graph documents with a ``@graph`` array; a missing path
    is an empty graph."""
    from pyspark.errors import AnalysisException

    try:
        docs = spark.read.schema(schemas.GRAPH_DOCUMENT).option("multiLine", True).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        docs = spark.createDataFrame([], schemas.GRAPH_DOCUMENT)
    return docs.select(F.explode("@graph").alias("e")).select("e.*")


def read_graph_lines(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a graph stored as one JSON object per line."""
    lines = spark.read.text(path)
    return lines.select(F.from_json("value", schemas.GRAPH_ENTRY).alias("e")).select("e.*")


def named_entries(entries: DataFrame) -> DataFrame:
    """Entries with an id and a type, and whether they are edges: an entry with both ends is one."""
    return entries.withColumns({
        "id": F.coalesce("`@id`", "id"), "type": F.coalesce("`@type`", "type", F.lit("Thing")), "is_edge": F.col("from").isNotNull() & F.col("to").isNotNull(),
    }).drop("@id", "@type").filter(F.col("id").isNotNull())


def split_graph(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all entries."""
    named = named_entries(entries)
    edges = named.filter("is_edge").select("id", "type", F.col("from").alias("src"), F.col("to").alias("dst"))
    nodes = named.filter("NOT is_edge").drop("from", "to", "is_edge")
    return nodes, edges
