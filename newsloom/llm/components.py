"""Connected components of a link table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsloom.llm.common import stage


def _roots(edges: DataFrame) -> DataFrame:
    """(v, root): every vertex follows its smallest neighbour, if smaller, down to a local minimum."""
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
    # a max of negated structs is not needed: min is combined in the tasks before the shuffle
    parent = stage(both.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("root")), "parents")
    while True:
        up = parent.select(F.col("v").alias("_v"), F.col("root").alias("_up"))
        jumped = stage(parent.join(up, F.col("root") == F.col("_v")).select("v", F.col("_up").alias("root"), (F.col("_up") != F.col("root")).alias("moved")), "parents")
        parent = jumped.select("v", "root")
        if not jumped.filter("moved").limit(1).count():
            return parent


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all ids in ``links`` (a, b); component is the smallest id that can be reached.

    Each round contracts trees of smallest neighbours to their roots, found by
    pointer jumping, and at least halves the vertices that still have links;
    so rounds grow with the logarithm of the vertices, chains included. No
    neighbour list is ever gathered.
    """
    edges = stage(links.filter("a <> b").select("a", "b").distinct(), "links")
    labels = None
    while edges.limit(1).count():
        root = _roots(edges)
        if labels is None:
            labels = root.select(F.col("v").alias("id"), F.col("root").alias("component"))
        else:
            labels = stage(labels.join(root, F.col("component") == F.col("v"), "left").select("id", F.coalesce("root", "component").alias("component")), "labels")
        to_a = root.select(F.col("v").alias("a"), F.col("root").alias("ra"))
        to_b = root.select(F.col("v").alias("b"), F.col("root").alias("rb"))
        edges = stage(edges.join(to_a, "a").join(to_b, "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels
