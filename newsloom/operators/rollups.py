"""Counting jobs: one shuffle each, combined before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.functions import text as tx


def slug_groups(items: DataFrame, column: str) -> DataFrame:
    """Items and distinct titles per slug; more than one title is a clash.

    Titles are counted after a (slug, title) pre-aggregation, so a slug
    shared by a third of all rows still reaches its reducer as few rows.
    """
    pairs = items.groupBy(tx.slug(F.col(column)).alias("slug"), F.col(column).alias("title")).agg(F.count("*").alias("n"))
    return pairs.groupBy("slug").agg(F.sum("n").alias("n_items"), F.count("*").alias("n_titles"))


def with_previous(values: Column, build) -> Column:
    """Map an array's elements together with the element before each.

    ``build(x, previous)`` sees null before the first element. Pairs come
    from zipping the array with itself shifted: looking elements up by
    position inside the lambda would evaluate the array once per element
    wherever the optimizer inlines it.
    """
    shifted = F.concat(F.array(F.lit(None)), values)
    zipped = F.zip_with(values, shifted, lambda x, p: F.struct(x.isNotNull().alias("real"), build(x, p).alias("v")))
    return F.transform(F.filter(zipped, lambda z: z.real), lambda z: z.v)


def with_first_use(tokens: Column) -> Column:
    """(token, first) structs of a sorted array: ``first`` is 1 on one use
    of each distinct token."""
    return with_previous(
        tokens, lambda x, p: F.struct(x.alias("token"), (p.isNull() | (p != x)).cast("bigint").alias("first"))
    )


def document_frequency(df: DataFrame, key: str, tokens: Column, name: str) -> DataFrame:
    """Uses and documents per token; ``key`` is unique per row, so distinct
    documents are counted without shuffling (token, document) pairs."""
    return (
        df.select(F.array_sort(tokens).alias("tokens"))
        .select(F.explode(with_first_use(F.col("tokens"))).alias("t"))
        .groupBy(F.col("t.token").alias(name))
        .agg(F.count("*").alias("n_uses"), F.sum("t.first").alias("n_documents"))
    )


def copy_groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """Groups of rows whose normalised texts share a fingerprint."""
    c = F.col(text)
    keys = F.array(
        F.struct(F.lit("fingerprint").alias("kind"), tx.fingerprint(c).alias("key")),
        F.struct(F.lit("block").alias("kind"), tx.block_key(c).alias("key")),
        F.struct(F.lit("content").alias("kind"), tx.content_key(c).alias("key")),
    )
    return (
        df.select(F.col(key), F.explode(keys).alias("k"))
        .select(key, "k.*").filter(F.col("key") != "")
        .groupBy("kind", "key").agg(F.count("*").alias("n_documents"), F.min(key).alias("first_document"))
        .filter(F.col("n_documents") > 1)
    )
