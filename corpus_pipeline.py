"""The corpus pipeline: language, exact copies, near copies, benchmark passages, tokens.

Every stage works on all rows its predecessor kept. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from newsloom.llm import decontamination, exact_dedup, language_id, minhash, sentencepiece_codec  # noqa: E402
from newsloom.llm.common import bounded, read_table, stage  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.5  # posterior probability below which no language is accepted


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, or whose language cannot be told; learns from the labels that are there."""
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    found = language_id.predict(docs.select(*COLUMNS), model)
    return found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of equal texts."""
    return exact_dedup.find_copies(docs.select(*COLUMNS), carry=COLUMNS).filter("kept").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near-duplicates; a row without an id stays."""
    gone = minhash.near_duplicates(docs.select("doc_id", "text")).filter("NOT kept").select(F.col("id").alias("doc_id")).distinct()
    return docs.select(*COLUMNS).join(bounded(stage(gone, "near-copies")), "doc_id", "left_anti")


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontamination.without_contaminated(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and the text as the ids give it back."""
    coded = sentencepiece_codec.round_trip(docs.select(*COLUMNS))
    return coded.select("doc_id", "lang", "source", F.col("decoded").alias("text"), "ids", F.size("ids").cast("long").alias("n_ids"))


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("sentencepiece", tokenize),
]

#: A fitted language model and its lattice cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, step) in enumerate(STAGES):
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
