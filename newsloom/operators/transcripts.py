"""Transcripts: turns to sentences to summaries.

A transcript is never concatenated. Sentences may span turns, so each
fragment is numbered by a running count that is taken in blocks of turns
and carried across blocks; only one sentence at a time is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from newsloom import rules
from newsloom.functions import text as tx
from newsloom.operators.ledger import top_per_key

BLOCK = 4096


def sentences(turns: DataFrame) -> DataFrame:
    """(conv_id, sentence_no, sentence) of each conversation's whole text."""
    clean = turns.select("conv_id", "turn", tx.collapse(F.col("text")).alias("text")).filter(F.col("text") != "")
    split = clean.select(
        "conv_id", "turn", F.floor(F.col("turn") / BLOCK).alias("block"),
        F.split("text", tx.SENTENCE_GAP).alias("pieces"), F.col("text").rlike("[.!?]$").cast("bigint").alias("closed"),
    )
    # a piece ends a sentence unless it is the open tail of its turn
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = split.groupBy("conv_id", "block").agg(F.sum(F.size("pieces") - 1 + F.col("closed")).alias("n"))
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    parts = split.select("conv_id", "turn", "block", F.size("pieces").alias("n"), "closed", F.posexplode("pieces").alias("part", "piece"))
    ends = F.when(F.col("part") < F.col("n") - 1, F.lit(1)).otherwise(F.col("closed"))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "part").rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum(ends).over(inside), F.lit(0))
    numbered = parts.withColumn("local", local).join(blocks, ["conv_id", "block"])
    numbered = numbered.withColumn("sentence_no", F.col("local") + F.col("before") + 1)
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("turn", "part", "piece"))), lambda p: p.piece)
    return numbered.groupBy("conv_id", "sentence_no").agg(F.array_join(pieces, " ").alias("sentence"))


def _head(all_sentences: DataFrame, limit: int = 500) -> DataFrame:
    """First ``limit`` characters: every sentence takes two or more."""
    first = top_per_key(all_sentences, ["conv_id"], ["sentence_no"], limit // 2 + 1)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sentence_no", "sentence"))), lambda s: s.sentence), " ")
    return first.groupBy("conv_id").agg(F.substring(joined, 1, limit).alias("head"))


def _joined(picked: DataFrame, order: str, name: str) -> DataFrame:
    texts = F.transform(F.array_sort(F.collect_list(F.struct(order, "sentence"))), lambda s: s.sentence)
    return picked.groupBy("conv_id").agg(F.array_join(texts, " ").alias(name))


def summaries(all_sentences: DataFrame, limit: int = 5) -> DataFrame:
    """First ``limit`` sentences over 40 characters, else the head."""
    long = top_per_key(all_sentences.filter(F.length("sentence") > 40), ["conv_id"], ["sentence_no"], limit)
    return _head(all_sentences).join(_joined(long, "sentence_no", "picked"), "conv_id", "left").select(
        "conv_id", F.coalesce("picked", "head").alias("summary")
    )


def highlights(all_sentences: DataFrame, priority: str = rules.TRANSCRIPT_PRIORITY_PATTERN, limit: int = 5) -> DataFrame:
    """The first two sentences over 35 characters, then those that match
    the priority pattern; repeats dropped without regard to case, at most
    ``limit``; the head when there are none."""
    long = all_sentences.filter(F.length("sentence") > 35)
    lead = top_per_key(long, ["conv_id"], ["sentence_no"], 2).select("conv_id", "sentence_no", "sentence", F.lit(0).alias("grade"))
    matched = long.filter(tx.any_match(F.col("sentence"), [priority])).select("conv_id", "sentence_no", "sentence", F.lit(1).alias("grade"))
    key = F.lower("sentence")
    unique = lead.unionByName(matched).groupBy("conv_id", key.alias("key")).agg(
        F.min(F.struct("grade", "sentence_no", "sentence")).alias("s")
    ).select("conv_id", "s.*")
    picked = top_per_key(unique, ["conv_id"], ["grade", "sentence_no"], limit)
    return _head(all_sentences).join(_joined(picked, "rank", "picked"), "conv_id", "left").select(
        "conv_id", F.coalesce("picked", "head").alias("transcript_summary")
    )


def enrich(items: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Items joined to transcripts by video id: the summary is filled when
    empty, a missing transcript is marked.

    ``items`` has ``video_id, summary``; ``transcripts`` has ``video_id,
    transcript_summary``. Items that are no videos keep a null status.
    """
    joined = items.join(transcripts, "video_id", "left")
    return joined.withColumns({
        "summary": F.coalesce(tx.non_empty(F.col("summary")), "transcript_summary", F.lit("")),
        "transcript_status": F.when(F.col("transcript_summary").isNotNull(), "ok").when(F.col("video_id").isNotNull(), "unavailable"),
    })


def ingest_items(all_sentences: DataFrame, source_id, source_name) -> DataFrame:
    """Ledger items of whole transcripts."""
    return summaries(all_sentences, 5).select(
        F.concat(source_id, F.lit("-"), tx.slug(source_name)).alias("id"), "conv_id", source_name.alias("title"), "summary"
    )
