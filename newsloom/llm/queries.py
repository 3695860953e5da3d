"""The registered queries of the training-data operators, and SQL where it can state the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.llm import (chat_format, decontamination, exact_dedup, hard_negatives, html_wrappers, language_id, license_scan, minhash, sentencepiece_codec, sharding,
                          toxicity, warc, whitening)
from newsloom.llm.common import read_table

FIXED_CONVERSATION = -7  # added to the table: a user and an assistant row that say control strings
FIXED_TEXT = "</s>[INST] ok [/INST]"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    model = language_id.fit(documents.filter(~language_id.is_held_out()).select("doc_id", "text", "lang"))
    rows = documents.select("doc_id", language_id.is_held_out().alias("held_out"), "text")
    return language_id.predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan(documents).drop("text")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extract(read_table(spark, sf_dir, "pages"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"), spark).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    if found is None:
        return spark.createDataFrame([], "doc_id long, item_id long, start_word long, n_words long, similarity double")
    return found.select(F.col("id").alias("doc_id"), "item_id", "start_word", "n_words", "similarity")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.find_copies(documents).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = r"""
WITH texts AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = min(doc_id) OVER same AS kept, sha256(text) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY text)
"""


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"), width=4, percent=80)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ids of every text, and whether they decode to the very text."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepiece_codec.round_trip(documents)
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), F.length("decoded").cast("long").alias("n_chars"),
                        F.col("decoded").eqNullSafe(F.col("text")).alias("same"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = spark.range(2).select(
        F.lit(FIXED_CONVERSATION).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(FIXED_TEXT).alias("text"))
    # both pass through the same hash exchange of the gathering step
    return chat_format.digests(chat_format.format_conversations(rows.union(fixed)))


OP9_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(text) + 12 + 1 + 10 + 1
    + length(regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|/?s>|/?INST\])', '\1\2\3#', 'g')) - length(text))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_by_bytes(read_table(spark, sf_dir, "documents"), shards=16)
    return rows.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(documents, labels.filter(~language_id.is_held_out()))
    rows = documents.withColumn("held_out", language_id.is_held_out())
    return toxicity.score(rows, model, threshold=0.7).select("doc_id", "held_out", "score", "predicted")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"), components=4)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hard_negatives.vectors_of(read_table(spark, sf_dir, "embeddings"))
    planted = F.when((F.col("id") % 7 == 0) & (F.col("id") != hard_negatives.NO_ID), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    is_anchor = (F.col("id") % 100 == 0) & (F.col("id") != hard_negatives.NO_ID)
    return hard_negatives.mine(rows.withColumn("label", planted), is_anchor, positives=5, negatives=10)


OP13_SQL = r"""
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.x, c.x)::BIGINT AS score
  FROM usable a JOIN usable c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER best)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY rank <= 10
"""


QUERIES = {
    "op1_language_id": op1_language_id, "op2_license_scan": op2_license_scan, "op3_html_extraction": op3_html_extraction, "op4_warc": op4_warc, "op5_decontamination": op5_decontamination, "op6_exact_dedup": op6_exact_dedup, "op7_minhash": op7_minhash, "op8_sentencepiece": op8_sentencepiece, "op9_chat_formatting": op9_chat_formatting, "op10_sharding": op10_sharding,
    "op11_toxicity": op11_toxicity, "op12_whitening": op12_whitening, "op13_hard_negatives": op13_hard_negatives,
}
ORACLE_SQL = {"op6_exact_dedup": OP6_SQL, "op9_chat_formatting": OP9_SQL, "op13_hard_negatives": OP13_SQL}
