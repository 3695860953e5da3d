"""Failure codes, retry schedules and state checks over a ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom import rules
from newsloom.functions import dates as dx
from newsloom.operators.ledger import bucketed_previous


def reason_code(message: Column) -> Column:
    """Failure code of an error message; unclassified failures count as
    empty text."""
    status = F.regexp_extract(message, r"(?i)HTTP\s+(\d+)", 1)
    code = status.try_cast("int")
    low = F.lower(message)
    return (
        F.when(code.isin(401, 403, 404, 429), F.concat(F.lit("http_"), status))
        .when(code >= 500, F.lit("http_5xx"))
        .when(low.rlike("timeout|aborted"), F.lit("timeout"))
        .when(F.contains(low, F.lit("empty response body")), F.lit("empty_body"))
        .when(F.contains(low, F.lit("unsupported content type")), F.lit("unsupported_content_type"))
        .otherwise(F.lit("parse_empty_text"))
    )


def stage_reason(error_code: Column) -> Column:
    return F.when(error_code == "inference_unavailable", error_code).otherwise(F.lit("llm_inference_failed"))


def stage_pending(failures: DataFrame, stage: str) -> DataFrame:
    """Pending record of a failed stage; ``failures`` has ``parent_id,
    error_code, at`` (timestamp)."""
    from newsloom.functions import text as tx

    return failures.select(
        F.concat(F.lit(f"{stage}:pending:"), tx.stable_hash(F.concat("parent_id", F.lit(":"), dx.iso(F.col("at"))))).alias("id"),
        F.lit(stage).alias("type"), "parent_id", F.lit("revisit_pending").alias("status"),
        stage_reason(F.col("error_code")).alias("reason_code"), F.lit(1).alias("attempt_count"),
        F.col("at").alias("last_attempt_at"), dx.next_check(F.col("at"), F.lit(1)).alias("next_check_after"),
    )


def attempts(ledger: DataFrame, key: str = "id", bucket: str = "block", order: str = "seq") -> DataFrame:
    """Attempt number of every failure: its place in the current run of
    failures of its id. Any other record ends the run.

    Prefix counts are taken inside (id, block of records) and carried
    across blocks, so an id with a third of all records, or of a day's, is
    still many small windows.
    """
    failing = F.col("status") == "revisit_pending"
    inside = Window.partitionBy(key, bucket).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = ledger.withColumn("_c", F.sum(failing.cast("bigint")).over(inside))
    counted = counted.withColumn("_m", F.max(F.when(~failing, F.col("_c"))).over(inside))
    earlier = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        counted.groupBy(key, bucket)
        # failures, and failures up to the last ending record, of each block
        .agg(F.sum(failing.cast("bigint")).alias("_t"), F.max("_m").alias("_r"))
    )
    carried = carried.withColumn("_off", F.coalesce(F.sum("_t").over(earlier), F.lit(0)))
    carried = carried.withColumn("_base", F.max(F.col("_off") + F.col("_r")).over(earlier))
    joined = counted.join(carried.select(key, bucket, "_off", "_base"), [key, bucket])
    number = (F.col("_off") + F.col("_c")) - F.coalesce(F.col("_off") + F.col("_m"), F.col("_base"), F.lit(0))
    return joined.filter(failing).withColumn("attempt", number).drop("_c", "_m", "_off", "_base")


def schedule(failures: DataFrame) -> DataFrame:
    return failures.withColumn("next_check_after", dx.next_check(F.col("observed_at"), F.col("attempt")))


def resolve(queue: DataFrame, probes: DataFrame, scraper_key: bool = False) -> DataFrame:
    """Queue rows joined to the newest probe of their id and decided.

    ``probes`` has one row per id: ``http_status, content_length``.
    """
    joined = queue.join(probes, "id", "left")
    code, status = F.col("reason_code"), F.coalesce("http_status", F.lit(0))
    probed = F.startswith(code, F.lit("http_")) | code.isin("empty_body", "unsupported_content_type")
    outcome = (
        F.when(code == "invalid_uri", "manual_required")
        .when(code == "scraper_auth_missing", "resolved" if scraper_key else "still_blocked")
        .when(code == "parse_empty_text", F.when(F.coalesce("content_length", F.lit(0)) > 512, "resolved").otherwise("still_blocked"))
        .when(probed & (status == 404), "manual_required")
        .when(probed & status.between(200, 299), "resolved")
        .when(probed, "still_blocked")
        .when(code.isin("youtube_transcript_missing", "x_bridge_unavailable"), "still_blocked")
        .otherwise("resolved")
    )
    return joined.withColumn("resolver_status", outcome)


def transitions(ledger: DataFrame, bucket: str = "block") -> DataFrame:
    """Every record with the state before it and whether the step is one
    the pipeline makes."""
    stepped = bucketed_previous(ledger, "id", bucket, "seq", "status", "previous")
    required = F.create_map(*[F.lit(x) for pair in rules.STATE_PRECONDITIONS.items() for x in pair])
    need = F.element_at(required, F.col("status"))
    return stepped.withColumn("valid", need.isNull() | (F.coalesce("previous", F.lit("missing")) == need))


def precondition_rejects(requests: DataFrame, latest: DataFrame) -> DataFrame:
    """Requests (``id, required``) whose latest record is missing or in
    another state."""
    state = F.coalesce("status", F.lit("missing"))
    return (
        requests.join(latest.select("id", "status"), "id", "left")
        .filter(state != F.col("required")).select("id", "required", state.alias("found"))
    )
