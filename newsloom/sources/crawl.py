"""Crawler output as a table: fetch results and their guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsloom.operators.retry import reason_code

ACCEPTED_TYPES = r"(?i)(text/html|application/xhtml\+xml|application/xml|text/xml|text/plain)"


def classify_fetches(fetched: DataFrame) -> DataFrame:
    """``outcome`` is "parsed" for rows worth parsing, else a failure code.

    Rows carry ``http_status, content_type, html``.
    """
    status, kind = F.col("http_status"), F.coalesce("content_type", F.lit(""))
    message = F.concat(F.lit("HTTP "), status.cast("string"))
    outcome = (
        F.when(~status.between(200, 299), reason_code(message))
        .when((kind != "") & ~kind.rlike(ACCEPTED_TYPES), "unsupported_content_type")
        .when(F.trim(F.coalesce("html", F.lit(""))) == "", "empty_body")
        .otherwise("parsed")
    )
    return fetched.withColumn("outcome", outcome)
