"""Recover JSON payloads from free text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def recover_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Adds ``form`` (whole, fenced, braces, rejected) and ``payload``.

    The whole text is tried first, then a fenced block, then the outermost
    braces; a text that starts one form but does not parse is rejected.
    """
    text = F.trim(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""))
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    is_json = lambda c: F.try_parse_json(c).isNotNull()
    form = (
        F.when(is_json(text), "whole")
        .when(F.contains(text, F.lit("```")) & is_json(fenced), "fenced")
        .when(~F.contains(text, F.lit("```")) & (braces != "") & is_json(braces), "braces")
        .otherwise("rejected")
    )
    body = F.when(F.col("form") == "whole", text).when(F.col("form") == "fenced", fenced).when(F.col("form") == "braces", braces)
    return df.withColumn("form", form).withColumn("payload", F.from_json(body, schema))
