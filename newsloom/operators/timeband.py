"""Joins on nearness in time, without any other key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.operators.ledger import top_per_key
from newsloom.session import small, stage

ROWS_PER_CELL = 100_000  # of the searched side that share a join key; fuller cells are dealt over several
DAY = 86_400_000_000  # microseconds


def _cell(at: Column, width: int) -> Column:
    return F.floor(F.unix_micros(at.cast("timestamp")) / F.lit(width))


def band_join(probes: DataFrame, rows: DataFrame, days: int = 3, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """Pairs less than ``days`` apart, with their ``gap`` in microseconds.

    ``probes``: ``probe, asked_at``; ``rows``: ``id, at``; null times meet
    nothing. Both sides stand on cells as wide as the band; a probe looks at
    its own and both neighbours. A cell with many rows is dealt over several
    keys by the hash of the id, and only its probes are repeated for them.
    """
    width = days * DAY
    rows = rows.filter(F.col("at").isNotNull()).withColumn("cell", _cell(F.col("at"), width))
    parts = rows.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(rows_per_cell)).cast("int").alias("parts")).filter("parts > 1")
    parts = small(stage(parts, "time-cells"))
    rows = rows.join(parts, "cell", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    probes = probes.filter(F.col("asked_at").isNotNull()).select("*", around.alias("_near")).withColumn("cell", _cell(F.col("asked_at"), width) + F.col("_near")).drop("_near")
    probes = probes.join(parts, "cell", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    gap = F.abs(F.unix_micros(F.col("asked_at").cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp")))
    return probes.join(rows, ["cell", "part"]).withColumn("gap", gap).filter(F.col("gap") < width).drop("cell", "part")


def nearest_in_time(probes: DataFrame, rows: DataFrame, days: int = 3, limit: int = 5, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """The ``limit`` nearest rows of each probe within the band: (probe, id, gap, rank).

    Probes of one moment are answered once, and of rows of one moment only
    the first ``limit`` can be among the nearest, so neither a hot moment of
    the probes nor one of the rows is multiplied out.
    """
    asked = stage(probes.groupBy("asked_at").agg(F.count("*").alias("askers")), "asked-moments")
    first = top_per_key(rows.filter(F.col("at").isNotNull()), ["at"], ["id"], limit, "_r").drop("_r")
    near = band_join(asked.select(F.col("asked_at").alias("probe"), "asked_at"), first, days, rows_per_cell)
    best = top_per_key(near, ["asked_at"], ["gap", "id"], limit).select("asked_at", "id", "gap", "rank")
    return probes.join(small(stage(best, "nearest")), "asked_at").select("probe", "id", "gap", "rank")
