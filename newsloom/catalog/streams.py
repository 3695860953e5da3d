"""Stream jobs over the events, each run to the end of its input."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import sqltext as q
from newsloom.catalog.base import EVENT_STATUS, register
from newsloom.catalog.ledger import ATTEMPTS, ISO, iso
from newsloom.schemas import TABLES
from newsloom.session import new_stage_path
from newsloom.streaming import jobs as sj, stateful as sf


PARTS = 6


def parts_of(t):
    """Folder to which the events arrive in two deliveries of several files each, and the deliveries."""
    folder = new_stage_path(t.spark, "arrivals")
    events = t.read("events")
    last = events.agg(F.max("event_id")).first()[0] or 0
    numbered = events.withColumn("_part", F.least(F.floor(F.col("event_id") * PARTS / (last + 1)), F.lit(PARTS - 1)))

    def deliver(first: int, past: int) -> None:
        # one file after the other, rows of a file in no order
        for part in range(first, past):
            numbered.filter(F.col("_part") == part).drop("_part").orderBy(F.xxhash64("event_id")).coalesce(1).write.mode("append").parquet(folder)

    return folder, deliver


def stream(t, folder):
    """Events as a ledger stream, one file per batch."""
    events = sj.tail(t.spark, folder, TABLES["events"], "*.parquet", 1)
    status = F.lit("discovered")
    for event, state in EVENT_STATUS.items():
        status = F.when(F.col("event_type") == event, state).otherwise(status)
    return events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), status.alias("status"), F.col("ts").alias("observed_at"), F.col("value").alias("score"), "event_type")


HEARTBEAT = -1  # id of a record that only moves the watermark on
ORDER = (3, 0, 5, 1, 4, 2)  # in which files arrive where the order must not matter


def disordered(t, build, name):
    """Runs ``build(stream)`` over the files in another order than their records', in two deliveries, and then two heartbeats:
    the watermark moves after a batch, so what the first frees comes out with the second."""
    folder = new_stage_path(t.spark, "arrivals")
    out, checkpoint = sj.paths(t.spark, name)
    events = t.read("events")
    last, newest = events.agg(F.max("event_id"), F.max("ts")).first()
    numbered = events.withColumn("_part", F.least(F.floor(F.col("event_id") * PARTS / ((last or 0) + 1)), F.lit(PARTS - 1)))
    df = None
    for delivery in (ORDER[:3], ORDER[3:]):
        for part in delivery:
            numbered.filter(F.col("_part") == part).drop("_part").orderBy(F.xxhash64("event_id")).coalesce(1).write.mode("append").parquet(folder)
        df = build(stream(t, folder))
        sj.append_to(df, out, checkpoint)
    for days in (100, 200):
        beat = events.limit(1).select(*[(F.lit(newest) + F.expr(f"INTERVAL {days} DAYS")).cast(events.schema["ts"].dataType).alias("ts") if c == "ts"
                                        else F.lit(HEARTBEAT).cast(events.schema[c].dataType).alias(c) if c in ("event_id", "user_id") else F.col(c) for c in events.columns])
        beat.write.mode("append").parquet(folder)
        sj.append_to(build(stream(t, folder)), out, checkpoint)
    return t.spark.read.schema(df.schema).parquet(out).filter(F.col("id") != HEARTBEAT)


def restarted(t, job):
    """Runs ``job(stream)`` on the first delivery, and again, from its checkpoint, after the second."""
    folder, deliver = parts_of(t)
    deliver(0, PARTS // 2)
    job(stream(t, folder))
    deliver(PARTS // 2, PARTS)
    return job(stream(t, folder))


def run(t, build, name, mode="append"):
    out, checkpoint = sj.paths(t.spark, name)

    def job(rows):
        df = build(rows)
        sj.append_to(df, out, checkpoint, mode)
        return t.spark.read.schema(df.schema).parquet(out)

    return restarted(t, job)


@register("stream_tail", "I1 K4", q.with_([q.LEDGER], "SELECT seq, id, status, score FROM ledger"))
def _(t):
    return run(t, lambda rows: rows.select("seq", "id", "status", "score"), "tail")


@register("stream_latest_records", "I2", q.with_([q.LEDGER], "SELECT id, seq, status, score FROM ledger QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1"))
def _(t):
    where = sj.paths(t.spark, "latest")
    return restarted(t, lambda rows: sj.latest_per_id(rows, ["status", "score"], *where))


@register("stream_first_keys", "I3", "SELECT DISTINCT user_id AS id, event_type FROM events")
def _(t):
    def first(rows):
        keyed = rows.select("id", "event_type", F.col("observed_at").cast("timestamp").alias("at"))
        return sj.first_within(keyed, ["id", "event_type"], "at", "40 days").select("id", "event_type")

    return run(t, first, "first")


@register("stream_local_days", "I4", """
WITH local AS (SELECT *, timezone('America/Chicago', timezone('UTC', ts)) AS local_at FROM events)
SELECT strftime(CAST(local_at AS DATE), '%Y-%m-%d') AS day, count(*) AS n, min(event_id) AS lead_seq FROM local
GROUP BY CAST(local_at AS DATE) HAVING CAST(local_at AS DATE) + 1 <= (SELECT max(local_at) - INTERVAL 1 HOUR FROM local)""")
def _(t):
    return run(t, lambda rows: sj.local_day_rollup(rows, "America/Chicago", "1 hour"), "days").withColumn("day", F.col("day").cast("string"))


@register("stream_weekly_windows", "I5", """
SELECT strftime(start_day, '%Y-%m-%d') AS start_day, count(*) AS n, round(sum(value), 4) AS total FROM (
  SELECT value, CAST(ts AS DATE) - CAST(k AS INTEGER) AS start_day FROM events, range(7) r(k))
GROUP BY start_day HAVING start_day + 7 <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def _(t):
    out = run(t, lambda rows: sj.weekly_rollup(rows, "1 hour"), "weeks")
    return out.select(F.col("start_day").cast("string").alias("start_day"), "n", F.round("total", 4).alias("total"))


DUE = "observed_at + to_minutes(CAST(least(1440, 5 * pow(2, attempt - 1)) AS BIGINT))"


@register("stream_retry_queue", "I6 X19", q.with_([q.LEDGER, ATTEMPTS, f"""
due AS (SELECT id, attempt, {DUE} AS due, next_at FROM (SELECT *, lead(observed_at) OVER (PARTITION BY id ORDER BY seq) AS next_at, status = 'revisit_pending' AS failed FROM ledger) l
  JOIN (SELECT seq, attempt FROM tries) USING (seq)),
ends AS (SELECT *, lag(attempt) OVER (PARTITION BY id ORDER BY seq) AS before FROM (SELECT * FROM ledger LEFT JOIN (SELECT seq, attempt FROM tries) USING (seq)))"""], f"""
SELECT 'scheduled' AS event, seq, id, attempt, {ISO.format(DUE)} AS due FROM tries
UNION ALL SELECT 'due', -1, id, attempt, {ISO.format("due")} FROM due WHERE next_at IS NULL OR due <= next_at
UNION ALL SELECT 'resolved', seq, id, before, NULL FROM ends WHERE attempt IS NULL AND before IS NOT NULL"""))
def _(t):
    found = disordered(t, lambda rows: sf.retry_queue(rows, "60 days"), "retry")
    return found.select("event", "seq", "id", "attempt", iso("due").alias("due"))


@register("stream_state_progress", "I7", q.with_([q.LEDGER], """
SELECT id, seq, status, previous, coalesce(coalesce(previous, 'missing') = CASE status WHEN 'briefed' THEN 'parsed' WHEN 'enriched' THEN 'briefed' END, true) AS valid
FROM (SELECT *, lag(status) OVER (PARTITION BY id ORDER BY seq) AS previous FROM ledger)"""))
def _(t):
    return disordered(t, lambda rows: sf.state_progress(rows, "60 days"), "states")


@register("stream_late_rows", "I4", f"""
WITH parted AS (SELECT *, CAST(least(floor(event_id * {PARTS} / ((SELECT max(event_id) FROM events) + 1)), {PARTS - 1}) AS INTEGER) AS part FROM events),
placed AS (SELECT part, list_position({list(ORDER)}, part) AS place, max(ts) AS newest FROM parted GROUP BY part),
marks AS (SELECT part, max(newest) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM placed)
SELECT event_id AS seq, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, coalesce(ts < mark - INTERVAL 36 HOUR, false) AS late FROM parted JOIN marks USING (part)""")
def _(t):
    folder, (out, checkpoint) = new_stage_path(t.spark, "arrivals"), sj.paths(t.spark, "late")
    events = t.read("events")
    last = events.agg(F.max("event_id")).first()[0] or 0
    part = F.least(F.floor(F.col("event_id") * PARTS / (last + 1)), F.lit(PARTS - 1))
    for number in ORDER:
        events.filter(part == number).coalesce(1).write.mode("append").parquet(folder)
        on_time, late = sj.split_late(stream(t, folder), "observed_at", "36 HOURS", out, checkpoint)
    return on_time.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True))).select("seq", F.to_date("observed_at").cast("string").alias("day"), "late")


@register("stream_static_join", "I8", q.with_([q.LEDGER], "SELECT seq, id, source, lang FROM ledger JOIN documents ON doc_id = id"))
def _(t):
    known = t.read("documents").select(F.col("doc_id").alias("id"), "source", "lang")
    return run(t, lambda rows: sj.with_known(rows.select("seq", "id"), known, "id").select("seq", "id", "source", "lang"), "known")


@register("stream_day_index", "I9 U2", "SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def _(t):
    where = sj.paths(t.spark, "index")
    return restarted(t, lambda rows: sj.upsert_day_index(rows, *where))


@register("stream_graph_merge", "I9 U3", q.with_([q.LEDGER], """
SELECT id, arg_max(status, seq) AS type, arg_max(score, seq) FILTER (WHERE score >= 5) AS score FROM ledger GROUP BY id"""))
def _(t):
    where = sj.paths(t.spark, "graph")

    def merged(rows):
        versions = rows.select("id", F.col("status").alias("type"), F.when(F.col("score") >= 5, F.col("score")).alias("score"), "seq")
        return sj.merge_graph_batches(versions, *where).select("id", "type", "score")

    return restarted(t, merged)
