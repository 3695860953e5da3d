"""Stream jobs over an append-only ledger.

Every job reads files as they arrive and stops once all available input
is processed (``availableNow``); the same functions serve a continuous
trigger. Sinks write files; nothing is gathered in the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from newsloom.session import new_stage_path
from newsloom.streaming.store import DeltaStore

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tail(spark: SparkSession, folder: str, schema: str, glob: str | None = None, files_per_batch: int | None = None, fmt: str = "parquet") -> DataFrame:
    """New records of a ledger folder as a stream."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.format(fmt).load(folder)


def finish(query: StreamingQuery) -> StreamingQuery:
    query.awaitTermination()
    return query


def append_to(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return finish(
        stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def per_batch(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    return finish(stream.writeStream.foreachBatch(fn).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


class LateRows(StreamingQueryListener):
    """Rows dropped behind the watermark, summed over all batches of all
    queries while it is added to ``spark.streams``."""

    def __init__(self) -> None:
        self.dropped = 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.dropped += sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryTerminated(self, event) -> None:
        pass


def latest_per_id(stream: DataFrame, columns: list[str], path: str, checkpoint: str) -> DataFrame:
    """Latest record per id: each batch adds its own latest ones, which are merged level by level."""
    row = F.struct("seq", *columns)

    def newest(df: DataFrame) -> DataFrame:
        return df.groupBy("id").agg(F.max_by(row, "seq").alias("_r")).select("id", "_r.*")

    store = DeltaStore(stream.sparkSession, path, stream.select("id", "seq", *columns).schema, newest)
    per_batch(stream, lambda df, batch: store.add(batch, newest(df)), checkpoint)
    return store.read()


def first_within(stream: DataFrame, keys: list[str], time: str, lateness: str) -> DataFrame:
    """Drops repeats of a key that arrive within the allowed lateness."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def local_day_rollup(stream: DataFrame, zone: str, lateness: str) -> DataFrame:
    """Counts and first record per local calendar day; a day is emitted
    once the watermark passes its end."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("observed_at")).cast("timestamp")
    rows = stream.withColumn("local_at", local).withWatermark("local_at", lateness)
    return rows.groupBy(F.window("local_at", "1 day")).agg(F.count("*").alias("n"), F.min("seq").alias("lead_seq")).select(
        F.to_date("window.start").alias("day"), "n", "lead_seq")


def weekly_rollup(stream: DataFrame, lateness: str) -> DataFrame:
    """Seven-day windows that slide by a day."""
    rows = stream.withColumn("at", F.col("observed_at").cast("timestamp")).withWatermark("at", lateness)
    return rows.groupBy(F.window("at", "7 days", "1 day")).agg(F.count("*").alias("n"), F.sum("score").alias("total")).select(
        F.to_date("window.start").alias("start_day"), "n", "total")


def with_known(stream: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Stream records joined to a table that does not change during the
    run; the optimizer chooses how to ship the table by its size."""
    return stream.join(known, key)


def upsert_day_index(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Day counts as one delta per batch. Nothing is kept in the process: a
    replayed batch is not added again, a restarted stream goes on from the
    stored deltas."""
    store = DeltaStore(stream.sparkSession, path, "day string, n bigint", lambda df: df.groupBy("day").agg(F.sum("n").alias("n")))

    def count(df: DataFrame, batch: int) -> None:
        store.add(batch, df.groupBy(F.to_date("observed_at").cast("string").alias("day")).agg(F.count("*").alias("n")))

    per_batch(stream, count, checkpoint)
    return store.read()


def merge_graph_batches(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Node versions merged per batch. Every attribute keeps the order of
    the version that set it, so a late version never overrides a newer
    value, in its own batch or across batches."""
    attributes = [c for c in stream.columns if c not in ("id", "seq")]
    set_by = lambda c: F.struct(F.col(c).alias("value"), F.col("seq").alias("seq"))
    schema = stream.select("id", *[set_by(c).alias(c) for c in attributes]).schema

    def merge(df: DataFrame) -> DataFrame:
        newest = [F.max_by(F.col(c), F.when(F.col(c)["value"].isNotNull(), F.col(c)["seq"])).alias(c) for c in attributes]
        return df.groupBy("id").agg(*newest)

    store = DeltaStore(stream.sparkSession, path, schema, merge)
    per_batch(stream, lambda df, batch: store.add(batch, merge(df.select("id", *[set_by(c).alias(c) for c in attributes]))), checkpoint)
    return store.read().select("id", *[F.col(c)["value"].alias(c) for c in attributes])


def split_late(stream: DataFrame, time: str, lateness: str, path: str, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """(rows on time, late rows) as two tables; together they are all rows of the stream.

    A row is late if its time lies more than ``lateness`` behind the newest
    time of earlier batches. Each batch records its own newest time, one row,
    so the mark of a batch is the same when it is run again; the batch's
    folders are replaced whole.
    """
    spark = stream.sparkSession
    marks = DeltaStore(spark, f"{path}/marks", "one int, newest timestamp", lambda df: df.groupBy("one").agg(F.max("newest").alias("newest")))
    parts = {name: DeltaStore(spark, f"{path}/{name}", stream.schema, lambda df: df) for name in ("on_time", "late")}

    def split(df: DataFrame, batch: int) -> None:
        # marks of batches before this one: a replayed batch finds its own mark stored already
        before = [s for s in marks.segments() if s["last"] < batch]
        mark = marks._read(before).agg(F.max("newest")).first()[0] if before else None
        at = F.col(time).cast("timestamp")
        late = F.lit(False) if mark is None else F.coalesce(at < F.lit(mark) - F.expr(f"INTERVAL {lateness}"), F.lit(False))
        parts["on_time"].add(batch, df.filter(~late))
        parts["late"].add(batch, df.filter(late))
        marks.add(batch, df.select(F.lit(1).alias("one"), at.alias("newest")).groupBy("one").agg(F.max("newest").alias("newest")))

    per_batch(stream, split, checkpoint)
    return parts["on_time"].read(), parts["late"].read()


def paths(spark: SparkSession, name: str) -> tuple[str, str]:
    """(output, checkpoint) folders of one run in the shared folder."""
    base = new_stage_path(spark, name)
    return f"{base}/out", f"{base}/checkpoint"
