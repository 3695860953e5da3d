"""Exact dedup by a Golomb-coded exchange of fingerprints.

1. Every task hashes its texts to short fingerprints and sends each owner of a
   fingerprint range one message: its distinct fingerprints there, sorted,
   as Golomb-Rice coded gaps. Texts stay where they are.
2. An owner answers each message with a bitmap: which of its fingerprints
   came from another task too.
3. The same tasks read their texts again and mark rows whose fingerprint was
   answered, or repeats within the task. Only these suspects are shuffled,
   with their texts, and compared byte by byte.

Fingerprints have 12 bits more than the row count needs, so about one row in
4,000 is a suspect by chance; it costs a comparison, never a wrong result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from newsloom.llm.common import new_stage_path, shared_fs, spread_lookup, stage, text_or_empty, write_file

SPARE_BITS = 12
OWNER_ROWS = 1_000_000  # fingerprints that one owner answers for, about


def normalised(text: str | Column) -> Column:
    """White-space runs become one space; null counts as empty."""
    return F.regexp_replace(text_or_empty(text), r"[\x20\x09-\x0D]+", " ")


def golomb_encode(gaps: np.ndarray, k: int) -> tuple[bytes, bytes]:
    """Gaps as unary quotients and, apart from them, k-bit remainders."""
    ends = np.cumsum((gaps >> k) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 1
    low = ((gaps[:, None] >> np.arange(k - 1, -1, -1)) & 1).astype(np.uint8)
    return np.packbits(unary).tobytes(), np.packbits(low.ravel()).tobytes()


def golomb_decode(n: int, k: int, unary: bytes, low: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(low, np.uint8))[:n * k].reshape(n, k).astype(np.int64)
    return (quotients << k) | (bits << np.arange(k - 1, -1, -1)).sum(axis=1)


def pack(values: np.ndarray, start: int, width: int) -> dict:
    """Message of sorted distinct ``values`` in [start, start + width)."""
    k = max(0, int(np.log2(max(1, width // len(values)))))
    unary, low = golomb_encode(np.diff(values, prepend=start), k)
    return {"n": len(values), "k": k, "unary": unary, "low": low}


def unpack(start: int, n: int, k: int, unary: bytes, low: bytes) -> np.ndarray:
    return start + np.cumsum(golomb_decode(n, k, unary, low))


class Exchange:
    """Fingerprint ranges and the three steps of one run over one table."""

    def __init__(self, rows: int, parallelism: int):
        self.bits = min(60, int(np.ceil(np.log2(rows + 2))) + SPARE_BITS)
        self.owners = max(parallelism, rows // OWNER_ROWS + 1)
        self.width = -(-(1 << self.bits) // self.owners)

    def fingerprint(self, text: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(text), 64 - self.bits)

    def messages(self, fingerprints: DataFrame) -> DataFrame:
        """One row per task and owner; ``repeated`` marks what occurs twice in the task itself and stays with it."""
        width = self.width

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            values = np.concatenate([np.zeros(0, np.int64), *[b.column(0).to_numpy(zero_copy_only=False) for b in batches]])
            total = len(values)
            values, counts = np.unique(values, return_counts=True)
            owners = values // width
            rows = []
            for owner in np.unique(owners):
                here = owners == owner
                rows.append({"task": TaskContext.get().partitionId(), "owner": int(owner), "total": total, "repeated": np.packbits(counts[here] > 1).tobytes(),
                             **pack(values[here], int(owner) * width, width)})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_MESSAGE)

        return fingerprints.mapInArrow(send, "task int, owner int, total long, repeated binary, n int, k int, unary binary, low binary")

    def answers(self, messages: DataFrame) -> DataFrame:
        """One bitmap per message: which of its fingerprints another task sent too."""
        width = self.width

        def answer(key: tuple, sent: pd.DataFrame) -> pd.DataFrame:
            lists = [unpack(key[0] * width, m.n, m.k, m.unary, m.low) for m in sent.itertuples()]
            values, counts = np.unique(np.concatenate(lists), return_counts=True)
            shared = values[counts > 1]
            return pd.DataFrame({"task": sent["task"], "owner": sent["owner"], "shared": [np.packbits(np.isin(x, shared, assume_unique=True)).tobytes() for x in lists]})

        return messages.select("task", "owner", "n", "k", "unary", "low").groupBy("owner").applyInPandas(answer, "task int, owner int, shared binary")

    def deliver(self, messages: DataFrame, answers: DataFrame, folder: str) -> DataFrame:
        """Writes each task's sorted suspects to a file of its own; returns (task, total, suspects)."""
        width = self.width

        def store(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("owner")
            found = [np.zeros(0, np.int64)]
            for m in rows.itertuples():
                bits = np.unpackbits(np.frombuffer(m.repeated, np.uint8) | np.frombuffer(m.shared, np.uint8))[:m.n].astype(bool)
                found.append(unpack(m.owner * width, m.n, m.k, m.unary, m.low)[bits])
            suspects = np.concatenate(found)
            total = int(rows["total"].iloc[0])
            write_file(folder, f"task-{key[0]}", np.concatenate([[total], suspects]).astype(np.int64).tobytes(), uuid.uuid4().hex)
            return pd.DataFrame({"task": [key[0]], "suspects": [len(suspects)]})

        return messages.join(answers, ["task", "owner"]).groupBy("task").applyInPandas(store, "task int, suspects long")


_MESSAGE = pa.schema([("task", pa.int32()), ("owner", pa.int32()), ("total", pa.int64()), ("repeated", pa.binary()), ("n", pa.int32()), ("k", pa.int32()),
                      ("unary", pa.binary()), ("low", pa.binary())])


def suspect_column(fingerprint: Column, folder: str) -> Column:
    """Whether the task's file lists the fingerprint. The task must see as many rows as it saw when it sent its messages."""

    @F.arrow_udf("boolean")
    def suspect(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        suspects, total, seen = None, 0, 0
        for batch in batches:
            if suspects is None:
                store, path = shared_fs(folder)
                with store.open_input_stream(f"{path}/task-{TaskContext.get().partitionId()}") as f:
                    total, suspects = (lambda a: (int(a[0]), a[1:]))(np.frombuffer(f.read(), np.int64))
            values = batch.to_numpy(zero_copy_only=False)
            seen += len(values)
            if len(suspects):
                at = np.minimum(np.searchsorted(suspects, values), len(suspects) - 1)
                yield pa.array(suspects[at] == values)
            else:
                yield pa.array(np.zeros(len(values), bool))
        if seen != total:
            raise RuntimeError(f"the second read of this partition has {seen} rows, the first had {total}; write the input to a table first")

    return suspect(fingerprint)


def marked(df: DataFrame, text_column: str, carry: list[str]) -> DataFrame:
    """Staged rows: the carried columns, _row (a row number), _sha256, _suspect, and _text of suspects, normalised.

    ``df`` must be a scan (with maps over it), so its partitions come out the
    same when read again; each task checks that they do.
    """
    spark = df.sparkSession
    exchange = Exchange(df.count(), spark.sparkContext.defaultParallelism)
    folder = new_stage_path(spark, "suspects")
    text = normalised(text_column)
    messages = stage(exchange.messages(df.select(exchange.fingerprint(text).alias("fingerprint"))), "fingerprints")
    exchange.deliver(messages, exchange.answers(messages), folder).agg(F.sum("suspects")).collect()
    # through a stage of its own, so that the task number is the partition's
    rows = df.withColumn("_text", text).withColumn("_sha256", F.sha2("_text", 256)).withColumn("_suspect", suspect_column(exchange.fingerprint(F.col("_text")), folder))
    return stage(rows.select(*carry, F.monotonically_increasing_id().alias("_row"), "_sha256", "_suspect", F.when(F.col("_suspect"), F.col("_text")).alias("_text")), "suspect-rows")


class UnequalBytes(RuntimeError):
    """Two different texts have one SHA-256."""


def groups_of(rows: DataFrame, id_column: str) -> DataFrame:
    """(_sha256, keep_id, keep_row, size) of each text that suspects have; texts are compared byte by byte."""
    suspects = rows.filter("_suspect")
    texts = suspects.groupBy("_sha256", "_text").agg(F.count("*").alias("copies"))
    if texts.groupBy("_sha256").count().filter("count > 1").limit(1).count():
        raise UnequalBytes("two different texts have one SHA-256")
    first = F.min(F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"), F.col("_row").alias("row")))
    groups = suspects.groupBy("_sha256").agg(first.alias("first"), F.count("*").alias("size"))
    return stage(groups.select("_sha256", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"), "size"), "suspect-groups")


def find_copies(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``df``: the carried columns (the id at least), keep_id, group_size, kept, text_sha256.

    Of equal normalised texts the row with the smallest id is kept; null ids
    come last, and of rows with one id any one is kept. Null texts count as
    empty, so they are copies of empty ones. An empty table gives no rows.
    Carried columns called like a result column are not carried.
    """
    results = {"keep_id", "group_size", "kept", "text_sha256"}
    carry = [c for c in dict.fromkeys([id_column, *(carry or [])]) if c not in results]
    rows = marked(df, text_column, carry)
    groups = groups_of(rows, id_column)
    total = groups.agg(F.sum("size")).first()[0] or 0
    alone = rows.filter("NOT _suspect").select(*carry, F.col(id_column).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("_sha256").alias("text_sha256"))
    found = spread_lookup(rows.filter("_suspect").select(*carry, "_row", "_sha256"), groups, "_sha256", "size", "_row", total)
    return alone.union(found.select(*carry, "keep_id", F.col("size").alias("group_size"), (F.col("_row") == F.col("keep_row")).alias("kept"), F.col("_sha256").alias("text_sha256")))
