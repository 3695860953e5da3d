"""What the training-data operators share: table access, shared folders and size-checked joins."""

from __future__ import annotations

import contextlib
import ctypes
import posixpath
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsloom.session import new_stage_path, stage

__all__ = ["blocks", "release_memory", "read_table", "shared_fs", "stage", "new_stage_path", "bounded", "spread_lookup", "text_or_empty", "write_file"]

# A side is broadcast only if its counted rows stay within this.
BROADCAST_ROWS = 1_000_000
# Rows of one key are dealt over this many join partitions once the key is hot.
SALTS = 256
# Bytes of texts that a Python worker handles at once.
BLOCK_BYTES = 400_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def text_or_empty(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is.

    Counting is one pass over ``df``, so it should be a staged or small table.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread_lookup(left: DataFrame, right: DataFrame, key: str, size: str, spread_by: str, total: int) -> DataFrame:
    """Left join to ``right``, which has one row per ``key`` and the key's row count in ``size``.

    Keys that own over a thousandth of ``total`` rows, so fewer than a
    thousand keys, meet their row through a broadcast; their left rows go on
    under salted keys, so no task of the shuffled join gets a hot key.
    """
    columns = [c for c in right.columns if c != key]
    hot = right.filter(F.col(size) * 1000 > max(total, 1000))
    hot = F.broadcast(hot.select(F.col(key).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in columns]))
    salt = F.when(F.col("_hot").isNotNull(), 1 + F.pmod(F.xxhash64(spread_by), F.lit(SALTS))).otherwise(0)
    left = left.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", salt.cast("int"))
    cold = right.select(F.col(key).alias("_cold"), F.lit(0).alias("_cold_salt"), *[F.col(c).alias(f"_cold_{c}") for c in columns])
    joined = left.join(cold, (F.col(key) == F.col("_cold")) & (F.col("_salt") == F.col("_cold_salt")), "left")
    kept = [c for c in left.columns if not c.startswith("_hot") and c != "_salt"]
    return joined.select(*kept, *[F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in columns])


def shared_fs(uri: str):
    """(file system, path) of a folder in any store that executors share."""
    from pyarrow import fs

    if "://" not in uri:
        uri = uri.removeprefix("file:") if uri.startswith("file:") else uri
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, name: str, data: bytes, attempt: str) -> None:
    """Write under a temporary name, then rename: readers see whole files only,
    and a repeated task replaces a file by the same bytes."""
    store, folder = shared_fs(uri)
    store.create_dir(folder, recursive=True)
    temporary = posixpath.join(folder, f"_{name}.{attempt}.tmp")
    with store.open_output_stream(temporary) as out:
        out.write(data)
    store.move(temporary, posixpath.join(folder, name))


def blocks(batch: pa.Array) -> Iterator[pa.Array]:
    """Slices of a batch with about BLOCK_BYTES of text each; every text is whole.

    A function may give its results slice by slice, so memory follows the
    slice (or the longest text), not the batch.
    """
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(batch):
        end = int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + BLOCK_BYTES)) + 1
        yield batch.slice(start, min(end, len(batch)) - start)
        start = end


def release_memory() -> None:
    """Gives freed memory of a worker process back to the system.

    Workers stay for later tasks; without this each keeps the most it ever
    used, and an executor holds several.
    """
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL("libc.so.6").malloc_trim(0)
