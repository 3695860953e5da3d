"""A keyed table that a stream adds to: deltas per batch, merged level by level."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsloom.sources.versions import VersionLog


class DeltaStore:
    """Deltas of batches, each a folder, under one version log.

    ``merge`` maps the union of some deltas to one delta of the same columns
    and may be applied in any grouping. Once ``fan_out`` segments of a level
    have come together they are merged into one of the next level, so a read
    touches at most ``fan_out`` segments of each of few levels however many
    batches there were. A batch that comes again after a restart is skipped;
    a merge that dies leaves folders that no version lists.
    """

    def __init__(self, spark: SparkSession, path: str, schema, merge: Callable[[DataFrame], DataFrame], fan_out: int = 8):
        self.spark, self.path, self.schema, self.merge, self.fan_out = spark, path.rstrip("/"), schema, merge, fan_out
        self.log = VersionLog(spark, path)

    def segments(self) -> list[dict]:
        return self.log.latest()[1].get("segments", [])

    def add(self, batch: int, df: DataFrame) -> None:
        number, content = self.log.latest()
        segments = content.get("segments", [])
        if any(s["first"] <= batch <= s["last"] for s in segments):
            return
        folder = f"{self.path}/level-0/batch-{batch}-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        self.log.commit(number + 1, {"segments": [*segments, {"level": 0, "first": batch, "last": batch, "folder": folder}]})
        self.compact()

    def compact(self) -> None:
        """Merges levels that are full, oldest segments first."""
        number, content = self.log.latest()
        segments = content.get("segments", [])
        level = 0
        while level <= max((s["level"] for s in segments), default=-1):
            full = [s for s in segments if s["level"] == level][:self.fan_out]
            if len(full) < self.fan_out:
                level += 1
                continue
            folder = f"{self.path}/level-{level + 1}/{uuid.uuid4().hex}"
            self.merge(self._read(full)).write.parquet(folder)
            one = {"level": level + 1, "first": full[0]["first"], "last": full[-1]["last"], "folder": folder}
            at = segments.index(full[0])
            segments = [*segments[:at], one, *[s for s in segments[at:] if s not in full]]
            number += 1
            self.log.commit(number, {"segments": segments})

    def _read(self, segments: list[dict]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[s["folder"] for s in segments])

    def read(self) -> DataFrame:
        """The merged table as of the newest version."""
        segments = self.segments()
        return self.merge(self._read(segments) if segments else self.spark.createDataFrame([], self.schema))
