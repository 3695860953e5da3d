"""Hard-negative mining by Strassen products of integer tiles.

Anchors are taken in waves of bounded size, each sent to all tasks; the
candidates stay where they are. A task multiplies tiles of anchors and
candidates by Strassen's recursion on zero-padded 64-bit integers, so every
score is an exact integer sum. Two passes over the candidates keep one small
heap per anchor, and then one per anchor and positive; heaps of tasks are
merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from newsloom.llm.common import stage
from newsloom.llm.whitening import matrix_of, quantised, usable

WAVE_BYTES = 24 << 20  # of anchors that are sent to all tasks at once
ANCHOR_TILE, CANDIDATE_TILE = 512, 1024
LEAF = 32  # a side of a product that is small enough to be multiplied directly
NO_ID = 2 ** 63 - 1  # stands for a null id: the last one among ties


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b for 64-bit integers, by seven half-sized products and exact additions.

    Odd sides are padded with a zero row or column. Sums that a long cannot
    hold wrap around, in any order of the additions alike.
    """
    m, k = a.shape
    n = b.shape[1]
    if min(m, k, n) <= LEAF:
        return a @ b
    a = np.pad(a, ((0, m & 1), (0, k & 1)))
    b = np.pad(b, ((0, k & 1), (0, n & 1)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * i, 2 * l), np.int64)
    out[:i, :l] = p1 + p4 - p5 + p7
    out[:i, l:] = p3 + p5
    out[i:, :l] = p2 + p4
    out[i:, l:] = p1 - p2 + p3 + p6
    return out[:m, :n]


class Heaps:
    """The best ``size`` (score, id) of every key: higher scores first, then smaller ids."""

    def __init__(self, keys: int, size: int):
        self.size = size
        self.key = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.int64)
        self.floor = np.full(keys, np.iinfo(np.int64).min)  # nothing below can enter a full heap

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        key, score, ids = np.concatenate([self.key, key]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, ~score, key))  # ~score falls as the score rises, and never overflows
        key, score, ids = key[order], score[order], ids[order]
        start = np.flatnonzero(np.diff(key, prepend=-1))
        place = np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key))))
        kept = place < self.size
        self.key, self.score, self.id = key[kept], score[kept], ids[kept]
        full = place == self.size - 1
        self.floor[key[full]] = score[full]


def _tiles(batches: Iterator[pd.DataFrame], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, len(batch), CANDIDATE_TILE):
            part = batch.iloc[at:at + CANDIDATE_TILE]
            yield part["id"].to_numpy(np.int64), part["label"].to_numpy(np.int64), matrix_of(part["x"], width)


def best_positives(rows: DataFrame, anchors, width: int, size: int) -> DataFrame:
    """(anchor, score, id, place) of the ``size`` best other rows of each anchor's label.

    ``anchors`` is a broadcast (ids, labels, matrix); ``anchor`` numbers its rows.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, labels, matrix = anchors.value
        heaps = Heaps(len(ids), size)
        of_label = {v: np.flatnonzero(labels == v) for v in np.unique(labels).tolist()}
        for own, label, x in _tiles(batches, width):
            for v in np.intersect1d(label, labels).tolist():
                mine = np.flatnonzero(label == v)
                for at in range(0, len(of_label[v]), ANCHOR_TILE):
                    rows_of = of_label[v][at:at + ANCHOR_TILE]
                    scores = strassen(matrix[rows_of], np.ascontiguousarray(x[mine].T))
                    good = (scores >= heaps.floor[rows_of][:, None]) & (ids[rows_of][:, None] != own[mine])
                    i, j = np.nonzero(good)
                    heaps.add(rows_of[i], scores[i, j], own[mine][j])
        yield pd.DataFrame({"anchor": heaps.key, "score": heaps.score, "id": heaps.id})

    found = rows.mapInPandas(find, "anchor long, score long, id long")
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= size)


def best_in_windows(rows: DataFrame, anchors, windows, width: int, size: int) -> DataFrame:
    """(window, score, id, rank) of the ``size`` best rows of another label inside each window.

    ``windows`` is a broadcast (anchor, low, high), ascending by anchor;
    ``window`` numbers its rows.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, labels, matrix = anchors.value
        anchor, low, high = windows.value
        heaps = Heaps(len(anchor), size)
        for own, label, x in _tiles(batches, width):
            turned = np.ascontiguousarray(x.T)
            for at in range(0, len(labels), ANCHOR_TILE):
                end = min(at + ANCHOR_TILE, len(labels))
                scores = strassen(matrix[at:end], turned)
                other = labels[at:end, None] != label
                first, last = np.searchsorted(anchor, [at, end])
                keys, values, ids = [], [], []
                for w in range(first, last):
                    s = scores[anchor[w] - at]
                    j = np.flatnonzero((s >= max(low[w], heaps.floor[w])) & (s <= high[w]) & other[anchor[w] - at])
                    keys.append(np.full(len(j), w))
                    values.append(s[j])
                    ids.append(own[j])
                if keys:
                    heaps.add(np.concatenate(keys), np.concatenate(values), np.concatenate(ids))
        yield pd.DataFrame({"window": heaps.key, "score": heaps.score, "id": heaps.id})

    found = rows.mapInPandas(find, "window long, score long, id long")
    best = Window.partitionBy("window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= size)


def vectors_of(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """(id, label, x) of the rows that have a label and a vector of finite entries, x as floor(256 * entry)."""
    vector = F.col(vector_column)
    return df.filter(F.col(label_column).isNotNull() & usable(vector)).select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("id"), F.col(label_column).cast("long").alias("label"), quantised(vector).alias("x"))


SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, is_anchor, positives: int = 5, negatives: int = 10, low_percent: int = 30, high_percent: int = 90, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """Hard negatives of each anchor and positive, at most ``negatives`` each.

    rows: (id, label, x). Every row whose id is in ``is_anchor`` (a column over
    ``id``) is an anchor of its own, repeated rows included. Its positives are
    the best rows of its label with another id; its negatives are the best
    rows of other labels with low * positive score <= 100 * score <= high *
    positive score. Repeated rows each take their place in a heap; null ids
    come last among ties. Shorter vectors are taken to end in zeros. Scores
    are longs and wrap around beyond their range. No rows, no anchor or no
    positive give no result.
    """
    spark = rows.sparkSession
    rows = stage(rows, "negatives-rows")
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    anchors = stage(rows.filter(is_anchor).orderBy("id", "label", "x"), "negatives-anchors")
    wave = max(wave_bytes // (8 * max(width, 1)), 1)
    total = anchors.count()
    if not total or not width:
        return spark.createDataFrame([], SCHEMA)
    waves = -(-total // wave)
    # anchors of one wave share a range of ids or, where ids repeat, of the hash of the row
    anchors = stage(anchors.withColumn("wave", F.pmod(F.xxhash64("id", "label", "x"), F.lit(waves))), "negatives-waves") if waves > 1 else anchors.withColumn("wave", F.lit(0))
    found = None
    for number in range(waves):
        part = _mine_wave(rows, anchors.filter(F.col("wave") == number).drop("wave"), width, positives, negatives, low_percent, high_percent)
        if part is not None:
            found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], SCHEMA) if found is None else found


def _mine_wave(rows: DataFrame, anchors: DataFrame, width: int, positives: int, negatives: int, low_percent: int, high_percent: int) -> DataFrame | None:
    """Results of one wave of anchors, whose size the wave bounds."""
    spark = rows.sparkSession
    table = anchors.orderBy("id", "label", "x").toArrow()
    if not table.num_rows:
        return None
    own = table["id"].to_numpy()
    column = table["x"].combine_chunks()
    sent = spark.sparkContext.broadcast((own, table["label"].to_numpy(), matrix_of(column, width)))
    chosen = best_positives(rows, sent, width, positives).orderBy("anchor", "place").toArrow()
    if not chosen.num_rows:
        return None
    anchor, score = chosen["anchor"].to_numpy(), chosen["score"].to_numpy()
    # 100 * s is compared with multiples of the positive score: the bounds are whole numbers
    low = np.array([-(-low_percent * int(s) // 100) for s in score], object)
    high = np.array([high_percent * int(s) // 100 for s in score], object)
    span = spark.sparkContext.broadcast((anchor, low.astype(np.int64), high.astype(np.int64)))
    windows = pd.DataFrame({"window": np.arange(len(anchor)), "anchor_id": own[anchor], "positive_id": chosen["id"].to_numpy(), "positive_score": score})
    named = F.broadcast(spark.createDataFrame(windows))  # positives rows for each anchor of the wave
    best = stage(best_in_windows(rows, sent, span, width, negatives), "negatives-found").join(named, "window")

    def back(c: str):
        return F.when(F.col(c) != NO_ID, F.col(c)).alias(c)

    return best.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).select(
        back("anchor_id"), back("positive_id"), "rank", back("negative_id"), "positive_score", "negative_score")
