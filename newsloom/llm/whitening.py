"""Embedding whitening by incremental eigendecomposition.

Every partition of the fit list keeps the eigendecomposition of its scatter
and takes in each vector by a centred rank-one update: the eigenvalues of
D + z z' are the roots of a secular equation, found for all eigenvalues at
once after deflation. The partitions' spectra are combined in a tree, again by
successive rank-one updates. A distributed Rayleigh-Ritz step over the exact
fit list then refines the basis to double precision.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from newsloom.llm.common import stage

SCALE = 256  # an entry c becomes floor(SCALE * c)
VECTORS_PER_TASK = 4096  # of the fit list
FAN_IN = 16  # partial results that one task merges
LEAST_SHARE = 1e-13  # of the largest eigenvalue: components below have no spread to be whitened by
EPS = np.finfo(float).eps
LONG = 2 ** 63 - 1
ROWS = 1000  # of a batch that are handled at once


# ---- integer vectors

def usable(vector: Column) -> Column:
    """Whether a vector is there and has finite entries only."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * c) of each entry, as longs (the nearest long where it is beyond)."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))


def matrix_of(lists: pa.Array | pd.Series, width: int) -> np.ndarray:
    """(rows, width) longs; shorter vectors end in zeros."""
    if isinstance(lists, pd.Series):
        lists = pa.array(lists.tolist(), pa.list_(pa.int64()))
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == width).all():
        return flat.reshape(len(lists), width)
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


# ---- rank-one updates

def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum z2 / (d - mu) = 0, as (number of the nearest pole, distance from it).

    d ascends strictly and z2 is positive: root j lies between d[j] and
    d[j + 1], the last one below d[-1] + sum(z2). All roots advance together:
    each step replaces the two sides of the sum by one fraction per neighbour
    pole, and falls back to halving where that leaves the bracket.
    """
    k = len(d)
    right = np.append(d[1:], d[-1] + z2.sum())
    gap = right - d
    middle = d + gap / 2
    f = 1 + (z2 / (d - middle[:, None])).sum(axis=1)
    left_half = (f > 0) | (np.arange(k) == k - 1)
    base = np.where(left_half, np.arange(k), np.minimum(np.arange(k) + 1, k - 1))
    delta = d - d[base][:, None]  # poles as seen from each root's base
    low = np.where(left_half, 0.0, -gap / 2)
    high = np.where(left_half, np.where(np.arange(k) == k - 1, gap, gap / 2), 0.0)
    tau = (low + high) / 2
    below = np.tri(k)
    above = 1.0 - below
    last = np.arange(k) == k - 1
    next_pole = np.append(delta[np.arange(k - 1), np.arange(1, k)], 0.0)
    own_pole = delta[np.arange(k), np.arange(k)]
    for _ in range(60):
        gaps = delta - tau[:, None]
        terms = z2 / gaps
        slopes = terms / gaps
        psi, phi = np.einsum("ij,ij->i", terms, below), np.einsum("ij,ij->i", terms, above)
        f = 1 + psi + phi
        left = f < 0
        low, high = np.where(left, tau, low), np.where(left, high, tau)
        done = np.abs(f) <= 4 * k * EPS * (1 - psi + phi)
        if done.all() or (high - low <= EPS * np.maximum(-low, high)).all():
            break
        psi1, phi1 = np.einsum("ij,ij->i", slopes, below), np.einsum("ij,ij->i", slopes, above)
        # psi ~ r + s / (own - t), phi ~ u + v / (next - t) with the values and slopes found here;
        # the step x solves c + s / (own - x) + v / (next - x) = 0, for the last root without v
        own, following = own_pole - tau, next_pole - tau
        s, v = psi1 * own ** 2, phi1 * following ** 2
        c = f - psi1 * own - phi1 * following
        b, q = c * (own + following) + s + v, c * own * following + s * following + v * own
        root = np.sqrt(np.maximum(b * b - 4 * c * q, 0.0))
        with np.errstate(all="ignore"):
            step = np.where(b < 0, 2 * q / (b - root), (b + root) / (2 * c))
            other = np.where(b < 0, (b - root) / (2 * c), 2 * q / (b + root))
            step[-1] = own[-1] + s[-1] / c[-1]
        tried = tau + step
        bad = ~((tried > low) & (tried < high))
        if bad.any():
            second = tau + other
            tried = np.where(bad, np.where((second > low) & (second < high) & ~last, second, (low + high) / 2), tried)
        tau = np.where(done, tau, tried)
    return base, tau


def rank_one(values: np.ndarray, vectors: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigendecomposition of V diag(values) V' + x x'; values ascend, vectors are columns."""
    z = vectors.T @ x
    size = max(np.abs(values).max(initial=0.0), float(z @ z))
    if size == 0.0:
        return values, vectors
    tolerance = 8 * EPS * size
    # deflation: equal eigenvalues are turned so that one of them keeps all of z
    for i in np.flatnonzero(np.diff(values) <= tolerance):
        r = np.hypot(z[i], z[i + 1])
        if z[i] == 0.0 or r == 0.0:
            continue
        c, s = z[i + 1] / r, z[i] / r
        z[i], z[i + 1] = 0.0, r
        vectors[:, [i, i + 1]] = np.column_stack([c * vectors[:, i] - s * vectors[:, i + 1], s * vectors[:, i] + c * vectors[:, i + 1]])
    # deflation: an eigenvector that x doesn't touch stays as it is
    live = np.flatnonzero(np.abs(z) * np.sqrt(size) > tolerance)
    if not len(live):
        return values, vectors
    d = values[live].copy()
    for i in range(1, len(d)):  # rounding left them equal although both touch x
        if d[i] <= d[i - 1]:
            d[i] = np.nextafter(d[i - 1], np.inf)
    base, tau = secular_roots(d, z[live] ** 2)
    away = (d - d[base][:, None]) - tau[:, None]  # (root, pole): d - mu without cancellation
    # the z that has these roots exactly: its vectors are orthogonal to working precision
    between = d[:, None] - d
    k = len(d)
    np.fill_diagonal(between, 1.0)
    hat = np.sqrt(np.abs(np.prod(away / between.T, axis=0))) * np.sign(z[live])
    away = np.where(away == 0.0, np.finfo(float).tiny, away)
    turn = hat[:, None] / away.T
    turn /= np.sqrt((turn * turn).sum(axis=0))
    values, vectors = values.copy(), vectors.copy()
    values[live] = d[base] + tau
    vectors[:, live] = vectors[:, live] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Count, mean and eigendecomposition of the scatter of the vectors taken in so far."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def empty(width: int) -> Spectrum:
        return Spectrum(0, np.zeros(width), np.zeros(width), np.eye(width))

    def add(self, x: np.ndarray) -> None:
        away = x - self.mean
        if self.n:
            self.values, self.vectors = rank_one(self.values, self.vectors, away * np.sqrt(self.n / (self.n + 1)))
        self.n += 1
        self.mean = self.mean + away / self.n

    def merge(self, other: Spectrum) -> Spectrum:
        """Both scatters and the spread between the means, one update per eigenvector of ``other``."""
        if not self.n or not other.n:
            return self if self.n else other
        n = self.n + other.n
        values, vectors = self.values, self.vectors
        between = (other.mean - self.mean) * np.sqrt(self.n * other.n / n)
        for x in [between, *(other.vectors * np.sqrt(np.maximum(other.values, 0.0))).T]:
            values, vectors = rank_one(values, vectors, x)
        return Spectrum(n, self.mean + (other.mean - self.mean) * (other.n / n), values, vectors)


# ---- distributed sums

def gathered(df: DataFrame, start: Callable[[], object], take: Callable, merge: Callable, fan_in: int = FAN_IN):
    """``take`` folds batches of the integer column x into one value per task; ``merge`` joins values.

    Tasks' values are merged ``fan_in`` at a time, level by level, each level a
    written table: no task or driver holds more than that many. None if there
    are no rows.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        value, any_row = start(), False
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                value, any_row = take(value, batch["x"].iloc[at:at + ROWS]), True
        if any_row:
            yield pd.DataFrame({"task": [TaskContext.get().partitionId()], "value": [pickle.dumps(value)]})

    def join(group: pd.DataFrame) -> pd.DataFrame:
        values = group.sort_values("task")["value"].map(pickle.loads)
        return pd.DataFrame({"task": [int(group["task"].min()) // fan_in], "value": [pickle.dumps(reduce(merge, values))]})

    level = stage(df.select("x").mapInPandas(fold, "task long, value binary"), "whitening-level")
    while (left := level.count()) > fan_in:
        numbered = level.withColumn("group", (F.col("task") / fan_in).cast("long"))
        level = stage(numbered.groupBy("group").applyInPandas(lambda g: join(g[["task", "value"]]), "task long, value binary"), "whitening-level")
        if level.count() == left:  # numbers too far apart to meet: they meet by rank
            level = stage(level.withColumn("task", F.pmod(F.xxhash64("task"), F.lit(max(left // 2, 1)))), "whitening-level")
    values = [pickle.loads(r["value"]) for r in level.orderBy("task").collect()]  # at most fan_in
    return reduce(merge, values) if values else None


@dataclass(frozen=True)
class Whitening:
    """n and exact sums of the fit list; components are columns, by falling eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return x - np.array([s / self.n for s in self.sums])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 of each row, exact; None where a long cannot hold it."""
        if not len(x):
            return []
        most = max(max(abs(int(x.min())), abs(int(x.max()))) * self.n, 1) + max(map(abs, self.sums), default=0)
        if most * most * max(x.shape[1], 1) < LONG:
            return ((x * self.n - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        return [v if v <= LONG else None for v in exact]


def spectrum_of(listed: DataFrame, width: int, fan_in: int = FAN_IN) -> Spectrum:
    """The fit list's spectrum by incremental updates: in each task, then between tasks."""

    def take(value: Spectrum, rows: pd.Series) -> Spectrum:
        for x in matrix_of(rows, width).astype(float):
            value.add(x)
        return value

    return gathered(listed, lambda: Spectrum.empty(width), take, Spectrum.merge, fan_in)


def fit(listed: DataFrame, width: int, components: int = 4, fan_in: int = FAN_IN) -> Whitening | None:
    """listed: the fit list, one row per distinct integer vector, in the column x."""

    def total(value, rows: pd.Series):
        x = matrix_of(rows, width)
        wide = np.abs(x).max(initial=0) >= 2 ** 40
        return value[0] + len(x), [a + int(b) for a, b in zip(value[1], x.astype(object).sum(axis=0) if wide else x.sum(axis=0))]

    counted = gathered(listed, lambda: (0, [0] * width), total, lambda a, b: (a[0] + b[0], [x + y for x, y in zip(a[1], b[1])]), fan_in)
    if counted is None or not width:
        return None
    n, sums = counted
    mean = np.array([s / n for s in sums])
    basis = np.linalg.qr(spectrum_of(listed, width, fan_in).vectors)[0]

    def ritz(value: np.ndarray, rows: pd.Series) -> np.ndarray:
        y = (matrix_of(rows, width) - mean) @ basis
        return value + y.T @ y

    projected = gathered(listed, lambda: np.zeros((width, width)), ritz, np.add, fan_in) / n
    values, turn = np.linalg.eigh((projected + projected.T) / 2)  # width x width, nearly diagonal
    values, vectors = values[::-1], basis @ turn[:, ::-1]
    kept = min(components, int((values > max(values[0], 0.0) * LEAST_SHARE).sum()))
    found = Whitening(n, sums, values[:kept], vectors[:, :kept], float(np.trace(projected)), 0.0)

    def second(value, rows: pd.Series):
        w = found.whiten(matrix_of(rows, width))
        return value[0] + w.sum(axis=0), value[1] + w.T @ w

    if not kept:
        return found
    first, square = gathered(listed, lambda: (np.zeros(kept), np.zeros((kept, kept))), second, lambda a, b: (a[0] + b[0], a[1] + b[1]), fan_in)
    error = np.abs(square / n - np.outer(first / n, first / n) - np.eye(kept)).max()
    return Whitening(n, sums, found.values, found.vectors, found.trace, float(error))


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, components: int = 4, id_column: str = "vec_id", vector_column: str = "embedding", vectors_per_task: int = VECTORS_PER_TASK) -> DataFrame:
    """A row per usable vector and component: its exact squared deviation and its whitened coordinate.

    Vectors that are null or hold a null, NaN or infinite entry give no rows.
    Shorter vectors are taken to end in zeros. Null and repeated ids keep
    their rows; equal vectors count once in the fit. Components whose variance
    is 0 to working precision cannot be whitened by and give no rows, so a
    single distinct vector, empty vectors and an empty table give none. Ties
    of eigenvalues take any basis of their space. Other columns are not read.
    """
    spark = df.sparkSession
    vector = F.col(vector_column)
    rows = stage(df.filter(usable(vector)).select(F.col(id_column).cast("long").alias("vec_id"), quantised(vector).alias("x")), "whitening-rows")
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    # shorter vectors become equal to what they are taken for before the list is made distinct
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))
    listed = stage(rows.select(padded.alias("x")).distinct(), "whitening-list")
    # the updates are heavy work on few bytes: deal them by count, not by size
    listed = stage(listed.repartition(max(-(-listed.count() // vectors_per_task), 1), "x"), "whitening-fit")
    model = fit(listed, width, components)
    if model is None or not len(model.values):
        return spark.createDataFrame([], SCHEMA)
    shared = spark.sparkContext.broadcast(model)  # components x dimensions

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        k = len(m.values)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.iloc[at:at + ROWS]
                x = matrix_of(part["x"], width)
                yield pd.DataFrame({
                    "vec_id": np.repeat(part["vec_id"].astype("Int64").array, k), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), "n": m.n,
                    "deviation": np.repeat(pd.array(m.deviations(x), "Int64"), k), "whitened": m.whiten(x).ravel(),
                    "explained": np.tile(m.values / m.trace, len(x)), "identity_error": m.identity_error})

    return rows.mapInPandas(project, SCHEMA)
