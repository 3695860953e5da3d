"""Toxicity by weak supervision.

Many small voters, each a word or a word beginning that a text uses at all or
uses densely, vote for "toxic" or stay silent. A generative label model treats
the true class as hidden: expectation maximisation estimates every voter's
rate in both classes, the silence of all voters and the given label being two
more voters, and the correlations of voters within a class discount those that
say the same thing. A linear classifier is then trained on the posterior
labels and scores whole texts.

The voters are mined, and all models are fitted, on a bounded sample of
labelled rows (``SAMPLE_ROWS`` of each class); every text is scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from newsloom.llm.common import blocks, bounded, release_memory, stage

WORD = re.compile(r"\w+")
SAMPLE_ROWS = 6000  # expected number of labelled rows of each class that the fit reads, whole
SHORTEST, LONGEST = 3, 8  # letters of a word beginning
LONGEST_WORD = 40  # a longer word counts by its beginnings alone
DENSE = 0.008  # share of a text's words from which a voter of the dense kind votes
SATURATED = 64  # a feature's density counts in full at one word of so many
LEAST_SUPPORT = 2  # texts of a class
LEAST_GAIN = 20.0  # twice the log likelihood ratio from which a feature is told from chance
VOTERS = 256
FEATURES = 384
ROUNDS = 12  # of expectation maximisation before and after the correlations
SMOOTHING = 0.5
LABEL_ERRORS = 0.02  # rate of wrong labels that the fit starts from
CACHE_WORDS = 200_000
FLUSH = 400_000  # distinct features a task counts before it hands them on


@dataclass(frozen=True)
class Model:
    weights: dict[str, tuple[float, float]] = field(default_factory=dict)  # feature -> (weight of presence, of density)
    bias: float = 0.0
    voters: tuple = ()  # (feature, level, rate in toxic texts, rate in clean texts, share left by correlations)


def names_of(word: str) -> list[str]:
    """Features of one word: its beginnings, written with a star, and the word itself."""
    found = [f"{word[:n]}*" for n in range(SHORTEST, min(len(word) - 1, LONGEST) + 1)]
    return found if len(word) > LONGEST_WORD else [*found, word]


def features_of(text: str | None) -> tuple[Counter, int]:
    """How often each feature stands in the whole text, and its number of words."""
    words = WORD.findall((text or "").lower())
    counts: Counter = Counter()
    for word, n in Counter(words).items():
        for name in names_of(word):
            counts[name] += n
    return counts, len(words)


def labels_by_id(labels: DataFrame, id_column: str, label_column: str) -> DataFrame:
    """One row per id: 1 where at least half of its labels are 1; null ids and labels say nothing."""
    rows = labels.filter(F.col(id_column).isNotNull() & F.col(label_column).isNotNull())
    return rows.groupBy(F.col(id_column).alias("_id")).agg((F.avg(F.col(label_column).cast("double")) >= 0.5).cast("int").alias("_y"))


def _sample(documents: DataFrame, known: DataFrame, id_column: str, text_column: str, rows: int) -> tuple[DataFrame, dict[int, float]]:
    """(id, y, text) of the drawn labels, and the weight of a row of each class.

    A label is drawn by a hash of its id. Of several rows of one id the
    smallest text is read, so the sample has one row per drawn id.
    """
    totals = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    rates = {y: min(1.0, rows / n) for y, n in totals.items()}
    if not rates:
        return None, {}
    draw = F.pmod(F.xxhash64(F.lit("toxic"), F.col("_id").cast("string")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rate = F.create_map(*[F.lit(x) for y, r in rates.items() for x in (y, r)])[F.col("_y")]
    drawn = bounded(stage(known.filter(draw < rate), "toxicity-labels"))
    texts = documents.select(F.col(id_column).alias("_id"), F.col(text_column).cast("string").alias("text")).join(drawn, "_id")
    texts = texts.groupBy("_id", "_y").agg(F.min("text").alias("text")).select(F.col("_id").cast("string").alias("id"), F.col("_y").alias("y"), "text")
    return stage(texts.repartition(texts.sparkSession.sparkContext.defaultParallelism, "id"), "toxicity-sample"), {y: 1 / r for y, r in rates.items()}


def _counted(sample: DataFrame) -> DataFrame:
    """(name, n10, n00, n11, n01): texts of class 1 and 0 that use a feature at all, then densely."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, list[int]] = {}

        def flushed() -> pd.DataFrame:
            table = np.array(list(seen.values()), np.int64).reshape(-1, 4)
            out = pd.DataFrame({"name": list(seen), **{c: table[:, i] for i, c in enumerate(("n10", "n00", "n11", "n01"))}})
            seen.clear()
            return out

        for batch in batches:
            for y, text in zip(batch["y"], batch["text"]):
                counts, n = features_of(text)
                for name, c in counts.items():
                    row = seen.setdefault(name, [0, 0, 0, 0])
                    row[1 - y] += 1
                    if c >= DENSE * n:
                        row[3 - y] += 1
                if len(seen) > FLUSH:
                    yield flushed()
        yield flushed()

    sums = [F.sum(c).alias(c) for c in ("n10", "n00", "n11", "n01")]
    return sample.mapInPandas(count, "name string, n10 long, n00 long, n11 long, n01 long").groupBy("name").agg(*sums)


def _gain(positive: Column, negative: Column, positives: float, negatives: float) -> Column:
    """Twice the log likelihood ratio of one rate per class against one rate for both."""
    def part(n: Column, expected: Column) -> Column:
        return F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)

    both, rows = positive + negative, positives + negatives
    p, q = F.lit(positives), F.lit(negatives)
    return 2 * (part(positive, both * p / rows) + part(negative, both * q / rows)
                + part(p - positive, (rows - both) * p / rows) + part(q - negative, (rows - both) * q / rows))


def mine(sample: DataFrame, positives: int, negatives: int, features: int = FEATURES) -> list[tuple[str, int, bool, float]]:
    """(name, level, for toxic, gain) of the features that tell the classes apart best; level 1 is the dense kind.

    Of a chain of ever longer beginnings only the best stays, at equal gains
    the longest: one stem doesn't fill the list, and reaches no further than
    the texts show.
    """
    table = stage(_counted(sample), "toxicity-counts").filter(F.greatest("n10", "n00") >= LEAST_SUPPORT)
    gains = table.select("name", *[_gain(F.col(f"n1{i}"), F.col(f"n0{i}"), positives, negatives).alias(f"g{i}") for i in (0, 1)],
                         *[(F.col(f"n1{i}") * negatives > F.col(f"n0{i}") * positives).alias(f"toxic{i}") for i in (0, 1)])
    dense = F.col("g1") > F.col("g0")
    gains = gains.select("name", dense.cast("int").alias("level"), F.when(dense, F.col("toxic1")).otherwise(F.col("toxic0")).alias("toxic"), F.greatest("g0", "g1").alias("gain"))
    gains = gains.filter(F.col("gain") >= LEAST_GAIN)
    letters = F.length(F.regexp_replace("name", r"\*$", ""))
    parent = F.when(letters > SHORTEST, F.concat(F.substring("name", 1, F.least(letters - 1, F.lit(LONGEST))), F.lit("*")))
    gains = gains.withColumn("parent", parent)
    above = gains.select(F.col("name").alias("parent"), F.col("gain").alias("parent_gain"))
    below = gains.groupBy(F.col("parent").alias("name")).agg(F.max("gain").alias("child_gain"))
    own = gains.join(above, "parent", "left").join(below, "name", "left").filter(
        (F.coalesce("parent_gain", F.lit(0.0)) <= F.col("gain")) & (F.coalesce("child_gain", F.lit(0.0)) < F.col("gain")))
    best = own.orderBy(F.desc("gain"), "name").limit(features).select("name", "level", "toxic", "gain").collect()
    return [(r["name"], r["level"], r["toxic"], r["gain"]) for r in best]


def values_of(text: str | None, place: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Presence and saturated density of the features of ``place`` in the whole text."""
    present, density = np.zeros(len(place)), np.zeros(len(place))
    counts, n = features_of(text)
    for name in counts.keys() & place.keys():
        present[place[name]] = 1.0
        density[place[name]] = min(1.0, SATURATED * counts[name] / n)
    return present, density


def _summed(df: DataFrame, size: int, part: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    """Sum over all batches of ``part``, an array of ``size`` doubles: one row from each task."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                total += part(batch)
        yield pd.DataFrame({"v": [total.tolist()]})

    return np.sum([r["v"] for r in df.mapInPandas(add, "v array<double>").collect()] or [np.zeros(size)], axis=0)


class LabelModel:
    """Rates of the voters in both classes, the prior, and what correlations leave of each vote."""

    def __init__(self, voters: int, prior: float):
        self.a = np.full(voters + 2, 0.5)  # of each voter in toxic texts; then of silence and of the label 1
        self.b = np.full(voters + 2, 0.5)
        self.share = np.ones(voters + 2)
        self.correlation = np.eye(voters)  # of the voters in toxic texts, where positive
        self.prior = prior

    def odds(self, votes: np.ndarray) -> np.ndarray:
        """Log odds of toxic. votes: (rows, voters + 2) of 0 and 1; a voter's 0 is no vote, a label's 0 is a vote for clean."""
        odds = np.log(self.prior / (1 - self.prior)) + votes[:, :-1] @ (self.share[:-1] * np.log(self.a[:-1] / self.b[:-1]))
        label = votes[:, -1]
        return odds + np.where(label == 1, np.log(self.a[-1] / self.b[-1]), np.log((1 - self.a[-1]) / (1 - self.b[-1])))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return _sigmoid(self.odds(votes))

    def by_others(self, votes: np.ndarray) -> np.ndarray:
        """(rows, voters): P(toxic) without what each voter, and others as far as they are correlated with it, have said."""
        voters = len(self.correlation)
        said = votes[:, :voters] * (self.share[:voters] * np.log(self.a[:voters] / self.b[:voters]))
        return _sigmoid(self.odds(votes)[:, None] - said @ self.correlation)


def _sigmoid(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def _votes(batch: pd.DataFrame) -> np.ndarray:
    return np.stack(batch["votes"].to_numpy()).astype(float)


def fit_label_model(rows: DataFrame, voters: int, prior: float, rounds: int = ROUNDS) -> LabelModel:
    """rows: votes array<byte> (voters, then silence, then the label) and weight of each sampled text.

    Each round is one pass over the rows, whose tasks give sums alone. A
    voter's rates are taken from what the label and the other voters say of
    its texts, so that no voter, nor two that say the same, confirm themselves.
    """
    model, size = LabelModel(voters, prior), voters + 2
    model.a[-1], model.b[-1] = 1 - LABEL_ERRORS, LABEL_ERRORS * prior / (1 - prior)

    def step(current: LabelModel, first: bool) -> None:
        def part(batch: pd.DataFrame) -> np.ndarray:
            votes, w = _votes(batch), batch["weight"].to_numpy()
            known = votes * ([0.0] * (size - 1) + [1.0]) if first else votes  # at first the label speaks alone
            q, others = current.posterior(known), current.by_others(known)
            heard = w[:, None] * votes[:, :voters]
            last = votes[:, voters:]
            return np.concatenate([(heard * others).sum(axis=0), (w * q) @ last, (heard * (1 - others)).sum(axis=0), (w * (1 - q)) @ last, [(w * q).sum(), w.sum()]])

        got = _summed(rows, 2 * size + 2, part)
        toxic, every = got[-2], got[-1]
        a = (got[:size] + SMOOTHING) / (toxic + 2 * SMOOTHING)
        b = (got[size:2 * size] + SMOOTHING) / (every - toxic + 2 * SMOOTHING)
        current.prior = float(np.clip(toxic / every, 1e-6, 1 - 1e-6))
        current.a, current.b = np.clip(a, 1e-9, 1 - 1e-9), np.clip(b, 1e-9, 1 - 1e-9)

    def correlate(current: LabelModel) -> None:
        def part(batch: pd.DataFrame) -> np.ndarray:
            votes, w = _votes(batch), batch["weight"].to_numpy()
            q = current.posterior(votes)
            v = votes[:, :voters]
            return np.concatenate([(v.T @ (v * (w * q)[:, None])).ravel(), [(w * q).sum()]])

        got = _summed(rows, voters * voters + 1, part)
        a = current.a[:voters]
        covariance = got[:-1].reshape(voters, voters) / max(got[-1], 1e-9) - np.outer(a, a)
        spread = np.sqrt(np.maximum(a * (1 - a), 1e-12))
        correlation = np.clip(covariance / np.outer(spread, spread), 0, 1)
        np.fill_diagonal(correlation, 1.0)
        current.correlation = correlation
        current.share[:voters] = 1 / correlation.sum(axis=1)

    step(model, True)
    for _ in range(rounds):
        before = np.concatenate([model.a, model.b])
        step(model, False)
        correlate(model)
        if np.abs(np.concatenate([model.a, model.b]) - before).max() < 1e-4:
            break
    return model


def fit(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
        sample_rows: int = SAMPLE_ROWS, voters: int = VOTERS, features: int = FEATURES) -> Model:
    """Model of the labels of ``labels`` that belong to rows of ``documents``.

    Without labels every score is 0; where nothing tells the classes apart,
    or all labels are of one class, every score is the smoothed share of
    toxic labels.
    """
    sample, weights = _sample(documents, labels_by_id(labels, id_column, label_column), id_column, text_column, sample_rows)
    if sample is None:
        return Model(bias=-np.inf)
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    positives, negatives = sizes.get(1, 0), sizes.get(0, 0)
    if not positives + negatives:
        return Model(bias=-np.inf)
    p, q = positives * weights.get(1, 1.0) + SMOOTHING, negatives * weights.get(0, 1.0) + SMOOTHING
    prior = p / (p + q)
    known = mine(sample, positives, negatives, features) if positives and negatives else []
    chosen = [(name, level) for name, level, toxic, _ in known if toxic][:voters]
    if not chosen:
        return Model(bias=float(np.log(prior / (1 - prior))))
    place = {name: i for i, (name, *_) in enumerate(known)}

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, level = np.array([place[n] for n, _ in chosen]), np.array([lv for _, lv in chosen])
        for batch in batches:
            out: dict[str, list] = {"votes": [], "weight": [], "values": []}
            for y, text in zip(batch["y"], batch["text"]):
                present, density = values_of(text, place)
                votes = np.where(level == 1, density[at] >= DENSE * SATURATED, present[at] > 0)
                out["votes"].append([*votes.astype(int).tolist(), int(not votes.any()), int(y)])
                out["weight"].append(weights[y])
                out["values"].append(np.concatenate([present, density]).tolist())
            yield pd.DataFrame(out)

    rows = stage(sample.mapInPandas(look, "votes array<tinyint>, weight double, values array<double>"), "toxicity-votes")
    model = fit_label_model(rows.select("votes", "weight"), len(chosen), prior)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                q = model.posterior(_votes(batch))
                yield pd.DataFrame({"values": [*batch["values"], *batch["values"]], "label": np.repeat([1.0, 0.0], len(q)),
                                    "weight": np.concatenate([q, 1 - q]) * np.tile(batch["weight"], 2)})

    taught = rows.mapInPandas(label, "values array<double>, label double, weight double").filter("weight > 0.001")
    taught = taught.select(array_to_vector("values").alias("features"), "label", "weight")
    line = LogisticRegression(weightCol="weight", regParam=2e-5, standardization=False, maxIter=60).fit(taught)
    w = np.round(line.coefficients.toArray(), 6).reshape(2, -1)
    kept = {name: (float(w[0, i]), float(w[1, i])) for name, i in place.items() if np.abs(w[:, i]).max() > 1e-4}
    return Model(kept, round(float(line.intercept), 6), tuple((*c, float(model.a[i]), float(model.b[i]), float(model.share[i])) for i, c in enumerate(chosen)))


class Scorer:
    """Scores texts one by one; remembers which features a word has, for a bounded number of words."""

    def __init__(self, model: Model):
        self.weights, self.bias = model.weights, model.bias
        self.known: dict[str, list[str] | None] = {}

    def _features(self, word: str) -> list[str] | None:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        found = self.known[word] = [n for n in names_of(word) if n in self.weights] or None
        return found

    def score(self, text: str | None) -> float:
        words = WORD.findall((text or "").lower())
        known, counts = self.known, {}
        for word in words:
            found = known[word] if word in known else self._features(word)
            if found:
                for name in found:
                    counts[name] = counts.get(name, 0) + 1
        odds = self.bias
        for name in sorted(counts):
            present, density = self.weights[name]
            odds += present + density * min(1.0, SATURATED * counts[name] / len(words))
        return float(1 / (1 + np.exp(-min(max(odds, -500.0), 500.0))))


def score(df: DataFrame, model: Model, text_column: str = "text", threshold: float = 0.7) -> DataFrame:
    """All columns of ``df`` with score (0 to 1) and predicted (1 from ``threshold`` on), which replace columns of these names.

    Null and empty texts get the score of a text without any feature. Rows
    with a null or repeated id are scored like all others; an empty table
    gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for block in blocks(batch):
                yield pa.array([scorer.score(t) for t in block.to_pylist()], pa.float64())
        del scorer
        release_memory()

    out = df.withColumn("score", scored(F.col(text_column).cast("string")))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
