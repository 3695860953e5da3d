"""Language identification by segmentation-marginalised unigrams.

Every language has its own piece probabilities over one fixed public
vocabulary. A word's probability is the sum over all its segmentations into
pieces, by a forward algorithm that runs over all words of one length and all
languages at once. Piece probabilities are fitted by expectation
maximisation, with expected counts from the same lattice, on a bounded sample
of labelled rows; prediction reads every word of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from newsloom.llm.common import blocks, release_memory, stage
from newsloom.llm.pieces import MODEL_PATH, by_length, pieces

UNKNOWN = "und"
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*+")  # letters with their marks; number signs are no letters
SAMPLE_ROWS = 1000  # expected number of labelled rows per language that the fit reads, whole
ROUNDS = 2  # of expectation maximisation
SMOOTHING = 0.1  # added to each expected count
UNKNOWN_CHAR = 1e-9  # probability of a character that is no piece, in each language
CACHE_WORDS = 60_000  # scored words a worker remembers,
CACHE_SCORES = 2_000_000  # and scores: with many languages, fewer words


@dataclass(frozen=True)
class Model:
    languages: list[str]
    probabilities: np.ndarray  # (pieces + 2, languages); the last two rows: no piece (0), unknown character
    path: str = MODEL_PATH


def words_of(text: str) -> list[str]:
    """Runs of letters of the whole text, in lower case."""
    return WORD.findall(text.lower())


def _with_rows(p: np.ndarray) -> np.ndarray:
    k = p.shape[1]
    return np.vstack([p, np.full((1, k), UNKNOWN_CHAR), np.zeros((1, k))])


def _lattice(vocabulary, codes: np.ndarray) -> np.ndarray:
    """Piece rows of every (end, length); a single character that is no piece gets the unknown row (-2)."""
    found = vocabulary.lattice(codes)
    first = found[:, 1:, 0]
    first[first == -1] = -2
    return found


def forward(gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward values (n, ends, languages) and the log probability (n, languages).

    gain: (n, ends, lengths, languages) piece probabilities.
    """
    n, ends, m, k = gain.shape
    alpha = np.zeros((n, ends, k))
    alpha[:, 0] = 1.0
    log = np.zeros((n, k))
    for end in range(1, ends):
        span = min(m, end)
        alpha[:, end] = np.einsum("nlk,nlk->nk", alpha[:, end - span:end][:, ::-1], gain[:, end, :span])
        if end % 8 == 0:  # keep a long word's values in range
            scale = alpha[:, end].copy()
            alpha[:, max(0, end - m + 1):end + 1] /= scale[:, None]
            log += np.log(scale)
    return alpha, log + np.log(alpha[:, -1])


def score_words(model: Model, words: list[str]) -> np.ndarray:
    """(words, languages) log probabilities, each word with a leading space as its first character."""
    vocabulary = pieces(model.path)
    out = np.zeros((len(words), len(model.languages)))
    marked = [" " + w for w in words]
    for where, codes in by_length(marked, vocabulary.max_length * len(model.languages)):
        out[where] = forward(model.probabilities[_lattice(vocabulary, codes)])[1]
    return out


def expected_counts(model: Model, words: list[str], language: int, weights: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece in the weighted words, over all segmentations."""
    vocabulary = pieces(model.path)
    total = np.zeros(len(vocabulary.strings))
    p = model.probabilities[:, language]
    marked = [" " + w for w in words]
    for where, codes in by_length(marked, vocabulary.max_length * 3):
        found = _lattice(vocabulary, codes)
        n, ends, m = found.shape
        gain = p[found]
        alpha, beta = np.zeros((n, ends)), np.zeros((n, ends))
        alpha[:, 0], beta[:, -1] = 1.0, 1.0
        log_a, log_b = np.zeros((n, ends)), np.zeros((n, ends))  # scale of each column, so long words stay in range
        for end in range(1, ends):
            span = min(m, end)
            level = log_a[:, end - 1]
            past = alpha[:, end - span:end][:, ::-1] * np.exp(log_a[:, end - span:end][:, ::-1] - level[:, None])
            value = (past * gain[:, end, :span]).sum(axis=1)
            alpha[:, end], log_a[:, end] = 1.0, level + np.log(value)
        for start in range(ends - 2, -1, -1):
            span = min(m, ends - 1 - start)
            level = log_b[:, start + 1]
            steps = np.arange(1, span + 1)
            coming = beta[:, start + steps] * np.exp(log_b[:, start + steps] - level[:, None])
            value = (coming * gain[:, start + steps, steps - 1]).sum(axis=1)
            beta[:, start], log_b[:, start] = 1.0, level + np.log(value)
        for length in range(1, m + 1):
            here = np.arange(length, ends)
            share = np.exp(log_a[:, here - length] + log_b[:, here] - log_a[:, -1:]) * gain[:, here, length - 1]
            used = found[:, here, length - 1]
            known = used >= 0
            total += np.bincount(used[known], (share * weights[where][:, None])[known], len(total))
    return total


def _word_counts(df: DataFrame, text_column: str, label_column: str) -> DataFrame:
    """(label, word, n) over whole texts, counted in the task before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for label, texts in batch.groupby("label")["text"]:
                seen = pd.Series([w for t in texts for w in words_of(t)], dtype=object).value_counts()
                yield pd.DataFrame({"label": label, "word": seen.index.astype(object), "n": seen.to_numpy(np.int64)})

    rows = df.select(F.col(label_column).alias("label"), F.col(text_column).alias("text")).filter("text is not null")
    return rows.mapInPandas(count, "label string, word string, n long").groupBy("label", "word").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, text_column: str = "text", label_column: str = "lang", id_column: str = "doc_id",
        sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS, path: str = MODEL_PATH) -> Model:
    """Model of the non-null labels of ``labelled``; rows with null text or label teach nothing.

    A label with more than ``sample_rows`` rows is sampled by a hash of the
    id, at a rate that gives that many rows; smaller ones are read in full.
    Every label is learned: the model holds labels x vocabulary doubles.
    """
    labelled = labelled.filter(F.col(label_column).isNotNull() & F.col(text_column).isNotNull())
    counts = labelled.groupBy(F.col(label_column).alias("label")).count().collect()
    vocabulary = pieces(path)
    start = _with_rows(np.repeat((1.0 / (np.argsort(np.argsort(vocabulary.ids)) + 2.0))[:, None], max(len(counts), 1), axis=1))
    start[:-2] /= start[:-2].sum(axis=0)
    languages = sorted(r["label"] for r in counts)
    if not languages:
        return Model([], start[:, :0], path)
    rates = F.create_map(*[F.lit(x) for r in counts for x in (r["label"], min(1.0, sample_rows / r["count"]))])
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_column).cast("string")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    words = stage(_word_counts(labelled.filter(draw < rates[F.col(label_column)]), text_column, label_column), "language-words")

    model = Model(languages, start, path)
    for _ in range(rounds):
        shared = labelled.sparkSession.sparkContext.broadcast(model)  # languages x vocabulary, whatever the input

        def expect(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            current = shared.value
            sums: dict[str, np.ndarray] = {}
            for batch in batches:
                for label, rows in batch.groupby("label"):
                    got = expected_counts(current, rows["word"].tolist(), current.languages.index(label), rows["n"].to_numpy(float))
                    sums[label] = sums.get(label, 0) + got
            for label, got in sums.items():
                used = np.flatnonzero(got)
                yield pd.DataFrame({"label": label, "piece": used.astype(np.int32), "n": got[used]})

        found = words.mapInPandas(expect, "label string, piece int, n double").groupBy("label", "piece").agg(F.sum("n").alias("n"))
        # a row per label, as large as its part of the model
        found = found.groupBy("label").agg(F.collect_list("piece").alias("piece"), F.collect_list("n").alias("n")).toArrow()
        table = np.full((len(vocabulary.strings), len(languages)), SMOOTHING)
        where = {label: i for i, label in enumerate(languages)}
        for label, piece, n in zip(found["label"].to_pylist(), found["piece"], found["n"]):
            table[piece.values.to_numpy(), where[label]] += n.values.to_numpy().round(6)
        model = Model(languages, _with_rows(table / table.sum(axis=0)), path)
    return model


def predict_column(model, text: Column) -> Column:
    """struct(lang, score) of each text; ``model`` is a broadcast Model.

    lang is ``und`` with score 0 where the text is null or has no letter, or
    nothing was learned. score is the posterior probability of the predicted
    language under equal priors; ties go to the first name.
    """

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model.value)
        for batch in batches:
            for block in blocks(batch):
                langs, scores = scorer.predict(block.to_pylist())
                yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])
        del scorer
        release_memory()

    return predict(text)


class Scorer:
    """Predicts lists of texts; new words of a list are scored together, and a bounded number is remembered."""

    def __init__(self, model: Model):
        self.model = model
        self.place: dict[str, int] = {}
        self.table = np.zeros((0, len(model.languages)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                found = words_of(text)
                counts[i] = len(found)
                words += found
        if not self.model.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        if len(self.place) > min(CACHE_WORDS, CACHE_SCORES // len(self.model.languages)):
            self.place, self.table = {}, self.table[:0]
        if new := list(set(words).difference(self.place)):
            self.table = _grown(self.table, len(self.place), score_words(self.model, new))
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        langs, scores, start = [], [], 0
        for n in counts.tolist():
            if not n:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            total = self.table[at[start:start + n]].sum(axis=0)
            start += n
            best = int(total.argmax())
            langs.append(self.model.languages[best])
            scores.append(float(1.0 / np.exp(total - total[best]).sum()))
        return langs, scores


def _grown(table: np.ndarray, used: int, rows: np.ndarray) -> np.ndarray:
    """``table`` with ``rows`` after its first ``used`` rows; room doubles, so copies stay few."""
    if used + len(rows) > len(table):
        bigger = np.zeros((2 * (used + len(rows)), rows.shape[1]))
        bigger[:used] = table[:used]
        table = bigger
    table[used:used + len(rows)] = rows
    return table


def predict(df: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """All columns of ``df`` with lang_pred and score, which replace input columns of these names."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    out = df.withColumn("_language", predict_column(shared, F.col(text_column).cast("string")))
    return out.withColumns({"lang_pred": F.col("_language.lang"), "score": F.col("_language.score")}).drop("_language")


def is_held_out(id_column: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """Whether the row's id falls into the fold that nothing is learned from; a null id counts as an empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold
