"""Toxicity, whitening and hard negatives: brute force, held-out accuracy, and the odd cases."""

import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from newsloom.llm import hard_negatives, language_id, toxicity, whitening
from newsloom.llm.common import new_stage_path
from newsloom.llm.queries import QUERIES

# the smallest scale has too few labelled rows of a language to learn its words from
DATA = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


# ---- toxicity

def labelled(rng, n):
    """Texts of two made-up languages; toxic ones use a word of their language's stem often, clean ones may use it once."""
    out = []
    for i in range(n):
        stem, rest = ("grob", ["alo", "beno", "cari", "dusu"]) if i % 2 else ("mist", ["xara", "yolo", "zeta", "wiru"])
        words = [rng.choice(rest) + rng.choice("abcd") for _ in range(rng.randint(20, 200))]
        toxic = i % 5 == 0
        for _ in range(max(3, len(words) // 40) if toxic else int(len(words) > 150)):
            words.insert(rng.randrange(len(words)), stem + rng.choice(["", "en", "isch"]))
        out.append((i, " ".join(words), int(toxic) if rng.random() > 0.02 else int(not toxic), int(toxic)))
    return out


@pytest.fixture(scope="module")
def toxic_model(spark):
    rows = labelled(random.Random(1), 1200)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    return toxicity.fit(docs, labels)


def test_toxicity_sees_through_wrong_labels(spark, toxic_model):
    rows = labelled(random.Random(2), 600)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, toxic_model).collect()}
    assert sum(got[i] == truth for i, *_, truth in rows) >= 0.97 * len(rows)


def test_voters_and_their_correlations(toxic_model):
    assert {"grob", "mist"} <= {v[0].rstrip("*")[:4] for v in toxic_model.voters}
    for _, _, a, b, share in toxic_model.voters:
        assert 0 < b < a < 1 and 0 < share <= 1


def test_label_model_on_drawn_votes(spark):
    """Rates and the discount of a repeated voter, from votes of a known model."""
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    draw = lambda a, b: rng.random(4000) < np.where(y, a, b)
    votes = [draw(0.6, 0.02), draw(0.5, 0.05), draw(0.4, 0.01)]
    votes.append(votes[0])  # the same voter once more
    silence = ~np.any(votes, axis=0)
    label = np.where(rng.random(4000) < 0.05, ~y, y)
    table = np.column_stack([*votes, silence, label]).astype(int)
    rows = spark.createDataFrame([(v.tolist(), 1.0) for v in table], "votes array<tinyint>, weight double")
    model = toxicity.fit_label_model(rows, 4, 0.3)
    # one voter's silence is no evidence to the model, so rates in toxic texts come out somewhat low
    assert model.a[:3] == pytest.approx([0.6, 0.5, 0.4], abs=0.1) and model.b[:3] == pytest.approx([0.02, 0.05, 0.01], abs=0.03)
    assert model.share[0] == pytest.approx(model.share[3]) and model.share[0] < 0.5 < model.share[1]
    assert ((model.posterior(table.astype(float)) > 0.5) == y).mean() > (label == y).mean()


def test_score_by_hand():
    model = toxicity.Model({"bad*": (1.0, 2.0), "worse": (0.5, 0.0)}, -1.0)
    want = -1.0 + 1.0 + 2.0 * min(1, 64 * 2 / 200) + 0.5
    text = "BADly worse badness " + "x " * 197
    assert toxicity.Scorer(model).score(text) == pytest.approx(1 / (1 + np.exp(-want)))
    assert toxicity.Scorer(model).score(None) == toxicity.Scorer(model).score("") == pytest.approx(1 / (1 + np.exp(1.0)))
    assert toxicity.names_of("bad") == ["bad"] and toxicity.names_of("badly") == ["bad*", "badl*", "badly"]
    assert toxicity.names_of("x" * 50)[-1] == "x" * 8 + "*"


def test_toxicity_query(spark):
    truth = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{DATA}/labels.parquet'").fetchall())
    rows = QUERIES["op11_toxicity"](spark, DATA).collect()
    assert len(rows) == duckdb.sql(f"SELECT count(*) FROM '{DATA}/documents.parquet'").fetchall()[0][0]
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(p == y for p, y in held) >= 0.93 * len(held) > 50
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_toxicity_edges(spark):
    schema = "doc_id long, text string, score double, predicted int, y int"
    docs = spark.createDataFrame([(1, "a", 2.0, 7, 1), (1, "b", 2.0, 7, 1), (None, None, None, None, None), (3, "", 0.0, 0, 0), (4, "x" * 300_000, 0.0, 0, 0)], schema)
    none = docs.limit(0)
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (3, 0), (3, 1)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels.limit(0)).bias == -np.inf
    for model in (toxicity.fit(docs, labels), toxicity.fit(none, labels), toxicity.fit(docs, labels.filter("doc_id = 1"))):
        got = toxicity.score(docs, model)
        assert got.columns == ["doc_id", "text", "score", "predicted", "y"] and got.count() == 5
        assert len({r.score for r in got.collect()}) == 1
    assert toxicity.score(none, toxicity.Model()).count() == 0


# ---- whitening

@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(1, 40), st.integers(0, 2**31), st.sampled_from([1, 3, 200]))
def test_rank_one_updates(width, n, seed, spread):
    """Small whole numbers make equal eigenvalues and untouched directions, which deflation must handle."""
    x = np.random.default_rng(seed).integers(-spread, spread + 1, size=(n, width)).astype(float)
    parts = [whitening.Spectrum.empty(width) for _ in range(3)]
    for i, row in enumerate(x):
        parts[i % 3].add(row)
    got = parts[0].merge(parts[1]).merge(parts[2])
    scatter = (x - x.mean(0)).T @ (x - x.mean(0))
    size = max(np.abs(scatter).max(), 1.0)
    assert got.n == n and got.mean == pytest.approx(x.mean(0))
    assert np.abs(got.vectors @ np.diag(got.values) @ got.vectors.T - scatter).max() <= 1e-10 * size * n
    assert np.abs(got.vectors.T @ got.vectors - np.eye(width)).max() <= 1e-10


def brute_whitening(x):
    listed = np.unique(x, axis=0)
    n, sums = len(listed), listed.sum(0)
    values, vectors = np.linalg.eigh(np.cov(listed.T.astype(float), bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    return n, ((n * x - sums) ** 2).sum(1), (x - sums / n) @ vectors[:, :4] / np.sqrt(values[:4]), values[:4] / values.sum()


def test_whitening_query(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SMALL}/embeddings.parquet'").fetchall()
    x = np.floor(256 * np.array([np.float32(v) for _, v in rows]).astype(float)).astype(np.int64)
    n, deviation, white, share = brute_whitening(x)
    got = {(r.vec_id, r.component): r for r in QUERIES["op12_whitening"](spark, SMALL).collect()}
    assert len(got) == 4 * len(rows)
    for i, (vec, _) in enumerate(rows):
        for k in range(4):
            r = got[vec, k + 1]
            assert (r.n, r.deviation) == (n, deviation[i]) and abs(r.whitened) == pytest.approx(abs(white[i, k]), abs=1e-9)
            assert r.explained == pytest.approx(share[k], rel=1e-9) and r.identity_error < 1e-9


def test_many_small_spectra(spark):
    x = np.random.default_rng(4).integers(-50, 50, size=(300, 6))
    table = spark.createDataFrame([(v.tolist(),) for v in x], "x array<bigint>").repartition(40)
    got = whitening.spectrum_of(table, 6, fan_in=2)
    assert got.n == 300 and got.values == pytest.approx(np.linalg.eigvalsh((x - x.mean(0)).T @ (x - x.mean(0))))


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<float>, n long, whitened string"
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [1.0, 0.5]), (None, [-0.5]), (4, [2.0, -1.0])]
    bad = [(5, None), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 0.0])]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in good + bad], schema)
    got = whitening.whiten(table).collect()
    assert len(got) == 2 * len(good) and {r.component for r in got} == {1, 2}
    x = np.array([[0, 256], [0, 256], [256, 128], [-128, 0], [512, -256]])
    n, deviation, white, _ = brute_whitening(x)
    assert n == 4 and {(r.vec_id, r.deviation) for r in got} == {(i, d) for (i, _), d in zip(good, deviation.tolist())}
    assert sorted(abs(r.whitened) for r in got) == pytest.approx(sorted(np.abs(white).ravel()))
    for rows in (bad, [], good[:2], [(1, []), (2, [])]):  # one distinct vector has no spread
        assert whitening.whiten(spark.createDataFrame([(i, v, 1, "x") for i, v in rows], schema)).count() == 0
    huge = whitening.whiten(spark.createDataFrame([(1, [1e30], 1, "x"), (2, [-1e30], 1, "x")], schema)).collect()
    assert [r.deviation for r in huge] == [None, None] and all(abs(abs(r.whitened) - 1) < 1e-9 for r in huge)


# ---- hard negatives

@settings(max_examples=40, deadline=None)
@given(st.integers(1, 80), st.integers(1, 80), st.integers(1, 80), st.integers(0, 2**31))
def test_strassen(m, k, n, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-2**20, 2**20, size=(m, k)), rng.integers(-2**20, 2**20, size=(k, n))
    assert (hard_negatives.strassen(a, b) == a @ b).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-4, 4), st.integers(0, 5)), max_size=60), st.integers(1, 4))
def test_heaps(rows, size):
    heaps = hard_negatives.Heaps(4, size)
    for at in range(0, len(rows), 7):
        heaps.add(*[np.array(c, np.int64) for c in zip(*rows[at:at + 7])])
    want = [r for k in range(4) for r in sorted((x for x in rows if x[0] == k), key=lambda x: (-x[1], x[2]))[:size]]
    assert list(zip(heaps.key.tolist(), heaps.score.tolist(), heaps.id.tolist())) == want


def brute_negatives(rows):
    out = []
    for a, (i, label, x) in enumerate(rows):
        if i is None or i % 100:
            continue
        scored = [(j, lab, int(np.dot(x, y))) for j, lab, y in rows]
        order = lambda r: (-r[2], r[0] if r[0] is not None else 2**63)
        for p in sorted((r for r in scored if r[1] == label and r[0] != i), key=order)[:5]:
            inside = [r for r in scored if r[1] != label and 30 * p[2] <= 100 * r[2] <= 90 * p[2]]
            out += [(i, p[0], k + 1, r[0], p[2], r[2]) for k, r in enumerate(sorted(inside, key=order)[:10])]
    return sorted(out, key=str)


def test_mining_against_brute_force(spark):
    """Ties, repeated rows and ids, null ids, vectors of several lengths, and several waves of anchors."""
    rng = random.Random(3)
    rows = [(rng.choice([i, i, i, 100 * (i // 40)]), rng.randrange(3), [rng.randint(-3, 9) for _ in range(4)]) for i in range(300)]
    rows += [rows[7], (None, 1, [5, 5, 5, 5]), (None, 0, [5, 5, 5, 5])]
    frame = spark.createDataFrame([(hard_negatives.NO_ID if i is None else i, lab, x) for i, lab, x in rows], "id long, label long, x array<bigint>").repartition(5)
    is_anchor = (F.col("id") % 100 == 0) & (F.col("id") != hard_negatives.NO_ID)
    want = brute_negatives(rows)
    for wave_bytes in (1 << 20, 3 * 32):
        got = hard_negatives.mine(frame, is_anchor, wave_bytes=wave_bytes)
        assert sorted(map(tuple, got.collect()), key=str) == want and want


def test_mining_edges(spark):
    schema = "vec_id long, embedding array<float>, label int, rank int, score long"
    rows = [(0, [1.0, 0.0], 1), (1, None, 1), (2, [float("nan"), 1.0], 1), (3, [1.0], None), (4, [1.0, 1.0], 1), (5, [0.5], 2), (6, [], 2)]
    table = spark.createDataFrame([(*r, 1, 1) for r in rows], schema)
    anchors = F.col("id") % 100 == 0
    got = hard_negatives.mine(hard_negatives.vectors_of(table), anchors).collect()
    assert [tuple(r) for r in got] == [(0, 4, 1, 5, 65536, 32768)]
    assert hard_negatives.mine(hard_negatives.vectors_of(table.limit(0)), anchors).count() == 0
    assert hard_negatives.mine(hard_negatives.vectors_of(table.filter("vec_id > 0")), anchors).count() == 0
    assert hard_negatives.mine(hard_negatives.vectors_of(table.filter("vec_id = 0")), anchors).count() == 0


def test_held_out_rows_teach_nothing(spark):
    """The label of a held-out row must not change any score."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "toxic")
    turned = labels.withColumn("toxic", F.when(language_id.is_held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    folder = new_stage_path(spark, "turned")
    docs.write.parquet(f"{folder}/documents.parquet")
    turned.write.parquet(f"{folder}/labels.parquet")
    one, two = ({r.doc_id: round(r.score, 9) for r in QUERIES["op11_toxicity"](spark, d).collect()} for d in (SMALL, folder))
    assert one == two
