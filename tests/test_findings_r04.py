"""Cases of the findings of round 4."""

import os
import random
import types

import pytest
from pyspark.sql import functions as F

from newsloom.catalog import REGISTRY, Tables
from newsloom.operators import dedup as dd, degrees
from newsloom.schemas import TABLES
from newsloom.session import new_stage_path, shared_dir
from tests.oracle import NAMES, ROOT, connect, differences

PHRASES = [
    (1, "ai aneau And that is said. The local ai of llm the rest. A third one.", "en", "s", 70),
    (2, "A semantic store with episodic store, then Local AI. Nothing of the kind.", "en", "s", 75),
]

BLANK = [
    (1, "", "en", "s", 0), (2, " \n ", "fr", "s", 3), (3, None, "en", "s", 0), (4, "", "de", "t", 0),
    (5, "Five words make a title, and three more follow. The second sentence.", "en", "s", 68),
]
UNKNOWN = [(6, "A text in no language. And a second sentence.", None, "s", 45), (7, "A text of no source. And a second sentence.", "en", None, 43)]


def tables_with(spark, path, documents):
    """The smallest tables with other documents."""
    for name in NAMES:
        if name == "documents":
            spark.createDataFrame(documents, TABLES[name]).toPandas().to_parquet(path / f"{name}.parquet", index=False)
        else:
            os.symlink(f"{ROOT}/sf0.001/{name}.parquet", path / f"{name}.parquet")
    return str(path)


@pytest.mark.parametrize("name, documents", [
    ("evidence_groups", PHRASES), ("summary_items", BLANK + UNKNOWN), ("source_evidence", BLANK + UNKNOWN),
])
def test_query(name, documents, spark, tmp_path):
    path = tables_with(spark, tmp_path, documents)
    assert differences(REGISTRY[name], Tables(spark, path), connect(path)) is None


def word_sets():
    """Sets of three scopes, one of them null, with parts, copies and near copies of others, ids as strings."""
    rng, sets = random.Random(5), []
    for scope in (None, "a", "b"):
        base = [f"w{i}" for i in range(80)]
        for i in range(60):
            words = rng.sample(base, rng.randint(1, 50)) if i % 2 or not sets else [w for w in sets[-1][2] if rng.random() > 0.1] + [f"own{scope}-{i}"]
            sets.append((scope, f"{scope}-{i:02d}", sorted(set(words))))
    pairs = {(min(a[1], b[1]), max(a[1], b[1])) for a in sets for b in sets if a[0] == b[0] and a[1] != b[1]
             and len(set(a[2]) & set(b[2])) >= min(len(a[2]), len(b[2])) * 0.78 - 1e-9}
    return sets, pairs


@pytest.mark.parametrize("least, more_parts", [(200_000, 1), (500, 1), (500, 3)])
def test_pairs_shuffle_no_candidate(least, more_parts, spark, monkeypatch):
    """groups of sets are compared in place, whatever the number of groups and of parts."""
    sets, want = word_sets()
    rows = spark.createDataFrame(sets, "scope string, id string, words array<string>")
    if least < 200_000:
        monkeypatch.setattr("newsloom.operators.overlap.LEAST_WORDS", least)
        ranged = type(rows).repartitionByRange
        monkeypatch.setattr(type(rows), "repartitionByRange", lambda self, n, *keys: ranged(self, n * more_parts, *keys))
    found = dd.overlap_pairs(rows, 0.78)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_words_of_one_number_are_told_apart(spark, monkeypatch):
    sets, want = word_sets()
    poor = types.SimpleNamespace(**vars(F))
    poor.xxhash64 = lambda *c: F.xxhash64(*c) % 40 if len(c) == 2 else F.xxhash64(*c)
    monkeypatch.setattr(dd, "F", poor)
    rows = spark.createDataFrame(sets, "scope string, id string, words array<string>")
    assert {tuple(r) for r in dd.overlap_pairs(rows, 0.78).collect()} == want


def test_degrees_leave_nothing_but_the_store(spark):
    """a change leaves its published buckets alone, in files that hold each edge's ends once; degrees are those of a recount."""
    rng, nodes, edges = random.Random(9), set(), set()
    path = new_stage_path(spark, "degrees")
    store, before = degrees.DegreeStore(spark, path, 3), set(os.listdir(shared_dir(spark)))
    ids = [f"n{i}" for i in range(12)]
    some = lambda: {("t" + str(rng.randint(0, 1)), rng.choice(ids), rng.choice(ids)) for _ in range(14)}
    for step in range(4):
        more, less = set(rng.sample(ids, 6)), set(rng.sample(ids, 3)) if step else set()
        come, go = some() | {("loop", "n1", "n1")}, some() if step else set()
        frame = lambda rows, schema: spark.createDataFrame(sorted(rows) * 2, schema) if rows else None
        store.apply(frame({(x,) for x in more}, "id string"), frame({(x,) for x in less}, "id string"),
                    frame(come, "type string, src string, dst string"), frame(go, "type string, src string, dst string"))
        nodes, edges = (nodes | more) - less, (edges | come) - go
        want = {x: sum((s == x) + (d == x) for _, s, d in edges if s in nodes and d in nodes) for x in nodes}
        assert {r.id: r.degree for r in store.degrees().collect()} == {x: n for x, n in want.items() if n}
        assert {f.split("-")[0] for f in os.listdir(path)} <= {"nodes", "ends", "degrees", "_versions"}
    assert set(os.listdir(shared_dir(spark))) <= before | {os.path.basename(path)}
    content = store.log.latest()[1]["ends"]
    held = store._table("ends", content, content)
    assert held.count() == sum(1 + (s != d) for _, s, d in edges)
