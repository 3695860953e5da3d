"""Iterative jobs against brute force on small random inputs. Each runs
with the plain joins and with the hot-key routes forced on."""

import random

import pytest
from pyspark.sql import functions as F

from newsloom.functions import text as tx
from newsloom.operators import dedup as dd, graph as gr, ledger as lg, search as se, skew
from newsloom.plans import daily_brief as br

ROUTES = pytest.mark.parametrize("plain_rows", [skew.PLAIN_ROWS, 0], ids=["plain", "hot"])


@ROUTES
@pytest.mark.parametrize("seed", [1, 2])
def test_two_key_dedup(spark, seed, plain_rows):
    rng = random.Random(seed)
    # one text key holds about a third of the rows
    rows = [(i, rng.choice(["", *"abcdefgh"]), "hot" if rng.random() < 0.33 else rng.choice(["", *"stuvwxyz"])) for i in range(80)]
    seen_u, seen_t, want = set(), set(), set()
    for o, u, t in rows:
        if (u and u in seen_u) or (t and t in seen_t):
            continue
        want.add(o)
        seen_u.add(u) if u else None
        seen_t.add(t) if t else None
    df = spark.createDataFrame(rows, "o bigint, u string, t string")
    assert {r.o for r in dd.greedy_two_keys(df, "o", "u", "t", plain_rows).collect()} == want


def near(a, b):
    return len(a) >= 5 and len(b) >= 5 and len(a & b) / min(len(a), len(b)) >= 0.78


@ROUTES
@pytest.mark.parametrize("seed", [3, 4])
def test_near_duplicates(spark, seed, plain_rows):
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(14)]
    rows = [(i, rng.randrange(2), " ".join(rng.sample(vocabulary, rng.randint(3, 11)))) for i in range(90)]
    rows += [(100 + i, 0, rows[0][2]) for i in range(30)]
    kept, want = {0: [], 1: []}, set()
    for o, scope, text in rows:
        words = set(text.split())
        if any(near(words, k) for k in kept[scope]):
            want.add(o)
        else:
            kept[scope].append(words)
    df = spark.createDataFrame(rows, "o bigint, scope int, text string")
    got = dd.near_duplicates(df, "o", "text", scope=F.col("scope"), plain_rows=plain_rows)
    assert {r.o for r in got.collect()} == want


@ROUTES
def test_components(spark, plain_rows):
    rng = random.Random(5)
    links = [(rng.randrange(1, 120), rng.randrange(120)) for _ in range(80)] + [(i, 0) for i in range(1, 30)]
    parent = list(range(121))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    ends = {x for pair in links for x in pair if pair[0] != pair[1]}
    df = spark.createDataFrame([p for p in links if p[0] != p[1]], "item bigint, anchor bigint")
    got = {r.item: r.cluster for r in br.components(df, plain_rows).collect()}
    assert got == {x: find(x) for x in ends}


def test_story_keys_connect_like_pairs(spark):
    rng = random.Random(6)
    words, names = [f"w{i}" for i in range(16)], ["A", "B", "C"]
    items = [(i, "2024-01-01", f"https://a.example/{rng.randrange(30)}", sorted(rng.sample(words, rng.randint(1, 7))), rng.sample(names, rng.randint(0, 1))) for i in range(25)]
    parent = list(range(25))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in items:
        for y in items:
            kw, ent = len(set(x[3]) & set(y[3])), len(set(x[4]) & set(y[4]))
            if x[2] == y[2] or (kw and ent) or kw >= 4:
                a, b = find(x[0]), find(y[0])
                parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(items, "id bigint, day string, url string, keywords array<string>, entities array<string>")
    assert {r.id: r.cluster for r in br.story_clusters(df).collect()} == {i: find(i) for i in range(25)}


def test_large_days_lose_no_item(spark):
    """A day of over a thousand items: all of them reach a story."""
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    rows = [(i, "2024-01-01" if i < 1300 else "2024-01-02", f"Report zz{i:05d} about {words[i % 6]} systems", f"https://n.example/{i}", "src", [f"tag{i}"], f"A long summary of report zz{i:05d} with the term agents and memory in it.") for i in range(1400)]
    items = spark.createDataFrame(rows, "id bigint, day string, title string, url string, source_name string, tags array<string>, summary string").withColumn("day", F.to_date("day"))
    stories = br.daily_briefs(items, ["report"], [("zzz", "Zzz")], per_day=5000)
    assert {r.day.isoformat(): r.n for r in stories.groupBy("day").agg(F.sum("source_count").alias("n")).collect()} == {"2024-01-01": 1300, "2024-01-02": 100}


def test_rank_prefers_later_stories(spark):
    rows = [(1, "2024-01-01", 2, "2024-01-01 08:00:00"), (2, "2024-01-01", 2, "2024-01-01 09:00:00"), (3, "2024-01-01", 5, "2024-01-01 01:00:00")]
    df = spark.createDataFrame(rows, "cluster bigint, day string, source_count bigint, latest string")
    assert [r.cluster for r in br.rank_briefs(df, 3).orderBy("rank").collect()] == [3, 2, 1]


def test_long_key_chains_settle(spark):
    """Rows whose keys alternate settle one link per round; there is no limit of rounds."""
    rows = [(i, f"u{(i + 1) // 2}", f"t{i // 2}") for i in range(24)]
    df = spark.createDataFrame(rows, "o bigint, u string, t string")
    assert {r.o for r in dd.greedy_two_keys(df, "o", "u", "t").collect()} == set(range(0, 24, 2))


def test_hot_id_in_one_day_is_many_blocks(spark):
    from newsloom.operators import retry as rt

    rng = random.Random(4)
    rows = [(s, 1 if rng.random() < 0.4 else rng.randrange(2, 60), rng.choice(["revisit_pending", "parsed", "briefed"]), s // 100) for s in range(6000)]
    df = spark.createDataFrame(rows, "seq bigint, id bigint, status string, block bigint")
    want, run, last = {}, {}, {}
    steps = {}
    for s, i, status, _ in rows:
        run[i] = run.get(i, 0) + 1 if status == "revisit_pending" else 0
        if run[i]:
            want[s] = run[i]
        steps[s] = last.get(i)
        last[i] = status
    assert {r.seq: r.attempt for r in rt.attempts(df).collect()} == want
    assert {r.seq: r.previous for r in rt.transitions(df).collect()} == steps
    # no (id, block) window holds more than a twentieth of the hot id's rows
    hot = sum(i == 1 for _, i, _, _ in rows)
    assert df.filter("id = 1").groupBy("block").count().agg(F.max("count")).first()[0] <= hot / 20


def test_null_keys_are_kept_apart(spark):
    left = spark.createDataFrame([(1, None), (2, "a"), (3, "b"), (4, None)], "o bigint, k string")
    right = spark.createDataFrame([("a", 10)], "k string, v bigint")
    for limit in (0, 100):
        assert {(r.o, r.v) for r in skew.lookup(left, right, "k", 4, limit).collect()} == {(1, None), (2, 10), (3, None), (4, None)}


def test_late_versions_do_not_override(spark):
    """An old value in a late batch, beside a newer value of another attribute."""
    from newsloom.session import new_stage_path
    from newsloom.streaming import jobs as sj

    folder, (out, checkpoint) = new_stage_path(spark, "late"), sj.paths(spark, "late")
    schema = "id bigint, type string, score double, seq bigint"

    def arrive(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        return {r.id: (r.type, r.score) for r in sj.merge_graph_batches(sj.tail(spark, folder, schema), out, checkpoint).collect()}

    assert arrive((1, "new", None, 100)) == {1: ("new", None)}
    assert arrive((1, "old", None, 10), (1, None, 5.0, 120), (2, "x", 1.0, 1)) == {1: ("new", 5.0), 2: ("x", 1.0)}


def test_day_index_goes_on_after_a_restart(spark):
    from newsloom.session import new_stage_path
    from newsloom.streaming import jobs as sj

    folder, (out, checkpoint) = new_stage_path(spark, "days"), sj.paths(spark, "days")

    def arrive(*days):
        spark.createDataFrame([(f"2024-01-{d:02} 10:00:00",) for d in days], "observed_at string").coalesce(1).write.mode("append").parquet(folder)
        return read()

    def read():
        return {r.day: r.n for r in sj.upsert_day_index(sj.tail(spark, folder, "observed_at string"), out, checkpoint).collect()}

    assert arrive(1, 2, 2) == {"2024-01-01": 1, "2024-01-02": 2}
    assert arrive(3, 1) == {"2024-01-01": 2, "2024-01-02": 2, "2024-01-03": 1}
    assert read() == {"2024-01-01": 2, "2024-01-02": 2, "2024-01-03": 1}  # nothing new


def test_late_rows_are_counted(spark):
    import time

    from newsloom.session import new_stage_path
    from newsloom.streaming import jobs as sj

    folder, (out, checkpoint) = new_stage_path(spark, "lateness"), sj.paths(spark, "lateness")
    for hours in ((1, 2), (80,), (81,), (3, 90)):  # late by two batches
        rows = [(h, f"2024-01-{1 + h // 24:02} {h % 24:02}:00:00") for h in hours]
        spark.createDataFrame(rows, "seq bigint, at string").select("seq", F.to_timestamp("at").cast("timestamp_ntz").alias("observed_at")).coalesce(1).write.mode("append").parquet(folder)
    listener = sj.LateRows()
    spark.streams.addListener(listener)
    try:
        stream = sj.tail(spark, folder, "seq bigint, observed_at timestamp_ntz", files_per_batch=1)
        sj.append_to(sj.local_day_rollup(stream, "UTC", "1 hour"), out, checkpoint)
        for _ in range(50):
            if listener.dropped:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert listener.dropped == 1


def test_bad_ledger_lines_are_errors(spark, tmp_path):
    from newsloom.sources import sinks

    (tmp_path / "a.json").write_text('{"id": 1}\n{broken\n')
    with pytest.raises(Exception):
        sinks.read_ledger(spark, str(tmp_path), "id bigint").collect()



@pytest.mark.parametrize("seed", [7, 8])
def test_neighborhoods(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(40):02d}", f"n{rng.randrange(40):02d}") for _ in range(70)] + [("n00", f"n{i:02d}") for i in range(20)]
    both = [(a, b, "t") for a, b in edges] + [(b, a, "t") for a, b in edges]
    around = {}
    for a, b, _ in both:
        around.setdefault(a, []).append(b)
    want = {}
    for start in ("n00", "n05", "n39"):
        seen, queue = [start], [start]
        while queue and len(seen) < 9:
            for x in sorted(around.get(queue.pop(0), [])):
                if x not in seen:
                    seen.append(x)
                    queue.append(x)
                    if len(seen) >= 9:
                        break
        want[start] = seen
    adjacent = spark.createDataFrame(both, "node string, neighbor string, type string")
    seeds = spark.createDataFrame([(s,) for s in want], "id string")
    got = {}
    for r in gr.neighborhoods(seeds, adjacent, 9).orderBy("seed", "place").collect():
        got.setdefault(r.seed, []).append(r.node)
    assert got == want


def test_evidence_assignment(spark):
    evidence = ["memory store one", "memory two", "memory three", "memory four", "plain five", "agent six", "plain seven", "plain eight", "plain nine"]
    row = spark.range(1).select(se.assign_evidence(F.array(F.lit("memory"), F.lit("agent store"), F.lit("absent")), F.array(*[F.lit(e) for e in evidence])).alias("g")).first().g
    assert [(g.concept, len(g.sentences)) for g in row] == [("memory", 3), ("agent store", 1), (None, 3), (None, 2)]
    assert row[2].sentences == ["memory four", "plain five", "plain seven"]


def test_bucketed_windows_equal_plain_windows(spark):
    rng = random.Random(9)
    rows = [(i, "hot" if rng.random() < 0.5 else f"k{rng.randrange(5)}", i // 7, rng.choice("ab")) for i in range(120)]
    df = spark.createDataFrame(rows, "seq bigint, id string, day bigint, v string")
    count, last, want = {}, {}, {}
    for seq, key, _, v in rows:
        count[key] = count.get(key, 0) + 1
        want[seq] = (count[key], last.get(key))
        last[key] = v
    ranked = lg.bucketed_rank(df, "id", "day", "seq", "n")
    got = {r.seq: (r.n, r.p) for r in lg.bucketed_previous(ranked, "id", "day", "seq", "v", "p").collect()}
    assert got == want


def test_takeaways_skip_repeats(spark):
    long = "Alpha beta gamma delta epsilon zeta eta theta iota kappa."
    other = "Completely different words describe another measured thing within this second sentence."
    out = spark.range(1).select(se.takeaways(F.lit("Title"), F.array(F.lit(long), F.lit(long.upper()), F.lit("Short one."), F.lit(other)), F.array(F.lit("x"))).alias("t")).first().t
    assert out == [long, other]


def test_content_words_are_ascii(spark):
    out = spark.range(1).select(tx.content_words(F.lit("R&D café naïve The NEW agents")).alias("w")).first().w
    assert out == ["caf", "agents"]


def test_related_urls_and_transcripts_join_stories(spark):
    rows = [(1, "First report title", "https://a.example/1", "Words of the first summary, long enough to count as evidence.", ["https://b.example/2"], None, None),
            (2, "Second other heading", "https://b.example/2", "Something else entirely is told here about nothing shared.", None, "The spoken part names Zorblax twice over, and says so at some length today.", None),
            (3, "Third lone piece", "https://c.example/3", "A third text that stands alone with its own distinct content.", None, None, "The description mentions Zorblax in a full and usable sentence.")]
    items = spark.createDataFrame(rows, "id bigint, title string, url string, summary string, related_urls array<string>, transcript_text string, description string").withColumns(
        {"day": F.to_date(F.lit("2024-01-01")), "source_name": F.lit("s"), "tags": F.array().cast("array<string>")})
    daily = se.daily_items(items, [("zorblax", "Zorblax")])
    got = {r.id: (list(r.entities), "Zorblax" in r.source_text) for r in daily.collect()}
    assert got == {1: ([], False), 2: (["Zorblax"], True), 3: (["Zorblax"], True)}
    assert {r.id: r.cluster for r in br.story_clusters(daily).collect()} == {1: 1, 2: 1, 3: 3}


def test_merged_findings_of_evaluators(spark):
    from newsloom.operators import quality as ql

    outputs = spark.createDataFrame([(1,), (2,)], "output_id long")
    words = lambda df: df.select("output_id", F.lit(2.0).alias("score"), F.lit(0).alias("required_failures"), F.array(F.lit("z"), F.lit("short")).alias("feedback"))
    links = lambda df: df.select("output_id", F.lit(0.5).alias("score"), F.lit(1).alias("required_failures"), F.when(F.col("output_id") == 1, F.array(F.lit("dead link"))).alias("feedback"), F.array(F.lit("fix")).alias("required_fixes"))
    got = {r.output_id: r.asDict() for r in ql.run_evaluators(outputs, {"words": words, "links": links}).collect()}
    common = {"score": 0.75, "n_reports": 2, "required_failures": 1, "verdict": "fail", "required_fixes": ["fix"]}
    assert got == {1: {"output_id": 1, "feedback": ["z", "short", "dead link"], **common}, 2: {"output_id": 2, "feedback": ["z", "short"], **common}}


def test_temporal_range_reads_all_dates(spark):
    from newsloom.operators import graph as gr

    rows = [("s", "2026-05-02", None, "2026-05-01T23:00:00-05:00", None, "2026-05-09", ""), ("s", None, "2026-04-30T10:00:00Z", None, "2027-01-01", None, None), ("t", None, None, None, None, None, None)]
    members = spark.createDataFrame(rows, "seed string, published_at string, observed_at string, valid_from string, valid_until string, event_date string, ingested_at string")
    assert [tuple(r) for r in gr.temporal_range(members).collect()] == [("s", "2026-04-30T10:00:00Z", "2027-01-01")]
