"""Cases of the findings of round 3."""

import random

from pyspark.sql import functions as F

from newsloom.functions import text as tx
from newsloom.operators import dedup as dd, degrees, search as se, tagging
from newsloom.session import new_stage_path


def patterns_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower().count("regexp_replace")


def test_texts_are_cleaned_once(spark):
    rows = spark.createDataFrame([("A title here", "<p>" + "word " * 400 + "</p>")], "title string, t string")
    assert patterns_of(rows.select(tx.excerpt(F.col("t")).alias("x"))) < 30
    assert patterns_of(rows.select(tx.usable_evidence(F.col("t"), F.col("title")).alias("x"))) < 30


def test_takeaways_stop_at_their_limit(spark):
    said = [" ".join(f"{w}{i}" for w in ("alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta")) + "." for i in range(9)]
    rows = spark.createDataFrame([("Some title", said)], "title string, s array<string>")
    found = rows.select(se.takeaways(F.col("title"), F.col("s"), F.array("title")).alias("x"))
    assert found.first().x == said[:4]
    # the title's words are held by a variable, not computed again for every word of every sentence
    assert "array_contains(array_distinct(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_tags_by_numbers_alone(spark):
    """Places meet numbers, not names with their next words; broadcast and shuffled levels find the same."""
    names = spark.createDataFrame([("Ada",), ("Ada Bo",), ("ada bo-cy dan",), ("Cy",)], "name string")
    texts = spark.createDataFrame([(1, "ada bo cy dan, Ada bo! cy"), (2, "bo"), (3, None), (4, "x ada")], "id bigint, t string")
    trie = tagging.needles(names, "name")
    want = {(1, "ada bo cy dan", 1, 1), (1, "ada bo", 1, 5), (1, "cy", 2, 3), (4, "ada", 1, 2)}
    for level_rows in (0, 100):
        assert {tuple(r) for r in tagging.tag_counts(texts, trie, "id", "t", level_rows).collect()} == want
    assert {tuple(r) for r in tagging.tag_longest(texts, trie, "id", "t").collect()} >= {(1, 1, "ada bo cy dan"), (4, 2, "ada")}
    plan = tagging.longest_nodes(texts, trie, "id", "t")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_pairs_of_word_sets(spark, monkeypatch):
    """All pairs at the threshold, as counted by hand; words of one set are not looked up."""
    rng = random.Random(3)
    sets = []
    for scope in range(3):
        base = [f"w{i}" for i in range(60)]
        for i in range(40):
            words = rng.sample(base, rng.randint(5, 40)) if i % 2 or not sets else [w for w in sets[-1][2] if rng.random() > 0.1] + [f"own{scope}-{i}"]
            sets.append((scope, scope * 1000 + i, sorted(set(words))))
    sets = [x for x in sets if x[2]]
    want = {(min(a[1], b[1]), max(a[1], b[1])) for a in sets for b in sets if a[0] == b[0] and a[1] != b[1]
            and len(set(a[2]) & set(b[2])) >= min(len(a[2]), len(b[2])) * 0.78 - 1e-9}
    staged, real = {}, dd.stage
    monkeypatch.setattr(dd, "stage", lambda df, name: staged.setdefault(name, real(df, name)))
    rows = spark.createDataFrame(sets, "scope int, id bigint, words array<string>")
    assert {tuple(r) for r in dd.overlap_pairs(rows, 0.78).collect()} == want and len(want) > 20
    alone = [hash_ for (hash_,) in rows.select("scope", F.explode("words").alias("w")).groupBy("scope", "w").count().filter("count = 1").select(F.xxhash64("scope", "w")).collect()]
    assert alone and staged["probes"].filter(F.col("slot").isin(alone)).isEmpty()


def test_degrees_compute_a_change_once(spark, monkeypatch):
    """What is left of a bucket is read from the files written, and an emptied bucket goes."""
    store = degrees.DegreeStore(spark, new_stage_path(spark, "degrees"), 2)
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    edges = spark.createDataFrame([("t", "a", "b"), ("t", "a", "c")], "type string, src string, dst string")
    monkeypatch.setattr(type(nodes), "isEmpty", lambda self: (_ for _ in ()).throw(AssertionError("computed again")))
    store.apply(add_nodes=nodes, add_edges=edges)
    assert {tuple(r) for r in store.degrees().collect()} == {("a", 2), ("b", 1), ("c", 1)}
    store.apply(drop_nodes=nodes.filter("id = 'c'"))
    assert {tuple(r) for r in store.degrees().collect()} == {("a", 1), ("b", 1)}
    store.apply(drop_edges=edges)
    assert store.degrees().collect() == []


def test_search_reads_each_text_once_and_shuffles_no_pair(spark):
    """scores are summed in the node's task; both ways give the same rows, ties and missing dates included."""
    rng = random.Random(11)
    words = ["alpha", "beta", "c++", "node.js", "x-y", "no", "gamma", "the"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    day = lambda i: None if i % 5 == 0 else f"2024-01-{1 + i % 20:02d} 00:00:00"
    kinds = ["Entity", "Claim", "Topic", "TextSpan"]
    nodes = [(f"n{i:04d}", kinds[i % 4], text(i % 30), day(i)) for i in range(3000)] + [("none", "Topic", None, None)]
    nodes = spark.createDataFrame(nodes, "id string, type string, text string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    queries = spark.createDataFrame([(q, text(6), day(q)) for q in range(1, 14)], "query_id long, text string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    rows = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)
    here = se.related_nodes(queries, nodes)
    assert "MapInPandas" in here._jdf.queryExecution().optimizedPlan().toString()
    assert rows(here) == rows(se.related_nodes(queries, nodes, broadcast_limit=0))
    assert rows(se.related_sections(queries, nodes)) == rows(se.related_sections(queries, nodes, broadcast_limit=0))


def test_tokens_are_taken_out(spark):
    """the same words as by splitting, without the dear negated class."""
    from newsloom import rules
    rng = random.Random(3)
    bits = ["C++", "node.js", "-", "--a-b--", "ab", "abc", "é", " ", " ", "\t", "https://x.example/a b", "#tag", "Points:", "Article URL:", "x# Comments: 3", "İ", "a-b-c-", "the", ". ", "Big Name"]
    rows = [(None,), ("",)] + [("".join(rng.choice(bits) for _ in range(rng.randrange(40))),) for _ in range(400)]
    c = F.col("t")
    low = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), tx.URL_TOKEN, " ")
    split = F.filter(F.split(low, r"[^a-z0-9+#.\-]+"), lambda w: F.length(w) > 2)
    terms = F.transform(F.split(F.regexp_replace(low, rf"[^a-z0-9{tx._SPACE_CHARS}-]", " "), f"{tx.SPACE}+"), lambda w: F.regexp_replace(w, "^-+|-+$", ""))
    keywords = F.array_distinct(F.filter(terms, lambda w: (F.length(w) >= 4) & ~w.isin(*rules.RELEVANCE_STOP_WORDS)))
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), tx.URL_TOKEN, " "), tx.js_pattern(r"\b(?:Article URL|Comments URL|Points|# Comments):"), " ")
    run = rf"(?=[A-Z])(?<!{tx._W})((?:[A-Z][A-Za-z0-9+.\-]*(?:{tx.SPACE}+[A-Z][A-Za-z0-9+.\-]*){{0,3}})){tx.BOUNDARY}"
    names = F.filter(F.regexp_extract_all(plain, F.lit(run), F.lit(1)), lambda m: (F.length(m) > 2) & ~m.isin(*rules.STOP_ENTITIES))
    found = spark.createDataFrame(rows, "t string").select(
        "t", tx.search_tokens(c).alias("a"), split.alias("b"), tx.relevance_keywords(c).alias("k"), keywords.alias("l"), tx.entity_candidates(c).alias("n"), names.alias("o"))
    assert "split(" not in found.select("a", "k")._jdf.queryExecution().optimizedPlan().toString()
    for r in found.collect():
        assert (r.a, r.k, r.n) == (r.b, r.l, r.o), r.t


def test_a_graph_writes_what_is_read(spark, monkeypatch):
    """a search stages no edges, an export no citations, and edges come from one scan of the parsed items."""
    from newsloom.operators import graph as gr
    staged, real = [], gr.stage
    monkeypatch.setattr(gr, "stage", lambda df, name: staged.append(name) or real(df, name))
    items = spark.createDataFrame([(1, "Big Name meets Other Name", "Big Name said so. It ended.", "u1", "s", "en", "2024-01-01", ["x", "y"], "ok"), (2, "t", "", "u2", "s", None, "2024-01-02", None, "ok")],
                                  "id long, title string, summary string, url string, source_name string, kind string, day string, tags array<string>, status string")
    graph = gr.knowledge_graph(items).staged()
    assert graph.nodes.count() == 6 + 2 + 2 + 2
    assert "nodes" in staged and "edges" not in staged and "node-citations" not in staged
    plan = gr.knowledge_edges(gr.parsed_items(items))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Relation ") == 1
    ends = {(r.type, r.dst.split(":")[0]) for r in plan.collect()}
    assert plan.count() == 6 + 2 * 2 + 2 * 2 + 2 + 2 + 1 and ("coOccursWith", "entity") in ends


def test_choices_are_told_by_their_first_letters(spark):
    """a choice in a plain group costs one look per place, and gives what the whole boundary gives."""
    pattern = r"\b(applied opportunities|applied opportunitie|speculative|could|might|may|opportunity)\b"
    assert not tx.js_pattern(pattern).startswith(tx.BOUNDARY) and tx._opening_literals(pattern)[0] == "applied opportunities"
    old = tx.js_pattern(r"\b(?:(?:applied opportunities?)|speculative|could|might|may|opportunity)\b")
    rng = random.Random(8)
    bits = ["may", "MAY", "maybe", "dismay", "could", "Speculative", "applied opportunitie", "applied opportunities", "Applied opportunity", "é", "_", " ", " ", "-", "might"]
    rows = spark.createDataFrame([("".join(rng.choice(bits) for _ in range(rng.randrange(6))),) for _ in range(500)], "t string")
    found = rows.select("t", tx.any_match(F.col("t"), [pattern]).alias("a"), F.col("t").rlike("(?i)" + old).alias("b")).collect()
    assert {r.a for r in found} == {True, False}
    for r in found:
        assert r.a == r.b, r.t


def test_json_ld_lines_are_parsed_once(spark, tmp_path):
    """nodes and edges come out of one reading."""
    from newsloom.catalog import REGISTRY, Tables
    plan = REGISTRY["json_ld_round_trip"].run(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation ") == 1 and "Union" not in plan


def test_cleaned_texts_are_not_cleaned_again(spark):
    """evidence steps read a cleaned text by plain tests, with the results of cleaning it again."""
    rng = random.Random(4)
    bits = ["The post", "the POST x", "appeared first on", "Site.", " - ", "-", "a", "word", "Longer words", "No usable text", "  ", "\n", "\u00a0", "é"]
    said = lambda: " ".join(rng.choice(bits) for _ in range(rng.randrange(14)))
    rows = [(i, said(), said() if i % 7 else None) for i in range(600)] + [(900, "a b c d", "a b c d"), (901, "a b c d e", "x - y"), (902, "The The post x appeared first on y. post z appeared first on w. end here now all", "t")]
    df = spark.createDataFrame(rows, "id int, v string, h string").withColumn("v", tx.strip_noise(F.col("v"))).withColumn("h", F.coalesce("h", F.lit("")))
    found = tx.with_usable(tx.with_usable(df, "v", "h", "a", stripped=True), "v", "h", "b").withColumn("c", tx.usable_evidence(F.col("v"), F.col("h")))
    for r in found.collect():
        assert r.a == r.b == r.c, r.v
    # the pattern of the boilerplate and the one of the headline stand behind a test
    plan = tx.with_usable(df.select("v", "h"), "v", "h", "a", stripped=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN Contains(lower(v" in plan and "CASE WHEN Contains(_t" in plan


def test_evidence_of_several_parts(spark):
    """parts joined without a second cleaning give what a second cleaning gives."""
    rng = random.Random(9)
    bits = ["The post", "appeared first on", "Site.", "word", "other", "x" * 130 + " ", "Some sentence of more than forty characters is here.", "é", "\n"]
    said = lambda n: " ".join(rng.choice(bits) for _ in range(rng.randrange(n)))
    rows = [(i, "Title of it", said(9), said(20), said(8) if i % 3 else None) for i in range(400)]
    items = spark.createDataFrame(rows, "id long, title string, summary string, transcript_text string, description string").selectExpr(
        "*", "'u' AS url", "'s' AS source_name", "array('x') AS tags", "DATE'2024-01-01' AS day")
    found = se.daily_items(items, [("word", "Word")]).select("id", "source_text", tx.strip_noise(F.col("source_text")).alias("again"))
    want = items.withColumn("title", tx.clean_title(F.col("title"))).withColumn("s", tx.strip_noise(F.col("summary"))).withColumn("p", tx.strip_noise(F.col("transcript_text")))
    want = want.withColumn("t", F.when(F.col("p") != "", tx.summarize(F.col("p"), 5)).otherwise("")).withColumn("d", tx.strip_noise(F.col("description")))
    parts = [F.when(tx.usable_evidence(F.col(c), F.col("title")), F.col(c)) for c in ("s", "t", "d")]
    want = {r.id: r.e for r in want.select("id", tx.strip_noise(F.concat_ws(" ", *parts)).alias("e")).collect()}
    assert {r.id: r.source_text for r in found.collect()} == want


def test_copies_and_joined_stories_have_no_keys(spark, monkeypatch):
    """items of the same words are one kind, and words inside one story are not combined; the stories stay those of all pairs."""
    from newsloom.operators import search
    from newsloom.plans import daily_brief as br
    rng = random.Random(12)
    words, names = [f"w{i:02d}" for i in range(40)], ["A", "B"]
    sets = [(f"2024-01-0{1 + i % 2}", sorted(rng.sample(words, rng.randint(0, 9))), rng.sample(names, rng.randint(0, 2)) if i % 3 == 0 else []) for i in range(40)]
    items = [(i, f"https://a.example/{i if i % 9 else 0}", *sets[i % 40]) for i in range(160)] + [(900, "https://a.example/900", "2024-01-01", None, None)]
    parent = {x[0]: x[0] for x in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in items:
        for y in items:
            kw, ent = len(set(x[3] or []) & set(y[3] or [])), len(set(x[4] or []) & set(y[4] or []))
            if x[2] == y[2] and (x[1] == y[1] or (kw and ent) or kw >= 4):
                a, b = find(x[0]), find(y[0])
                parent[max(a, b)] = min(a, b)
    held, real = [], search.stage
    monkeypatch.setattr(search, "stage", lambda df, name: held.append(real(df, name)) or held[-1])
    rows = lambda of: spark.createDataFrame(of, "id bigint, url string, day string, keywords array<string>, entities array<string>")
    assert {r.id: r.cluster for r in br.story_clusters(rows(items)).collect()} == {x: find(x) for x in parent}
    four = sum(len(s) >= 4 for _, s, _ in sets)
    assert four > 20 and held[0].filter("key NOT LIKE '%|u|%'").select("item").distinct().count() <= 40
    # 120 copies of one text, which are one story at once, are in no combination of four words
    held.clear()
    copies = [(i, f"https://a.example/{i}", "2024-01-01", words[:9], []) for i in range(120)]
    assert {r.cluster for r in br.story_clusters(rows(copies)).collect()} == {0}
    assert held[0].count() == 120 and held[1].count() == 0


def test_waiting_records_are_held_in_chunks():
    """a frame of records is one state write, and what comes out does not depend on the order of arrival."""
    import pandas as pd
    from newsloom.streaming.stateful import RetryQueue

    class Values:
        def __init__(self):
            self.rows, self.calls = [], 0

        def appendValue(self, row):
            self.rows.append(row)
            self.calls += 1

        def get(self):
            return iter(list(self.rows))

        def clear(self):
            self.rows = []

    class One:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value

        def update(self, value):
            self.value = value

    class Handle:
        def __init__(self):
            self.lists, self.timers = Values(), set()

        getListState = lambda self, *_: self.lists
        getValueState = lambda self, *_: One()
        registerTimer = lambda self, at: self.timers.add(at)
        deleteTimer = lambda self, at: self.timers.discard(at)

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    def told(numbers):
        handle, queue, out = Handle(), RetryQueue(), []
        queue.init(handle)
        for part in (numbers[:100], numbers[100:]):
            frame = pd.DataFrame({"seq": part, "status": ["revisit_pending" if n % 3 else "parsed" for n in part], "at": pd.Timestamp("2024-01-01") + pd.to_timedelta([n * 7 for n in part], "m")})
            assert list(queue.handleInputRows((1,), iter([frame]), None)) == []
        assert handle.lists.calls == 2
        for mark in ("2024-01-01 08:00", "2024-01-01 08:01", "2024-03-01"):
            passed = pd.Timestamp(mark).value // 10**6
            while due := [t for t in handle.timers if t <= passed]:
                timer = At(min(due))
                handle.timers.discard(min(due))
                out += [tuple(r) for f in queue.handleExpiredTimer((1,), At(passed), timer) for r in f.astype(str).itertuples(index=False)]
        assert handle.lists.rows == []
        return out

    numbers = list(range(200))
    shuffled = random.Random(2).sample(numbers, 200)
    assert told(numbers) == told(shuffled) and len(told(numbers)) > 200
