"""Each operator against brute force, an exact round trip or held-out accuracy."""

import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from newsloom.llm import (chat_format, components, decontamination, exact_dedup, html_wrappers, language_id, license_scan, minhash,
                          sentencepiece_codec, sharding, warc)
from newsloom.llm.common import new_stage_path, spread_lookup, write_file
from newsloom.llm.pieces import pieces
from newsloom.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import connect, rows_of

DATA = "/root/testdata/sf0.001"


def documents():
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{DATA}/documents.parquet'").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    df = QUERIES[name](spark, DATA)
    want = connect(DATA).sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())


def test_queries_are_registered():
    names = entry.queries()
    assert set(QUERIES) | {"pipeline"} <= set(names) and len(QUERIES) == 13


# ---- language

def test_language_held_out_accuracy(spark):
    truth = {i: lang for i, _, lang in documents()}
    rows = QUERIES["op1_language_id"](spark, DATA).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held) > 0


def test_forward_sums_all_segmentations():
    vocabulary = pieces()
    p = np.random.default_rng(3).random((len(vocabulary.strings), 2)) / len(vocabulary.strings)
    model = language_id.Model(["a", "b"], language_id._with_rows(p))

    def brute(word, k):
        if not word:
            return 1.0
        total = 0.0
        for n in range(1, min(len(word), vocabulary.max_length) + 1):
            if word[:n] in index:
                total += p[index[word[:n]], k] * brute(word[n:], k)
            elif n == 1:
                total += language_id.UNKNOWN_CHAR * brute(word[n:], k)
        return total

    index = {s: i for i, s in enumerate(vocabulary.strings)}
    words = ["a", "the", "zußk", "日本", "thing", "ciónm"]
    got = language_id.score_words(model, words)
    for i, w in enumerate(words):
        for k in range(2):
            assert got[i, k] == pytest.approx(np.log(brute(" " + w, k)))
    counts = language_id.expected_counts(model, ["the"], 0, np.array([2.0]))
    used = sum(counts[i] * len(vocabulary.strings[i]) for i in np.flatnonzero(counts))
    assert used == pytest.approx(2 * len(" the"))  # every segmentation covers the word


# ---- licences

PHRASES = {tuple(k.split()): v for k, v in license_scan.PHRASES.items()}


def brute_licences(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(i, v) for i in range(len(words)) for k, v in PHRASES.items() if tuple(words[i:i + len(k)]) == k]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({v for _, v in found}))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("GNU general Public license apache cc by mit permission is this software the of zz é 3".split()), max_size=40))
def test_licence_phrases(words):
    text = " ".join(words)
    got = license_scan.scan_text(license_scan.automaton(), text)
    assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == brute_licences(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30))
def test_matching_statistics(ids):
    templates = {"x": "a b a b c a", "y": "b c d b a a"}
    machine = license_scan.Automaton(templates, {"c a": "p"})
    names = [w for w, _ in sorted(machine.word_ids.items(), key=lambda x: x[1])]
    pool = [[machine.word_ids[w.encode()] for w in t.split()] for t in [*templates.values(), "c a"]]
    for at, _, longest in machine.stream(ids, 0):
        best = max((n for n in range(at + 2) for t in pool if any(t[i:i + n] == ids[at + 1 - n:at + 1] for i in range(len(t) - n + 1))), default=0)
        assert longest == best, names


def test_licence_spans():
    text = license_scan.TEMPLATES["mit"].replace("without limitation the rights", "without limits rights")
    got = license_scan.scan_text(license_scan.automaton(), "Some words. " + text + " More words.")
    assert got["labels"] == "mit" and got["base_labels"] == "" and 0.5 < got["score"] < 1
    assert got["spans"][0]["first"] == 2
    plain = license_scan.scan_text(license_scan.automaton(), "the software is free to use and copy, and the files are here for any person " * 20)
    assert plain["labels"] == ""


def test_every_copy_of_a_licence():
    machine, mit, bsd = license_scan.automaton(), license_scan.TEMPLATES["mit"], license_scan.TEMPLATES["bsd"]
    n, m = len(license_scan.words_of(mit)), len(license_scan.words_of(bsd))
    got = license_scan.scan_text(machine, " ".join([mit, "left pad", bsd, mit, mit, "zz " * 50, mit]))
    assert [(s["label"], s["first"], s["last"], s["cover"]) for s in got["spans"] if s["label"] in ("mit", "bsd")] == [
        ("mit", 0, n - 1, 1), ("bsd", n + 2, n + m + 1, 1), ("mit", n + m + 2, 2 * n + m + 1, 1), ("mit", 2 * n + m + 2, 3 * n + m + 1, 1), ("mit", 3 * n + m + 52, 4 * n + m + 51, 1)]
    many = license_scan.scan_text(machine, (mit + "\n") * 3000)["spans"]
    assert [s["first"] for s in many if s["label"] == "mit"] == [n * i for i in range(3000)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=40))
def test_all_places_of_long_matches(words):
    templates = {"x": "a b a b c a d a b c a d d", "y": "b c a d a b c d b a a b"}
    machine = license_scan.Automaton(templates, {"c a": "p"})
    ids = [machine.word_ids[w.encode()] for w in words]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(license_scan, "LONG_MATCH", 2)
        for at, state, longest in machine.stream(ids, 0):
            want = set()
            for t, (_, own) in enumerate(machine.templates):
                for end in range(len(own)):
                    k = 0
                    while k <= min(at, end) and own[end - k] == ids[at - k]:
                        k += 1
                    if k >= 2:
                        want.add((t, end, k))
            assert set(machine.places(state, longest)) == want


def test_licence_query(spark):
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in QUERIES["op2_license_scan"](spark, DATA).collect()}
    assert got == {i: brute_licences(t) for i, t, _ in documents()}


# ---- pages

def test_wrapper_alignment():
    pages = ["<body><div class=top>Site</div><div class='main-{n}'><h2>A{n}</h2><p>x{n}</p><p>y</p><h2>B</h2><p>z</p></div><ul><li>1<li>2</ul></body>".replace("{n}", str(n)) for n in (1, 2)]
    pages.append("<body><div class=top>Site</div><em>new</em><div class='main-3'><h2>only</h2><p>q</p></div><ul><li>1</ul></body>")
    wrapper = html_wrappers.align_all([html_wrappers.skeleton(html_wrappers.parse(p)) for p in pages])
    body = wrapper[html_wrappers.KIDS][0]
    by_key = {e[html_wrappers.KEY]: e for e in body[html_wrappers.KIDS]}
    assert by_key["em"][html_wrappers.OPTIONAL] and not by_key["div .top"][html_wrappers.OPTIONAL]
    assert by_key["div .top"][html_wrappers.KIDS][0][html_wrappers.LITERAL] == "Site"
    inner = by_key["div .main-"][html_wrappers.KIDS]
    assert [(e[html_wrappers.KEY], e[html_wrappers.REPEATED]) for e in inner] == [("(h2|p)", True)]
    assert by_key["ul"][html_wrappers.KIDS][0][html_wrappers.REPEATED]


FURNITURE = ["<nav><a href=/>Home</a></nav>", "<header>Site name</header>", "<div class='side-bar sidebar'>links</div>", "<aside>more</aside>", "<form>Search<input></form>",
             "<script>var p = '<p>no</p>';</script>", "<style>p{}</style>", "<div id='comments'><p>First!</p></div>", "<div class='cookie notice'>We use cookies</div>", "<div class=ad>Buy</div>",
             "<!-- <p>old</p> -->", "<footer>&copy; us</footer>"]


@pytest.mark.parametrize("container", ["article", "main", "div class=story", "div id=x role=article"])
def test_main_text(spark, container):
    tag = container.split()[0]
    rng = random.Random(container)
    rows, want = [], {}
    for i in range(12):
        paragraphs = [f"Paragraph {j} of page {i}, " + " ".join(rng.choice(["green", "apple", "river"]) for _ in range(12)) for j in range(rng.randint(1, 4))]
        inner = "".join(f"<p>{p.replace(',', '&#44;', 1)}" if rng.random() < 0.5 else f"<p class=c{i}>\n{p.replace(' ', '  ', 1)}</p>" for p in paragraphs)
        around = rng.sample(FURNITURE, 8)
        page = f"<!DOCTYPE html><title>T</title><body>{''.join(around[:4])}<{container}><h1>Title {i}</h1>{rng.choice(FURNITURE)}{inner}<ul><li>one<li>t<b>w</b>o</ul></{tag}>{''.join(around[4:])}</body>"
        rows.append((i, f"https://news.example/{i}", page))
        want[i] = "\n\n".join([f"Title {i}", *paragraphs, "one", "two"])
    got = {r.page_id: r.text for r in html_wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == want


def extracted(spark, pages):
    rows = [(i, f"https://news.example/{i}", page) for i, page in enumerate(pages)]
    return [r.text for r in html_wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_theme_classes_are_no_furniture(spark):
    def page(i, n):
        paragraphs = "".join(f"<p>Paragraph {j} of page {i} says a little more than others do." for j in range(n))
        return (f"<body class='single has-sidebar'><div class='site-header'>The Site</div><div id='page' class='site with-header'><form id=all><article class='post comments-open'>"
                f"<header class=entry-header><a href=/c>News</a></header><div class='article-header'><h1>Headline {i}</h1></div>{paragraphs}"
                f"<div class='post-comments'><p><a href=/{i}>Comments</a></p></div></article></form><div class='sidebar'><p>Side {i}</p></div></div><div class=footer>Us</div>")

    def want(i, n):
        return "\n\n".join([f"Headline {i}", *[f"Paragraph {j} of page {i} says a little more than others do." for j in range(n)]])

    assert extracted(spark, [page(i, 2 + i % 3) for i in range(6)]) == [want(i, 2 + i % 3) for i in range(6)]
    assert extracted(spark, [page(0, 3)]) == [want(0, 3)]
    plain = [re.sub("</?article[^>]*>", "", page(i, 3)) for i in range(6)]  # nothing but the wrapper shows the article
    assert extracted(spark, plain) == [want(i, 3) for i in range(6)]


def test_wrapper_decides_the_text(spark):
    def page(i, n, article="article", extra=""):
        paragraphs = "".join(f"<p>Paragraph {j} of page {i} has its own words and no others." for j in range(n))
        cards = "".join(f"<div class=card><p>Card {j} of {i}<p>Read more</div>" for j in range(2))
        return (f"<body><div class=top>Site</div><{article} class=x><h1>Title {i}</h1>{paragraphs}<p>Get our <b>letter</b> by mail.{extra}<div class=tags><a href=/a>Tag {i}</a> <a href=/b>Tag b</a></div>"
                f"{cards}<blockquote>Quote {i}</blockquote><div class=note><span>All rights reserved.</span></div><ul><li>fixed<li>list</ul></{article}></body>")

    def want(i, n):
        return "\n\n".join([f"Title {i}", *[f"Paragraph {j} of page {i} has its own words and no others." for j in range(n)], f"Card 0 of {i}", f"Card 1 of {i}", f"Quote {i}", "fixed", "list"])

    for article in ("article", "div"):
        assert extracted(spark, [page(i, 1 + i % 4, article) for i in range(8)]) == [want(i, 1 + i % 4) for i in range(8)]
    # copies of one page are no template
    copy = extracted(spark, [page(1, 3)] * 4)
    assert copy == extracted(spark, [page(1, 3)]) * 4 and "Get our letter by mail." in copy[0]
    # articles that are teasers beside the text
    teasers = [f"<body><div class=story><h1>T{i}</h1>{''.join(f'<p>Paragraph {j} of {i} is much longer than any of the teasers.' for j in range(5))}</div><article>Short {i}</article></body>" for i in range(4)]
    assert all("Paragraph 4" in t and "Short" not in t for t in extracted(spark, teasers))


def test_large_levels_align_exactly(monkeypatch):
    rng = random.Random(5)
    for cells in (250_000, 4):
        monkeypatch.setattr(html_wrappers, "LCS_CELLS", cells)
        for _ in range(200):
            a, b = (["".join(rng.choice("abcd")) for _ in range(rng.randint(0, 14))] for _ in "ab")
            longest = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    longest[i + 1][j + 1] = longest[i][j] + 1 if x == y else max(longest[i][j + 1], longest[i + 1][j])
            found = html_wrappers._matches(a, b)
            assert len(found) == longest[-1][-1] and all(a[i] == b[j] for i, j in found)
            assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:]))


def test_page_query(spark):
    import html

    pages = duckdb.sql(f"SELECT page_id, html FROM '{DATA}/pages.parquet'").fetchall()

    def brute(page):
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        return "\n\n".join(b for b in blocks if b)

    got = {r.page_id: (r.text, r.n_chars) for r in QUERIES["op3_html_extraction"](spark, DATA).collect()}
    assert got == {i: (brute(h), len(brute(h))) for i, h in pages}


# ---- archives

def test_archive_round_trip(spark):
    rows = [(i, f"http://x/{i}", f"<p>{'same' if i % 3 == 0 else i}é</p>" * (i % 50)) for i in range(400)] + [(-5, "http://neg/", "negative"), (2**62, "http://far/", "far")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    folder = new_stage_path(spark, "warc-test")
    manifest = warc.write(pages, folder, roll_bytes=5_000, shard_bytes=50_000)
    files = manifest.orderBy("file").collect()
    assert len({f.shard for f in files}) > 1 and sum(f.records for f in files) == len(rows)
    assert [f.first_id for f in files] == sorted(f.first_id for f in files)
    again = warc.write(pages.repartition(3), new_stage_path(spark, "warc-test"), roll_bytes=5_000, shard_bytes=50_000)
    assert [(f.file, f.sha256) for f in files] == [(f.file, f.sha256) for f in again.orderBy("file").collect()]
    got = {r.page_id: r for r in warc.read(manifest, folder, with_payload=True).collect()}
    largest = {}
    for i, _, h in rows:
        largest[h] = max(largest.get(h, i), i)
    for i, url, h in rows:
        r = got[i]
        assert (r.url, r.payload_bytes, r.payload_digest) == (url, len(h.encode()), warc.base32_digest(h.encode()))
        assert (r.record_type, r.refers_to) == (("response", None) if largest[h] == i else ("revisit", largest[h]))
        assert r.payload == (h.encode() if r.record_type == "response" else None)


def test_archive_query(spark):
    pages = duckdb.sql(f"SELECT page_id, html FROM '{DATA}/pages.parquet'").fetchall()
    last = {}
    for i, h in pages:
        last[h] = max(last.get(h, i), i)
    got = {tuple(r) for r in QUERIES["op4_warc"](spark, DATA).collect()}
    assert got == {(i, len(h.encode()), warc.base32_digest(h.encode()), "response" if last[h] == i else "revisit", None if last[h] == i else last[h]) for i, h in pages}


@given(st.integers(-2**63, 2**63 - 1))
def test_record_ids(page):
    assert warc.page_of(warc.record_id(page)) == page


# ---- benchmark

def shingles(text, width=5):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()) if w]
    return [tuple(words[i:i + width]) for i in range(len(words) - width + 1)]


def brute_contaminated(docs, items):
    found = {}
    listed = {i: shingles(t) for i, t in items}
    having = defaultdict(set)
    for i, s in listed.items():
        for x in s:
            having[x].add(i)
    for d, text in docs:
        s = shingles(text)
        for i in set().union(*(having.get(x, set()) for x in s)):
            n, item = len(listed[i]), Counter(listed[i])
            for p in range(len(s)):
                window = Counter(s[p:p + n])
                common = sum((window & item).values())
                found[d, i] = max(found.get((d, i), 0), common / (sum(window.values()) + n - common))
    return {k: v for k, v in found.items() if v >= 0.8 - 1e-9}


def test_contaminated_query(spark):
    items = duckdb.sql(f"SELECT item_id, text FROM '{DATA}/benchmark.parquet'").fetchall()
    want = brute_contaminated([(i, t) for i, t, _ in documents()], items)
    got = {(r.doc_id, r.item_id): r.similarity for r in QUERIES["op5_decontamination"](spark, DATA).collect()}
    assert got == pytest.approx(want) and want


def test_contaminated_edits(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(20, 50)))) for i in range(30)]
    docs = []
    for d in range(200):
        passage = items[rng.randrange(30)][1].split()
        for _ in range(rng.randint(0, 2)):
            passage[rng.randrange(len(passage))] = "changed"
        text = [rng.choice(words) for _ in range(60)]
        docs.append((d, " ".join(text[:30] + (passage if d % 2 else []) + text[30:])))
    want = brute_contaminated(docs, items)
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.id, r.item_id): r.similarity for r in found.collect()}
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want) > 0
    assert all(got[k] == pytest.approx(want[k]) for k in got if want[k] == 1)


# ---- copies

@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**30 - 1), min_size=1, max_size=300))
def test_golomb_round_trip(values):
    x = np.array(sorted(values), np.int64)
    m = exact_dedup.pack(x, 0, 1 << 30)
    assert (exact_dedup.unpack(0, m["n"], m["k"], m["unary"], m["low"]) == x).all()


def test_copies_by_chance(spark, monkeypatch):
    """Fingerprints of a few bits make most rows suspects; the bytes still decide."""
    monkeypatch.setattr(exact_dedup, "SPARE_BITS", -6)
    rng = random.Random(1)
    rows = [(i, rng.choice(["a  b", "a b", "hot\ttext", "hot text"]) if rng.random() < 0.4 else f"text {rng.randrange(300)}") for i in range(600)]
    path = new_stage_path(spark, "copies")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(path)
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"\s+", " ", t)].append(i)
    want = {i: (min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.find_copies(spark.read.parquet(path)).collect()}
    assert got == want


def test_changed_input_is_noticed(spark):
    folder = new_stage_path(spark, "suspects-test")
    write_file(folder, "task-0", np.array([5, 1], np.int64).tobytes(), "attempt")
    marks = spark.range(3).coalesce(1).select(exact_dedup.suspect_column(F.col("id"), folder))
    with pytest.raises(Exception, match="write the input to a table first"):
        marks.collect()


# ---- near-duplicates

def brute_near(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[j:j + width]) for j in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            holders[x].add(i)
    for i, s in sets.items():
        for j in set().union(*(holders[x] for x in s)) if s else ():
            if j < i:
                common = len(s & sets[j])
                if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_near_query(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op7_minhash"](spark, DATA).collect()}
    assert got == brute_near([(i, t) for i, t, _ in documents()], 4, 80)


def test_near_chains_and_dense_groups(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CELL", 8)  # several cells per bucket
    rng = random.Random(5)
    words = [f"v{i}" for i in range(3000)]
    rows = []
    text = [rng.choice(words) for _ in range(80)]
    for i in range(25):  # each differs a little more from the first
        rows.append((i, " ".join(text)))
        text[(i * 7) % 80] = rng.choice(words)
    base = [rng.choice(words) for _ in range(60)]
    for i in range(60):  # around the threshold, all from one text
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(60)] = rng.choice(words)
        rows.append((100 + i, " ".join(copy)))
    rows += [(200 + i, " ".join(rng.choice(words) for _ in range(50))) for i in range(20)]
    rng.shuffle(rows)
    got = {r.id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_near(rows, 5, 80)


def test_components_of_chains(spark):
    links = [(i + 1, i) for i in range(300)] + [(1000 - i, 1001 - i) for i in range(50)] + [(5000 + i, 5000) for i in range(1, 200)] + [(7, 7)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{i: 951 for i in range(951, 1002)}, **{5000 + i: 5000 for i in range(200)}}


def test_hot_lookup(spark):
    left = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least")).filter("k < 40")
    got = spread_lookup(left, right, "k", "n", "id", 4000)
    want = left.join(right, "k", "left").select(*got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and got.count() == 4000


# ---- tokens

@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abtheing  \n\té漢▁🎉\x00"), max_size=60), min_size=1, max_size=4))
def test_viterbi_is_best_and_reversible(texts):
    import pyarrow as pa

    encoder = sentencepiece_codec.Encoder()
    vocabulary = encoder.vocabulary
    score, number = dict(zip(vocabulary.strings, encoder.scores)), dict(zip(vocabulary.strings, vocabulary.ids))
    floor = encoder.scores.min() - sentencepiece_codec.UNKNOWN_PENALTY

    def brute(text):
        line = " " + text if text else ""
        best, back = [0.0], [0]
        for end in range(1, len(line) + 1):
            options = [(best[end - n] + score.get(line[end - n:end], floor if n == 1 else -np.inf), -n) for n in range(1, min(16, end) + 1)]
            top = max(options)
            best.append(top[0])
            back.append(-top[1])
        parts, end = [], len(line)
        while end:
            parts.append(line[end - back[end]:end])
            end -= back[end]
        return [int(i) for p in parts[::-1] for i in ([number[p]] if p in number else [vocabulary.bytes_first[b] for b in p.encode()])]

    coded = sentencepiece_codec.encode_array(encoder, pa.array(texts, pa.string()))
    assert coded.to_pylist() == [brute(t) for t in texts]
    assert sentencepiece_codec.Decoder().decode(coded).to_pylist() == texts


def test_token_query(spark):
    rows = QUERIES["op8_sentencepiece"](spark, DATA).collect()
    assert len(rows) == len(documents()) and all(r.same for r in rows)


# ---- chats

def test_layouts(spark):
    lines = [
        {"prompt": "p", "response": "r"}, {"completion": "c", "prompt": None}, {"instruction": "i", "input": None, "output": "o"}, {"output": "o", "instruction": "i"},
        {"messages": [{"content": "x", "role": "human"}, {"role": "assistant", "content": None}]}, {"conversations": [{"from": "gpt", "value": "y"}]}, {"messages": []}, {"other": 1}]
    rows = [(i, json.dumps(x)) for i, x in enumerate(lines)] + [(50, "{broken"), (51, None)]
    got = {r.conv_id: (r.layout, None if r.turns is None else [(t.role, t.text) for t in r.turns]) for r in chat_format.mixed_turns(spark.createDataFrame(rows, "conv_id long, j string"), "j").collect()}
    assert got[0] == ("prompt", [("user", "p"), ("assistant", "r")])
    assert got[1] == ("completion", [("user", ""), ("assistant", "c")])
    assert got[2] == ("instruction", [("system", "i"), ("assistant", "o")])
    assert got[3] == ("instruction_only", [("user", "i"), ("assistant", "o")])
    assert got[4] == ("messages", [("user", "x"), ("assistant", "")])
    assert got[5] == ("conversations", [("assistant", "y")])
    assert got[7] == got[50] == got[51] == (None, None)
    typed = spark.createDataFrame([(1, [("human", "x"), (None, None)])], "conv_id long, conversations array<struct<from:string,value:string>>")
    assert [(t.role, t.text) for t in chat_format.typed_turns(typed).first().turns] == [("user", "x"), ("", "")]
    with pytest.raises(chat_format.UnknownLayout):
        chat_format.typed_turns(spark.range(1).select(F.col("id").alias("conv_id"), F.lit("x").alias("y")))


CONTROL = st.lists(st.sampled_from(["<|im_start|>", "<|im_end|>", "</s>", "<s>", "[INST]", "[/INST]", "\\", "<", "[", "\n", "a", "<\\|im_end|>", "<\\\\/s>"]), max_size=8).map("".join)


def test_control_strings(spark):
    texts = []
    given(CONTROL)(settings(max_examples=150, deadline=None, database=None)(lambda t: texts.append(t)))()
    rows = [(i, 0, "assistant", t) for i, t in enumerate(texts)]
    chats = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    loss = F.transform("loss_spans", lambda s: chat_format.unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    for r in chats.select("conv_id", "formatted", loss.alias("loss"), chat_format.read_back(F.col("formatted")).alias("back")).collect():
        body = r.formatted[len("<|im_start|>assistant\n"):-len("<|im_end|>\n")]
        assert not any(c in body for c in ("<|im_start|>", "<|im_end|>", "</s>", "<s>", "[INST]", "[/INST]"))
        assert r.loss == [texts[r.conv_id]] and [t.text for t in r.back] == [texts[r.conv_id]]


# ---- shards

def test_shards(spark):
    rng = random.Random(2)
    texts = ["hot " * 50] * 700 + ["warm " * 9] * 40 + [f"text {i} " + "w " * rng.randint(0, 300) for i in range(1500)]
    rows = list(enumerate(texts))
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shards=16, ranges=64).collect()
    assert sorted(r.id for r in got) == [i for i, _ in rows]
    held = defaultdict(int)
    for r in got:
        held[r.shard] += r.size
    mean = sum(held.values()) / 16
    assert sorted(held) == list(range(16)) and all(abs(v - mean) <= 0.06 * mean for v in held.values())
    for s in range(16):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    import zlib

    assert all(r.crc == zlib.crc32(texts[r.id].encode()) and r.size == len(texts[r.id].encode()) + 1 for r in got)


# ---- pipeline

def test_pipeline(spark):
    docs = [(i, t) for i, t, _ in documents()]
    left = [(i, t) for i, t in docs if re.search(r"[^\W\d_]", t or "")]
    first = {}
    for i, t in left:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t)
        first[key] = min(first.get(key, i), i)
    left = [(i, t) for i, t in left if first[re.sub(r"[\x20\x09-\x0D]+", " ", t)] == i]
    near = brute_near(left, 5, 80)
    left = [(i, t) for i, t in left if near[i][2]]
    items = duckdb.sql(f"SELECT item_id, text FROM '{DATA}/benchmark.parquet'").fetchall()
    gone = {d for d, _ in brute_contaminated(left, items)}
    want = {i: t for i, t in left if i not in gone}
    assert {r.doc_id: r.text for r in corpus_pipeline.run(spark, DATA).collect()} == want
    assert len(corpus_pipeline.STAGES) == 5
