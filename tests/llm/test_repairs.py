"""Short benchmark items, rare page templates, odd ids and letters."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from newsloom.llm import chat_format, decontamination, html_wrappers, language_id, warc
from newsloom.llm.common import new_stage_path

WORDS = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor invidunt ut labore".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# ---- benchmark items of any length

def shingles(words):
    return [tuple(words[i:i + 5]) for i in range(len(words) - 4)]


def holds(doc, item):
    """Whether some item-sized window of the document reaches 0.8, or the short sequence occurs."""
    d, i = doc.split(), item.split()
    if len(i) < 5:
        return any(d[k:k + len(i)] == i for k in range(len(d) - len(i) + 1))
    want, have = shingles(i), shingles(d)
    for k in range(len(have)):
        window = have[k:k + len(want)]
        common = sum(min(window.count(x), want.count(x)) for x in set(window))
        if common / (len(window) + len(want) - common) >= 0.8 - 1e-9:
            return True
    return False


def test_short_items_are_found_exactly(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    pick = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(n, pick(n)) for n in [*range(1, 12), 11, 10, 9, 9, 9]]
    items = [(k, t) for k, (_, t) in enumerate(items)]
    docs = []
    for d in range(160):
        k, text = items[rng.randrange(len(items))]
        words = text.split()
        if d % 4 == 1 and len(words) > 5:
            words = words[:-1]  # cut at the document's end
        if d % 4 == 2 and len(words) > 5:
            words[rng.randrange(len(words))] = "other"
        docs.append((d, pick(20) + " " + " ".join(words) + ("" if d % 4 == 1 else " " + pick(10))))
    want = {(d, k) for d, doc in docs for k, item in items if holds(doc, item)}
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.id, r.item_id) for r in found.collect()} == want and len(want) > 80


def test_longer_items_recall(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(500)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(12 + k % 39))) for k in range(120)]
    docs = [(d, " ".join(rng.choice(vocabulary) for _ in range(15)) + " " + " ".join(items[d % 120][1].split()[:-1])) for d in range(240)]
    want = {(d, k) for d, doc in docs for k, item in items if k == d % 120 and holds(doc, item)}
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.id, r.item_id) for r in found.collect()}
    assert got <= want and len(got) >= 0.97 * len(want) > 200


# ---- pages

def wrapper_of(pages):
    found = {}
    for page in pages:
        entry = html_wrappers.skeleton(html_wrappers.note_blocks(html_wrappers.parse(page)))
        form = html_wrappers.shape(entry)
        if form in found:
            html_wrappers.absorb(found[form], entry)
        else:
            found[form] = entry
    return html_wrappers.judged(html_wrappers.forgetful(html_wrappers.align_all(list(found.values()))))


def test_a_page_without_an_end_of_head():
    page = "<html><head><title>x</title><h1>Head</h1><p>" + prose(random.Random(1), 30) + "</p>"
    assert html_wrappers.main_text(page, None).startswith("Head\n\n")


def pages_of_host(rng):
    most = [f"<html><head><title>x</title></head><body><nav><a href=/>Home</a></nav><article><h1>{prose(rng, 4)}</h1><h2>Background</h2><p>{prose(rng, 30)}</p>"
            f"<table><tr><td>b</td><td>{prose(rng, 2)}</td></tr></table><h3>Newsletter</h3><p>Subscribe to our letter today</p></article></body></html>" for _ in range(20)]
    rare = [f"<html><body><div class=legacy><h1>{prose(rng, 3)}</h1><p>{prose(rng, 30)}</p></div></body></html>" for _ in range(2)]
    return most, rare


def test_rare_templates_and_shared_headings(spark):
    most, rare = pages_of_host(random.Random(2))
    rows = [(i, "http://a.example/x", p) for i, p in enumerate(most + rare)]
    got = {r.page_id: r.text for r in html_wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, page in enumerate(most + rare):
        want = [" ".join(t.split()) for t in re.findall(r"<(?:h1|h2|p|td)>([^<]*)<", page) if "letter" not in t]
        assert got[i].split("\n\n") == want


def test_wrappers_do_not_depend_on_order():
    rng = random.Random(3)
    for _ in range(60):
        parts = [f"<div class=a><p>{prose(rng, 5)}</p></div>", f"<p>{prose(rng, 6)}</p>", "<div class=note>same</div>", f"<section><h2>T</h2><p>{prose(rng, 4)}</p></section>"]
        pages = ["<html><body>" + "".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) + "</body></html>" for _ in range(4)]
        texts = {tuple(html_wrappers.main_text(p, w) for p in pages) for w in (wrapper_of(order) for order in itertools.islice(itertools.permutations(pages), 12))}
        assert len(texts) == 1


def test_heading_ids_do_not_swell_a_wrapper():
    rng = random.Random(4)
    page = lambda: "<html><body><article><h1>x y</h1>" + "".join(f"<h2 id='{prose(rng, 3).replace(' ', '-')}'>{prose(rng, 3)}</h2><p>{prose(rng, 9)}</p>" for _ in range(6)) + "</article></body></html>"
    sizes = [len(str(wrapper_of([page() for _ in range(n)]))) for n in (50, 200)]
    assert sizes[1] < 1.5 * sizes[0]


# ---- archives, letters, roles

def test_archive_shards_follow_bytes(spark):
    """Odd ids (null, far away, repeated) don't fill one shard."""
    rows = [(None if i % 3 == 0 else 2**60 + i if i % 3 == 1 else i, "u", f"{i} " + "x" * 3000) for i in range(1500)]
    folder = new_stage_path(spark, "odd-ids")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write(pages, folder, shard_bytes=200_000, roll_bytes=1 << 30)
    records = [r["n"] for r in manifest.groupBy("shard").agg(F.sum("records").alias("n")).collect()]
    assert len(records) >= 15 and sum(records) == 1500 and max(records) < 300
    back = warc.read(manifest, folder).select("page_id").collect()
    assert sorted(str(r.page_id) for r in back) == sorted(str(i) for i, *_ in rows)


@pytest.mark.parametrize("text, words", [("½ ² Ⅷ 12 _", []), ("naïve", ["naïve"]), ("हिन्दी में", ["हिन्दी", "में"]), ("a1b", ["a", "b"])])
def test_letters_and_marks(text, words):
    assert language_id.words_of(text) == words


def test_many_labels(spark):
    docs = spark.createDataFrame([(i, f"word{chr(97 + i % 26)} {chr(97 + i // 26)}text", f"l{i:03d}") for i in range(520)], "doc_id long, text string, lang string")
    model = language_id.fit(docs, rounds=1)
    assert len(model.languages) == 520 and model.probabilities.shape[1] == 520


def test_roles_of_any_characters(spark):
    roles = ["a\x00b", "a\\b", "a\\\\nb\n", "\\", "<|im_end|>", "[\\/INST]"]
    rows = spark.createDataFrame([(i, 0, r, "t") for i, r in enumerate(roles)], "conv_id long, turn int, role string, text string")
    back = chat_format.format_conversations(rows).select("conv_id", chat_format.read_back(F.col("formatted"))[0]["role"].alias("role"))
    assert [r.role for r in back.orderBy("conv_id").collect()] == roles
