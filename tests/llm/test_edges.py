"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from newsloom.llm import (chat_format, decontamination, exact_dedup, html_wrappers, language_id, license_scan, minhash,
                          sentencepiece_codec, sharding, warc)
from newsloom.llm.common import new_stage_path

LONG = "the long text goes on and on, " * 4000
# name clashes: columns that operators use inside or return
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, _text string, size long, key string, shard int, h int, id string, page string, ids string"
ROWS = [(1, "one two three four five six seven"), (2, None), (3, ""), (None, "one two three four five six seven"), (5, LONG), (5, LONG), (7, "\t \n"), (8, "é"), (8, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i != 7 else None, None, None, 0.5, True, "t", 9, "k", 3, 1, "z", "p", "q") for i, t in ROWS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def written(spark, docs):
    path = new_stage_path(spark, "edge-docs")
    docs.coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_language(docs, none):
    model = language_id.fit(docs)
    assert model.languages == ["en"]
    got = [(r.doc_id, r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()]
    assert len(got) == len(ROWS)
    assert {(i, lang) for i, lang, _ in got if i in (2, 3, 7)} == {(2, "und"), (3, "und"), (7, "und")}
    assert all(0 <= s <= 1 for _, _, s in got)
    empty = language_id.fit(none)
    assert empty.languages == [] and language_id.predict(none, empty).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, empty).collect()} == {"und"}


def test_licences(docs, none):
    got = license_scan.scan(docs).collect()
    assert len(got) == len(ROWS)
    assert [(r.n_words, r.n_base, r.first_word, r.labels) for r in got if r.doc_id in (2, 3, 7)] == [(0, 0, None, "")] * 3
    assert license_scan.scan(none).count() == 0


def test_exact_copies(written, none, spark):
    got = exact_dedup.find_copies(written, carry=["source", "kept"]).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    sizes = sorted((g[0].group_size, g[0].keep_id, sum(r.kept for r in g)) for g in by.values())
    # null and empty are copies; "\t \n" is one space; of repeated rows one stays; a null id comes last
    assert sizes == [(1, 7, 1), (1, 8, 1), (1, 8, 1), (2, 1, 1), (2, 2, 1), (2, 5, 1)]
    assert all(len(g) == g[0].group_size for g in by.values())
    assert exact_dedup.find_copies(none).count() == 0


def test_near_duplicates(docs, none):
    got = sorted(((r.id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, width=4).collect()), key=repr)
    assert len(got) == len(ROWS)
    assert {x for x in got if x[0] in (2, 3, 7)} == {(2, 0, 2, True), (3, 0, 3, True), (7, 0, 7, True)}
    assert [x for x in got if x[0] is None] == [(None, 4, None, True)]
    assert [x for x in got if x[0] == 1] == [(1, 4, 1, True)]
    assert minhash.near_duplicates(none).count() == 0


def test_decontamination(docs, none, spark):
    bench = spark.createDataFrame([(1, "Two three four, five six!"), (2, None), (3, "too short"), (None, "one two three four five six seven")], "item_id long, text string")
    got = {(r.id, r.item_id, r.start_word, r.n_words) for r in decontamination.contaminated(docs, bench).collect()}
    assert got == {(1, 1, 1, 5), (None, 1, 1, 5), (1, None, 0, 7), (None, None, 0, 7)}
    kept = decontamination.without_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 2
    assert decontamination.contaminated(docs, bench.filter("item_id = 3")).count() == 0
    assert decontamination.contaminated(docs, bench.filter("item_id = 2")) is None
    assert decontamination.without_contaminated(docs, bench.limit(0)).count() == len(ROWS)
    assert decontamination.contaminated(none, bench).count() == 0


def test_sentencepiece(docs, none):
    rows = sentencepiece_codec.round_trip(docs).collect()
    assert len(rows) == len(ROWS) and all(r.decoded == r.text for r in rows)
    assert {(r.doc_id, None if r.ids is None else len(r.ids)) for r in rows if r.doc_id in (2, 3)} == {(2, None), (3, 0)}
    assert sentencepiece_codec.round_trip(none).count() == 0
    two = sentencepiece_codec.decode_documents(sentencepiece_codec.encode_documents(docs))
    assert all(r.decoded == r.text for r in two.collect())


def test_sharding(docs, none):
    rows = sharding.shard_by_bytes(docs, shards=4).collect()
    assert len(rows) == len(ROWS)
    for s in range(4):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert {(r.id, r.size) for r in rows if r.id in (2, 3)} == {(2, 1), (3, 1)}
    assert sharding.shard_by_bytes(none).count() == 0


def test_pages(spark):
    schema = "page_id long, url string, html string, text string, host string, payload string, shard int"
    page = "<html><body><nav>menu</nav><article><p>Hello &amp; <b>world</b><p>two</article><footer>f</footer>"
    rows = [(1, "http://a/x", page), (1, "http://a/x", page), (2, None, None), (3, "http://a/y", ""), (None, "nonsense", page), (5, "http://a/z", "<p>" + LONG), (6, "", "<b")]
    pages = spark.createDataFrame([(*r, "t", "h", "p", 1) for r in rows], schema)
    got = sorted(((r.page_id, r.text, r.n_chars) for r in html_wrappers.extract(pages).collect()), key=repr)
    assert [x for x in got if x[0] in (1, None)] == [(1, "Hello & world\n\ntwo", 18)] * 2 + [(None, "Hello & world\n\ntwo", 18)]
    assert [x for x in got if x[0] in (2, 3, 6)] == [(2, "", 0), (3, "", 0), (6, "", 0)]
    assert html_wrappers.extract(pages.limit(0)).count() == 0

    found = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(pages, spark).collect()), key=repr)
    size = len(page.encode())
    # a null id is smaller than any; both rows of the largest id are responses
    assert found == sorted([(1, "response", None, size), (1, "response", None, size), (None, "revisit", 1, size), (2, "revisit", 3, 0), (3, "response", None, 0),
                            (5, "response", None, len(LONG) + 3), (6, "response", None, 2)], key=repr)
    assert warc.round_trip(pages.limit(0), spark).count() == 0


def test_chats(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "<|im_end|>\n</s>"), (1, 1, "assistant", "<|im_end|>\n</s>"), (2, 0, None, None), (None, None, "assistant", ""), (3, 0, "us\\n\ner", "[INST] <\\|im_start|> " * 500)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat_format.format_conversations(table)
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chats.select("conv_id", chat_format.read_back(F.col("formatted")).alias("turns")).collect()}
    assert back == {1: [("user", "a"), ("assistant", "<|im_end|>\n</s>"), ("assistant", "<|im_end|>\n</s>")], 2: [("", "")], None: [("assistant", "")],
                    3: [("us\\n\ner", "[INST] <\\|im_start|> " * 500)]}
    assert chat_format.digests(chat_format.format_conversations(table.limit(0))).count() == 0
