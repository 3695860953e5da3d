"""Text expressions against their plain forms, and that a key is computed once per row."""

import random

from pyspark.sql import functions as F

from newsloom import rules
from newsloom.functions import text as tx
from newsloom.operators import dedup as dd


def plain_collapse(c):
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"{tx.SPACE}+", " "))


def plain_noise(c):
    pattern = tx.js_pattern(r"(?is)\bThe post\s+.+?\s+appeared first on\s+[^.?!]+[.?!]?")
    return plain_collapse(F.regexp_replace(F.coalesce(c, F.lit("")), pattern, " "))


def plain_headline(c):
    return plain_collapse(F.regexp_replace(F.coalesce(c, F.lit("")), rf"{tx.SPACE}+-{tx.SPACE}+[^-]+$", ""))


def plain_alnum(c, limit):
    return F.substring(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " ")), 1, limit)


def plain_key(c):
    text = F.regexp_replace(F.lower(plain_collapse(c)), tx.URL_TOKEN, " ")
    words = F.filter(F.split(F.trim(F.regexp_replace(text, "[^a-z0-9]+", " ")), " +"), lambda w: F.length(w) > 2)
    return F.when(F.size(words) < 8, F.lit("")).otherwise(F.array_join(F.slice(words, 1, 42), " "))


def texts():
    rng = random.Random(5)
    pieces = ["a", "of", "word", "Longer", "ÜBER", "İst", "https://x.example/a-b?c=d", "The post", "breathe post", "appeared first on", "Site.", "x & y", " - ", "-", "--", "No usable text", "transcript unavailable", "ai", "\U0001F600"]
    gaps = [" ", " ", " ", "  ", "\t", "\n", " \n ", " ", "  ", " ﻿", "　", "", "\x0b", "\x85"]
    out = [None, "", " ", " ", "-", " - ", "a -  b ", "x" * 5000, "ab " * 900 + "last words come only here " * 20]
    for n in (3, 9, 40, 200, 600):
        out += ["".join(rng.choice(pieces) + rng.choice(gaps) for _ in range(n)) for _ in range(60)]
    return out


def test_expressions(spark):
    c = F.col("t")
    pairs = {
        "collapse": (tx.collapse(c), plain_collapse(c)), "noise": (tx.strip_noise(c), plain_noise(c)), "headline": (tx.source_headline(c), plain_headline(c)),
        "mark": (tx.alnum_key(c, 180), plain_alnum(c, 180)), "mark120": (tx.alnum_key(c, 120), plain_alnum(c, 120)), "key": (tx.content_key(c), plain_key(c)),
        "count": (tx.collapsed_count(tx.collapse(c)), tx.word_count(tx.collapse(c))),
        "unusable": (tx.any_match(tx.collapse(c), [rules.UNUSABLE_TEXT_PATTERN]), tx.collapse(c).rlike("(?i)" + tx.js_pattern(rules.UNUSABLE_TEXT_PATTERN))),
    }
    rows = spark.createDataFrame([(t,) for t in texts()], "t string").select("t", *[F.struct(a.alias("a"), b.alias("b")).alias(k) for k, (a, b) in pairs.items()])
    for r in rows.collect():
        for k in pairs:
            assert r[k].a == r[k].b, (k, r.t)


def test_keys_are_staged_once(spark, monkeypatch):
    staged, real = {}, dd.stage
    monkeypatch.setattr(dd, "stage", lambda df, name: staged.setdefault(name, df) and real(df, name))
    items = spark.createDataFrame([(1, "https://a.example/x", "one two three four five six seven eight"), (2, "https://a.example/x", "other")], "id bigint, url string, text string")
    assert [r.id for r in dd.dedupe_citations_like(items, "id", "url", F.col("text")).collect()] == [1]
    # the first round reads keys, it does not compute them from the texts again
    assert "split" not in staged["two-key-open"]._jdf.queryExecution().optimizedPlan().toString()


def test_dictionary_reads_a_text_once(spark):
    rows = spark.createDataFrame([(1, "Ada  and Bob"), (2, None)], "id bigint, t string")
    found = rows.select("id", tx.known_entities(tx.collapse(F.col("t")), [("ada", "Ada"), ("bob", "Bob"), ("zed", "Zed")]).alias("e"))
    assert {r.id: r.e for r in found.collect()} == {1: ["Ada", "Bob"], 2: []}
    # the text was lower-cased, and its expression evaluated, once for every name
    assert "contains(lower(" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
