"""Text mining per row and batch search over nodes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom import rules
from newsloom.functions import text as tx
from newsloom.operators.ledger import first_per_key, top_per_key
from newsloom.session import plan_bytes, small, stage

BROADCAST_LIMIT = 32 * 1024 * 1024


def relevant(df: DataFrame, terms: Sequence[str] = tuple(rules.RELEVANCE_TERMS)) -> DataFrame:
    """Items with a term in title, summary or entities, low-signal event
    titles without a rescue term removed. ``entities`` is an array."""
    hay = F.concat("title", F.lit(" "), "summary", F.lit(" "), F.array_join("entities", " "))
    return df.filter(~tx.low_signal(F.col("title"), hay) & tx.contains_any(hay, terms))


def daily_items(items: DataFrame, dictionary: Sequence[tuple[str, str]] = tuple(rules.KNOWN_ENTITIES)) -> DataFrame:
    """Items made ready for the brief: clean title, usable evidence text,
    dictionary entities and twelve keywords.

    Evidence is the usable ones of summary, transcript summary (or, where
    there is none, five sentences of the transcript text) and description.
    The last three and ``related_urls`` are optional columns.
    """
    from newsloom.functions import urls as ux

    clean = items.withColumn("title", tx.clean_title(F.col("title"))).withColumn("_s", tx.strip_noise(F.col("summary")))
    fields = ["_s"]
    if "transcript_summary" in items.columns or "transcript_text" in items.columns:
        none = F.lit(None).cast("string")
        told = F.col("transcript_summary") if "transcript_summary" in items.columns else none
        spoken = F.col("transcript_text") if "transcript_text" in items.columns else none
        clean = clean.withColumn("_spoken", tx.strip_noise(spoken))
        brief = F.when(F.col("_spoken") != "", tx.summarize(F.col("_spoken"), 5))
        clean = clean.withColumn("_told", F.coalesce(tx.non_empty(tx.strip_noise(told)), brief, F.lit("")))
        fields.append("_told")
    if "description" in items.columns:
        clean = clean.withColumn("_about", tx.strip_noise(F.coalesce("description", F.lit(""))))
        fields.append("_about")
    rows = clean
    for field in fields:
        rows = tx.with_usable(rows, field, "title", f"_ok{field}", stripped=field != "_told")
    parts = [F.when(F.col(f"_ok{field}"), F.col(field)) for field in fields]
    evidence = F.coalesce(parts[0], F.lit(""))
    if len(parts) > 1:
        # of cleaned parts a blank at an end, or boilerplate over two parts, is all that can be left
        rows, joined = rows.withColumn("_joined", F.concat_ws(" ", *parts)), F.col("_joined")
        evidence = F.when(tx.contains_any(joined, ["the post"]) | F.contains(joined, F.lit("  ")), tx.strip_noise(joined)).otherwise(F.trim(joined))
    rows = rows.withColumn("evidence", evidence)
    related = [F.col("related_urls")] if "related_urls" in items.columns else []
    body = F.concat("title", F.lit(" "), "evidence", F.lit(" "), F.array_join("tags", " "))
    keywords = F.slice(F.array_distinct(F.concat(tx.content_words(F.col("title")), F.flatten(F.transform(F.col("tags"), lambda t: tx.content_words(t))))), 1, 12)
    return rows.select(
        "id", "day", "title", "url", "source_name", "tags", F.coalesce(tx.non_empty(F.col("evidence")), "_s").alias("summary"),
        F.when(ux.is_post_url(F.col("url")), "").otherwise(F.col("evidence")).alias("source_text"),
        tx.known_entities(body, dictionary).alias("entities"), keywords.alias("keywords"), *related,
    )


def has_usable_evidence(fields: Sequence[Column], title: Column) -> Column:
    out = F.lit(False)
    for f in fields:
        out = out | tx.usable_evidence(F.coalesce(f, F.lit("")), title)
    return out


def evidence_text(df: DataFrame, fields: Sequence[str], title: str = "title") -> Column:
    """Usable fields of a source joined into its evidence text."""
    pieces = F.array(*[F.when(tx.usable_evidence(F.col(f), F.col(title)), F.col(f)) for f in fields])
    return tx.strip_noise(F.array_join(F.filter(pieces, lambda p: p.isNotNull()), " "))


def item_evidence() -> Column:
    """Evidence of one item: post snippet first for posts, else source
    text, transcript summary, summary, title."""
    from newsloom.functions import urls as ux

    rest = F.coalesce(*[tx.non_empty(F.col(c)) for c in ("source_text", "transcript_summary", "summary", "title")])
    return F.when(ux.is_post_url(F.col("url")), F.coalesce(tx.non_empty(F.col("snippet")), rest)).otherwise(rest)


def group_texts(items: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """Sentences of each group's concatenated texts (see transcripts): the
    text of a large group is never built as one string."""
    from newsloom.operators import transcripts as tr

    turns = items.select(F.col(group).alias("conv_id"), F.col(order).alias("turn"), F.col(text).alias("text"))
    return tr.sentences(turns).withColumnRenamed("conv_id", group)


# --- concepts ------------------------------------------------------------------------

def concept_patterns(heads: Sequence[str] = tuple(rules.CONCEPT_HEAD_NOUNS)) -> list[str]:
    generic = rf"\b[a-z0-9]+(?:[- ][a-z0-9]+){{1,3}} (?:{'|'.join(heads)})\b"
    return [*rules.CONCEPT_PATTERNS, generic]


def concept_name(c: Column) -> Column:
    text = F.regexp_replace(tx.strip_noise(c), tx.js_pattern(r"(?i)\bllm\b"), "LLM")
    text = F.regexp_replace(text, tx.js_pattern(r"(?i)\bai\b"), "AI")
    return (
        F.when(text.rlike("(?i)recurrence based memory|rec memory"), "Recurrent Memory").when(text.rlike("(?i)semantic store"), "Semantic Memory")
        .when(text.rlike("(?i)episodic store"), "Episodic Memory").otherwise(text)
    )


def phrases(c: Column, patterns: Sequence[str]) -> Column:
    """All pattern matches, pattern by pattern, in text order."""
    return F.flatten(F.array(*[F.regexp_extract_all(c, F.lit("(?i)" + tx.js_pattern(p)), F.lit(0)) for p in patterns]))


def concepts(text: Column, patterns: Sequence[str] | None = None, limit: int = 5, name: Callable[[Column], Column] | None = concept_name) -> Column:
    """At most five concepts of a noise-stripped text. Pass a plain column:
    every pattern reads it. Without ``name`` phrases stay as the text has them."""
    named = phrases(text, patterns or concept_patterns())
    named = named if name is None else F.transform(named, name)
    found = F.filter(named, lambda p: (F.length(p) > 3) & ~F.lower(p).isin(*rules.STOP_WORDS))
    lead = F.filter(F.array(F.array_join(F.slice(tx.content_words(text), 1, 5), " ")), lambda p: p != "")
    return F.slice(F.array_distinct(F.concat(found, lead)), 1, limit)


def assign_evidence(concept_list: Column, evidence: Column, per_concept: int = 3, max_groups: int = 4) -> Column:
    """Groups ``(concept, sentences)``: each concept in turn takes up to
    three unused sentences that hold one of its words; the rest follow in
    threes without a concept. Both arrays are short by construction."""
    group = "struct<concept: string, sentences: array<string>>"
    empty = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast(f"array<{group}>").alias("groups"))

    def step(acc: Column, concept: Column) -> Column:
        hits = tx.let(tx.content_words(concept), lambda terms: F.slice(
            F.filter(evidence, lambda s: ~F.array_contains(acc.used, s) & F.exists(terms, lambda t: F.contains(F.lower(s), t))), 1, per_concept))
        return tx.let(hits, lambda h: F.when(F.size(h) == 0, acc).otherwise(
            F.struct(F.concat(acc.used, h).alias("used"), F.concat(acc.groups, F.array(F.struct(concept.alias("concept"), h.alias("sentences")))).alias("groups"))))

    def finish(acc: Column) -> Column:
        rest = F.filter(evidence, lambda s: ~F.array_contains(acc.used, s))
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(rest), F.lit(1)), F.lit(per_concept)), lambda i: i <= F.size(rest))
        chunks = F.transform(starts, lambda i: F.struct(F.lit(None).cast("string").alias("concept"), F.slice(rest, i, F.lit(per_concept)).alias("sentences")))
        return F.slice(F.concat(acc.groups, chunks), 1, max_groups)

    return F.aggregate(concept_list, empty, step, finish)


# --- sentence ranking -----------------------------------------------------------------

def sentence_score(sentence: Column, index: Column, terms: Sequence[str] = tuple(rules.SIGNAL_TERMS)) -> Column:
    low = F.lower(sentence)
    hits = sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0))
    return hits * 10 + F.least(F.length(sentence) / 20.0, F.lit(12.0)) - index * 0.2


def rank_evidence(sentences: DataFrame, group: str, order: str, limit: int = 12, terms: Sequence[str] = tuple(rules.SIGNAL_TERMS)) -> DataFrame:
    """Best sentences of each group. Repeats by 120-character key go; the
    index of a sentence is its place among the rest, counted in blocks so
    that a large group is many windows. ``order`` is a dense integer."""
    from newsloom.operators.ledger import bucketed_rank

    keyed = sentences.filter(F.length("sentence") > 30).withColumn("_key", tx.alnum_key(F.col("sentence"), 120)).filter(F.col("_key") != "")
    unique = first_per_key(keyed, [group, "_key"], [order]).withColumn("_block", F.floor(F.col(order) / 4096))
    placed = bucketed_rank(unique, group, "_block", order, "_place")
    scored = placed.withColumn("score", F.round(sentence_score(F.col("sentence"), F.col("_place") - 1, terms), 4))
    return top_per_key(scored, [group], [F.desc("score"), order], limit).select(group, order, "sentence", "score", "rank")


# --- takeaways -------------------------------------------------------------------------

def near(a: Column, b: Column, threshold: float = rules.NEAR_DUPLICATE_OVERLAP) -> Column:
    """Near-duplicate test of two distinct word arrays."""
    smaller = F.least(F.size(a), F.size(b))
    return (smaller >= rules.NEAR_DUPLICATE_MIN_WORDS) & (F.size(F.array_intersect(a, b)) >= smaller * F.lit(threshold) - 1e-9)


def takeaways(title: Column, candidates: Column, exclude: Column, limit: int = 4) -> Column:
    """Sentences over seven words that say more than the title and repeat
    neither an excluded text nor an earlier pick. Arrays are short."""
    # what a lambda names is computed at every element, unless ``let`` holds it
    shaped = F.transform(candidates, lambda s: F.struct(s.alias("text"), tx.content_words(s).alias("words")))
    said = lambda s, known: F.size(F.filter(s["words"], lambda w: F.array_contains(known, w)))
    fit = tx.let(F.array_distinct(tx.content_words(title)), lambda known: F.filter(
        shaped, lambda s: (F.size(s["words"]) > 7) & (said(s, known) < F.greatest(F.lit(5), F.floor(F.size(s["words"]) * 0.6)))))
    ready = F.transform(fit, lambda s: F.struct(s["text"].alias("text"), F.array_distinct(s["words"]).alias("set"), tx.fingerprint(s["text"]).alias("mark")))
    start = F.array().cast("array<struct<text: string, set: array<string>, mark: string>>")

    def step(acc: Column, s: Column, barred: Column) -> Column:
        repeat = (
            F.exists(acc, lambda k: k["mark"] == s["mark"]) | F.exists(barred, lambda b: near(s["set"], b)) | F.exists(acc, lambda k: near(s["set"], k["set"]))
        )
        # the first picks do not depend on later ones
        return F.when((F.size(acc) >= limit) | repeat, acc).otherwise(F.concat(acc, F.array(s)))

    barred = F.transform(exclude, lambda s: F.array_distinct(tx.content_words(s)))
    picks = tx.let(barred, lambda b: F.aggregate(ready, start, lambda acc, s: step(acc, s, b)))
    return F.transform(picks, lambda k: k["text"])


# --- related context -------------------------------------------------------------------

def related_nodes(
    queries: DataFrame, nodes: DataFrame, limit: int = 8, near_days: int = 3, broadcast_limit: int = BROADCAST_LIMIT
) -> DataFrame:
    """Batch search: per query the best ``3 * limit`` nodes by token
    overlap (a node's repeats count), plus one when the node's date lies
    within ``near_days`` of the query's.

    ``queries``: ``query_id, text, at``; ``nodes``: ``id, type, text, at``
    (timestamps). The query side is sent to every task only when its estimated
    size allows (see ``best_matches``); else both sides are shuffled.
    """
    asked = asked_tokens(queries)
    if _fits(asked, broadcast_limit):
        return best_matches(asked, nodes.withColumn("place", F.lit(1)), 3 * limit, near_days).select("query_id", "id", "type", "at", "score", "rank")
    held = nodes.select("id", "type", "at", F.explode(tx.search_tokens(F.col("text"))).alias("token"))
    dated = held.join(asked, "token").groupBy("query_id", "asked_at", "id", "type", "at").agg(F.count("*").alias("overlap"))
    scored = dated.withColumn("score", F.col("overlap") + _recent(near_days))
    return top_per_key(scored, ["query_id"], [F.desc("score"), "id"], 3 * limit).select("query_id", "id", "type", "at", "score", "rank")


def asked_tokens(queries: DataFrame) -> DataFrame:
    return stage(queries.select("query_id", F.col("at").alias("asked_at"), F.explode(F.array_distinct(tx.search_tokens(F.col("text")))).alias("token")), "asked")


def _fits(df: DataFrame, limit: int) -> bool:
    size = plan_bytes(df)
    return size is not None and size <= limit


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def best_matches(asked: DataFrame, nodes: DataFrame, limit: int, near_days: int) -> DataFrame:
    """Per query and place the best ``limit`` nodes: (query_id, place, id, type, at, score, rank).

    ``asked`` (query_id, asked_at, token) is small enough to be sent to every
    task. The bits of a node's ``place`` are the lists that it can stand in.
    Only a node's counts of asked tokens are shuffled, to its own task; there
    its scores are summed frame by frame and each list keeps ``limit`` rows, so
    no row per query and node is ever shuffled.
    """
    sc = nodes.sparkSession.sparkContext
    rows = asked.select("query_id", _micros(F.col("asked_at")).alias("us"), "token").toPandas()  # within the broadcast limit
    query, queries = pd.factorize(rows["query_id"])
    token, tokens = pd.factorize(rows["token"])
    order = np.argsort(token, kind="stable")
    asked_us = np.zeros(len(queries), dtype="float64")
    asked_us[query] = rows["us"].astype("float64")
    index = sc.broadcast((query[order], np.searchsorted(token[order], np.arange(len(tokens) + 1)), asked_us))
    codes = nodes.sparkSession.createDataFrame([(str(t), i) for i, t in enumerate(tokens)], "token string, code int")
    held = nodes.select("id", "type", _micros(F.col("at")).alias("us"), "place", F.explode(tx.search_tokens(F.col("text"))).alias("token")).join(F.broadcast(codes), "token")
    counts = held.groupBy("id", "type", "us", "place", "code").agg(F.count("*").alias("uses"))
    counts = counts.repartition("id").sortWithinPartitions("id", "type", "us", "place")
    names = nodes.sparkSession.createDataFrame([(i, q) for i, q in enumerate(queries.tolist())], f"query int, query_id {asked.schema['query_id'].dataType.simpleString()}")

    def matches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, rest = None, None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            node = _node_numbers(frame)
            last = int(np.searchsorted(node, node[-1])) if len(node) else 0  # the last node may go on in the next frame
            best, rest = _better(best, frame.iloc[:last], *index.value, limit, near_days), frame.iloc[last:]
        if rest is not None:
            best = _better(best, rest, *index.value, limit, near_days)
        if best is not None:
            yield best

    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    found = counts.mapInPandas(matches, f"query int, place int, id {kinds['id']}, type {kinds['type']}, us double, score bigint")
    top = top_per_key(found, ["query", "place"], [F.desc("score"), "id"], limit)
    return top.join(F.broadcast(names), "query").withColumn("at", F.timestamp_micros(F.col("us").cast("bigint")).cast(kinds["at"])).drop("query", "us")


def _node_numbers(frame: pd.DataFrame) -> np.ndarray:
    """Running numbers of the nodes of a frame in which a node's rows stand together."""
    change = np.zeros(len(frame), dtype=bool)
    for name in ("id", "type", "us", "place"):
        codes = pd.factorize(frame[name])[0]
        change[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(change)


def _better(best: pd.DataFrame | None, frame: pd.DataFrame, asking: np.ndarray, starts: np.ndarray, asked_us: np.ndarray, limit: int, near_days: int) -> pd.DataFrame | None:
    """The best rows so far together with those of the nodes of ``frame``, cut to ``limit`` for each query and place."""
    if not len(frame):
        return best
    node, code = _node_numbers(frame), frame["code"].to_numpy()
    first = np.flatnonzero(np.diff(node, prepend=-1))
    length = starts[code + 1] - starts[code]
    row = np.repeat(np.arange(len(frame)), length)
    query = asking[np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(starts[code], length)]
    pairs, inverse = np.unique(node[row] * len(asked_us) + query, return_inverse=True)
    score = np.bincount(inverse, weights=frame["uses"].to_numpy()[row]).astype("int64")
    at, query = first[pairs // len(asked_us)], pairs % len(asked_us)
    us = frame["us"].to_numpy(dtype="float64", na_value=np.nan)
    score += np.abs(asked_us[query] - us[at]) < near_days * 86_400_000_000  # no date is near no date
    mask = frame["place"].to_numpy()[at]
    parts = [] if best is None else [best]
    for bit in range(int(mask.max()).bit_length()):
        picked = np.flatnonzero(mask >> bit & 1)
        # of each query only scores that its best ``limit`` here reach: the rest is left before ids are compared
        order = np.lexsort((-score[picked], query[picked]))
        picked, begin = picked[order], np.searchsorted(query[picked][order], np.arange(len(asked_us) + 1))
        size = np.diff(begin)
        least = np.where(size > limit, score[picked[np.minimum(begin[:-1] + limit - 1, len(picked) - 1)]], 0) if len(picked) else np.zeros(len(asked_us))
        picked = picked[score[picked] >= least[query[picked]]]
        parts.append(pd.DataFrame({"query": query[picked].astype("int32"), "place": np.int32(bit), "id": frame["id"].to_numpy()[at[picked]],
                                   "type": frame["type"].to_numpy()[at[picked]], "us": us[at[picked]], "score": score[picked]}))
    every = pd.concat([p for p in parts if len(p)] or parts[:1], ignore_index=True).sort_values(["query", "place", "score", "id"], ascending=[True, True, False, True])
    return every[every.groupby(["query", "place"]).cumcount() < limit]


def related_context(found: DataFrame, limit: int = 8) -> DataFrame:
    """Sections as the reference cuts them, from the ``3 * limit`` best nodes of ``related_nodes`` whatever their type:
    the best ``limit`` entities, claims, topics and dated nodes among those. Where other nodes lead, sections come out short."""
    both = found.select("query_id", F.explode(sections_of()).alias("section"), F.col("rank").alias("overall"), "id", "score")
    return top_per_key(both, ["query_id", "section"], ["overall"], limit).select("query_id", "section", "rank", "id", "score")


def sections_of() -> Column:
    """Sections a node can stand in: its type's, and the dated one."""
    typed = F.when(F.col("type").isin("Entity", "Claim", "Topic"), F.lower("type"))
    return F.array_compact(F.array(typed, F.when(F.col("at").isNotNull(), F.lit("temporal"))))


def _recent(near_days: int) -> Column:
    gap = F.abs(F.unix_micros(F.col("asked_at").cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp")))
    return F.when(gap < near_days * 86_400_000_000, 1).otherwise(0)


SECTIONS = ("entity", "claim", "topic", "temporal")


def related_sections(queries: DataFrame, nodes: DataFrame, limit: int = 8, near_days: int = 3, pilot: int = 16, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Per query and section the best ``limit`` nodes of all that match: (query_id, section, rank, id, score).

    Scores are those of ``related_nodes``, and so is the way while the queries
    can be sent to every task. Beyond, an inverted index holds the uses of
    each asked token, and per token and section the length and best entry of
    its list. Exact scores of a ``pilot``-th of the nodes bound the last place
    from below; the longest lists whose best entries together stay under that
    bound cannot bring a node in, so their entries are left aside. A node found
    in the other lists meets them only if it can still reach the bound.
    """
    asked = asked_tokens(queries)
    if _fits(asked, broadcast_limit):
        stands = lambda name: F.array_contains(sections_of(), name).cast("int")
        place = sum((stands(name) * 2**bit for bit, name in enumerate(SECTIONS)), F.lit(0))
        top = best_matches(asked, nodes.withColumn("place", place).filter("place > 0"), limit, near_days)
        return top.select("query_id", F.get(F.array(*map(F.lit, SECTIONS)), F.col("place")).alias("section"), "rank", "id", "score")
    tokens = small(asked.select("token").distinct())
    listed = nodes.withColumn("sections", sections_of()).filter(F.size("sections") > 0)
    held = listed.select("id", "at", "sections", F.explode(tx.search_tokens(F.col("text"))).alias("token")).join(tokens, "token", "left_semi")
    # a node's entries stand side by side, so they are counted before they are shuffled
    held = held.groupBy("id", "at", "sections", "token").agg(F.count("*").alias("uses"))
    index = stage(held.select(F.explode("sections").alias("section"), "token", "id", "at", "uses"), "token-index")

    place = ["query_id", "section"]
    first = index.filter(F.pmod(F.xxhash64("id"), F.lit(pilot)) == 0).join(small(asked), "token")
    first = first.groupBy(*place, "id", "asked_at", "at").agg(F.sum("uses").alias("n")).select(*place, "id", (F.col("n") + _recent(near_days)).alias("score"))
    first = top_per_key(first, place, [F.desc("score")], limit).groupBy(*place).agg(F.min("score").alias("floor"), F.count("*").alias("_n"))
    floors = first.filter(F.col("_n") == limit).drop("_n")

    lists = index.groupBy("section", "token").agg(F.count("*").alias("length"), F.max("uses").alias("best"))
    so_far = F.sum("best").over(Window.partitionBy(*place).orderBy(F.desc("length"), "token"))  # one query's tokens
    bounds = asked.join(lists, "token").join(floors, place, "left").withColumn("aside", F.coalesce(so_far + 1 < F.col("floor"), F.lit(False)))
    bounds = stage(bounds, "list-bounds")
    rest = bounds.filter("aside").groupBy(*place).agg(F.sum("best").alias("rest"))
    wanted = bounds.filter(~F.col("aside")).select(*place, "asked_at", "token", "floor").join(rest, place, "left")
    part = index.join(small(wanted), ["section", "token"]).groupBy(*place, "asked_at", "id", "at", "floor", "rest").agg(F.sum("uses").alias("n"))
    part = stage(part.filter(F.col("floor").isNull() | (F.col("n") + F.coalesce("rest", F.lit(0)) + 1 >= F.col("floor"))), "candidates")
    left = bounds.filter("aside").select("query_id", "section", "token")
    more = part.select("query_id", "section", "id").join(index.select("section", "id", "token", "uses"), ["section", "id"]).join(small(left), ["query_id", "section", "token"])
    more = more.groupBy("query_id", "section", "id").agg(F.sum("uses").alias("m"))
    scored = part.join(more, ["query_id", "section", "id"], "left").select(*place, "id", (F.col("n") + F.coalesce("m", F.lit(0)) + _recent(near_days)).alias("score"))
    return top_per_key(scored, place, [F.desc("score"), "id"], limit).select("query_id", "section", "rank", "id", "score")


# --- links between items -----------------------------------------------------------------

def url_linkage(rows: DataFrame, item: str = "id", key: str = "url_key") -> DataFrame:
    """(item, anchor): items that share a URL key, each tied to the first
    holder of the key. Connects the same items as all their pairs would,
    in linear size."""
    held = rows.filter(F.coalesce(F.col(key), F.lit("")) != "").select(F.col(item).alias("item"), F.col(key).alias("key")).distinct()
    return star_links(held)


def star_links(held: DataFrame) -> DataFrame:
    """(item, anchor) for distinct (item, key) rows. The anchor is a
    partial aggregate; hot keys meet it through a broadcast lookup."""
    from newsloom.operators import skew

    held = stage(held, "held")
    anchors = held.groupBy("key").agg(F.min("item").alias("anchor"), F.count("*").alias("n")).filter(F.col("n") > 1).drop("n")
    tied = skew.lookup(held, anchors, "key", held.count())
    return tied.filter(F.col("anchor").isNotNull() & (F.col("item") != F.col("anchor"))).select("item", "anchor").distinct()
