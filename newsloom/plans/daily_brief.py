"""Daily briefs for all days at once: filter, dedup, cluster, rank, score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from newsloom import rules
from newsloom.functions import text as tx, urls as ux
from newsloom.operators import dedup as dd, quality as ql, search as se, skew
from newsloom.operators.ledger import top_per_key
from newsloom.session import small, stage

def merged_terms(rows: DataFrame, group: str, order: str, terms: str, limit: int) -> DataFrame:
    """First-seen distinct terms of each group, at most ``limit``. First
    places are partial aggregates; only the cut lists are gathered."""
    seen = rows.select(group, order, F.posexplode(terms).alias("pos", "term")).groupBy(group, "term").agg(F.min(F.struct(order, "pos")).alias("first"))
    top = top_per_key(seen, [group], ["first", "term"], limit)
    return top.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x.term).alias("terms"))


def _subsets_of_four(words: Column) -> Column:
    """Every four-word subset of a sorted array of at most twelve words
    (495 at most)."""
    def grow(prefixes: Column, depth: int) -> Column:
        return F.flatten(F.transform(prefixes, lambda p: F.transform(
            F.filter(words, lambda w: (F.size(p) == 0) | (w > F.element_at(p, -1))), lambda w: F.concat(p, F.array(w)))))

    out = F.array(F.array().cast("array<string>"))
    for depth in range(4):
        out = grow(out, depth)
    return out


def word_kinds(daily: DataFrame) -> DataFrame:
    """(day, entities, all_words, kind): items of a day with the same entities
    and keywords are one kind, told by its smallest item. Copies are one row
    here, however many there are."""
    return _worded(daily).groupBy("day", "entities", "all_words").agg(F.min("item").alias("kind"))


def _worded(daily: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return daily.select(
        F.col("id").alias("item"), F.col("day").cast("string").alias("day"), F.coalesce("entities", none).alias("entities"),
        F.array_sort(F.array_distinct(F.coalesce("keywords", none))).alias("all_words")).filter(F.size("all_words") > 0)


def shared_words(kinds: DataFrame, by: str) -> DataFrame:
    """``kinds`` with ``words``: of each one's ``all_words``, sorted, those
    that at least two values of ``by`` have on its day.

    Another word is in no combination that two of them share. Counts are
    combined before they are shuffled, and a kind has twelve words at most.
    """
    held = stage(kinds.select("day", "kind", F.col(by).alias("holder"), F.explode("all_words").alias("word")), "day-words")
    common = held.groupBy("day", "word").agg(F.min("holder").alias("lo"), F.max("holder").alias("hi")).filter(F.col("lo") < F.col("hi")).select("day", "word")
    words = held.join(small(stage(common, "shared-words")), ["day", "word"]).groupBy("kind").agg(F.array_sort(F.collect_list("word")).alias("words"))
    return kinds.join(words, "kind")


def _key(kind: str, body: Column) -> Column:
    return F.concat(F.col("day").cast("string"), F.lit(f"|{kind}|"), body)


def url_keys(daily: DataFrame) -> DataFrame:
    """(item, key) rows of each item's own and related URLs."""
    related = F.coalesce("related_urls", F.array().cast("array<string>")) if "related_urls" in daily.columns else F.array().cast("array<string>")
    urls = F.array_distinct(F.transform(F.concat(F.array("url"), related), ux.canonical_key))
    return daily.select(F.col("id").alias("item"), F.explode(F.transform(F.filter(urls, lambda u: u != ""), lambda u: _key("u", u))).alias("key")).distinct()


def entity_keys(kinds: DataFrame) -> DataFrame:
    """(item, key) rows of an entity and a keyword each."""
    combos = F.flatten(F.transform(F.array_distinct("entities"), lambda e: F.transform(F.col("words"), lambda k: F.concat(e, F.lit("\u0001"), k))))
    return kinds.select(F.col("kind").alias("item"), F.explode(F.transform(combos, lambda x: _key("e", x))).alias("key"))


def word_keys(kinds: DataFrame) -> DataFrame:
    """Distinct (item, key) rows of four keywords each; the item is the kind's
    story so far."""
    fours = F.transform(_subsets_of_four(F.col("words")), lambda s: F.array_join(s, "\u0001"))
    mark = lambda x: F.concat(F.xxhash64(x).cast("string"), F.lit(":"), F.xxhash64(F.lit("b"), x).cast("string"))
    return kinds.select(F.col("story").alias("item"), F.explode(F.transform(fours, lambda x: _key("k", mark(x)))).alias("key")).distinct()


def components(links: DataFrame, plain_rows: int | None = skew.PLAIN_ROWS) -> DataFrame:
    """(item, cluster): connected components of (item, anchor) links by
    their smallest id; items without links are absent.

    Each round takes the smallest neighbour label and then the label of
    that label. Labels meet edges through hot-key lookups, because a large
    component makes its anchor hot.
    """
    both = links.select(F.col("item").alias("src"), F.col("anchor").alias("dst"))
    both = stage(both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "links")
    total = both.count()
    labels = stage(both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("label")), "labels")
    while True:
        around = skew.lookup(both, labels.select(F.col("src").alias("dst"), F.col("label").alias("near")), "dst", total, plain_rows)
        best = labels.join(around.groupBy("src").agg(F.min("near").alias("near")), "src").select("src", "label", F.least("label", "near").alias("next"))
        jumped = skew.lookup(best, labels.select(F.col("src").alias("next"), F.col("label").alias("far")), "next", total, plain_rows)
        jumped = stage(jumped.select("src", F.least("next", F.coalesce("far", "next")).alias("label"), (F.col("label") != F.least("next", F.coalesce("far", "next"))).alias("moved")), "labels")
        done = jumped.filter("moved").isEmpty()
        labels = jumped.select("src", "label")
        if done:
            return labels.select(F.col("src").alias("item"), F.col("label").alias("cluster"))


def story_clusters(daily: DataFrame) -> DataFrame:
    """(id, cluster) of every item: two items of a day belong together when
    they share a URL, their own or a related one; an entity and a keyword; or
    four keywords.

    Composite keys turn "shares an entity and a keyword" and "shares four
    keywords" into equality, so no pair of items is ever enumerated. Items of
    one kind are linked as such, and only kinds have word keys. Four words
    are combined last, of words that two stories of the day have by then:
    inside a story they tell nothing new.
    """
    worded = _worded(daily)
    kinds = stage(word_kinds(daily), "kinds")
    # two items of a kind share its keys, if it can have one
    tied = (F.size("all_words") >= 4) | (F.size("entities") > 0)
    same = worded.filter(tied).join(kinds, ["day", "entities", "all_words"]).filter(F.col("item") != F.col("kind")).select("item", F.col("kind").alias("anchor"))
    named = shared_words(kinds.filter(F.size("entities") > 0), "kind")
    links = se.star_links(url_keys(daily).unionByName(entity_keys(named)))
    begun = stage(components(links.unionByName(same)), "begun")
    told = stage(kinds.join(begun.select(F.col("item").alias("kind"), "cluster"), "kind", "left").select(
        "day", "all_words", "kind", F.coalesce("cluster", "kind").alias("story")).filter(F.size("all_words") >= 4), "told")
    open_kinds = stage(shared_words(told, "story").filter(F.size("words") >= 4).select("day", "story", "words").distinct(), "open-kinds")
    joined = components(se.star_links(word_keys(open_kinds))).select(F.col("item").alias("story"), F.col("cluster").alias("joined"))
    first = daily.select("id").join(begun.withColumnRenamed("item", "id"), "id", "left").select("id", F.coalesce("cluster", "id").alias("story"))
    return first.join(joined, "story", "left").select("id", F.coalesce("joined", "story").alias("cluster"))


def cluster_summaries(daily: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row per story: lead, title, slug, tags and counts."""
    joined = daily.join(clusters, "id")
    latest = F.col("published_at" if "published_at" in daily.columns else "day").cast("timestamp")
    lead = F.max_by(F.struct("title", "url"), F.struct(latest, -F.col("id")))
    base = joined.groupBy("cluster").agg(F.count("*").alias("source_count"), F.max("day").alias("day"), F.max(latest).alias("latest"), lead.alias("lead"))
    entities = merged_terms(joined, "cluster", "id", "entities", 6).withColumnRenamed("terms", "entities")
    keywords = merged_terms(joined, "cluster", "id", "keywords", 12).withColumnRenamed("terms", "keywords")
    none = F.array().cast("array<string>")
    rows = base.join(entities, "cluster", "left").join(keywords, "cluster", "left").withColumns({
        "entities": F.coalesce("entities", none), "keywords": F.coalesce("keywords", none)})
    entity = F.get("entities", F.lit(0))
    topic = F.slice(F.filter(F.col("keywords"), lambda w: entity.isNull() | ~F.array_contains(F.split(F.lower(entity), r"\s+"), w)), 1, 3)
    title = F.when(entity.isNotNull() & (F.size(topic) > 0), F.concat(entity, F.lit(" "), F.array_join(F.transform(topic, tx.title_case), " "), F.lit(" Update"))).otherwise(
        tx.ellipsis(tx.strip_noise(F.col("lead.title")), 92))
    tags = F.slice(F.array_distinct(F.concat("entities", "keywords")), 1, 6)
    rows = rows.select("cluster", "day", "latest", "source_count", title.alias("title"), tags.alias("tags"), F.col("lead.url").alias("lead_url"))
    slug = F.concat(F.col("day").cast("string"), F.lit("-"), tx.slug(F.col("title")))
    return rows.withColumn("slug", slug).withColumn("href", F.concat(F.lit("/daily/"), F.col("day").cast("string"), F.lit("/"), "slug", F.lit("/")))


def rank_briefs(summaries: DataFrame, per_day: int = 12) -> DataFrame:
    """The day's stories by sources, then by their latest item, then by id."""
    return top_per_key(summaries, ["day"], [F.desc("source_count"), F.desc("latest"), "cluster"], per_day)


def selected_items(items: DataFrame, terms: Sequence[str], dictionary) -> DataFrame:
    """Enrichment of all items, relevance filter, then greedy dedup per day."""
    # staged before the term filter: pushed below the enrichment it would
    # evaluate the whole enrichment once per term
    enriched = stage(se.daily_items(items, dictionary), "daily")
    ready = se.relevant(enriched.filter((F.col("url") != "") & (F.col("title") != "")), terms)
    return dd.dedupe_citations_like(ready, "id", "url", F.concat_ws(" ", "title", "summary", "source_text"), scope=F.col("day"))


def daily_briefs(items: DataFrame, terms=tuple(rules.RELEVANCE_TERMS), dictionary=tuple(rules.KNOWN_ENTITIES), per_day: int = 12) -> DataFrame:
    """Ranked stories of every day, from all its items."""
    daily = stage(selected_items(items, terms, dictionary), "selected")
    clusters = stage(story_clusters(daily), "clusters")
    return rank_briefs(cluster_summaries(daily, clusters), per_day)


# --- sections and publication ----------------------------------------------------------

def _keep_new(texts: Column, exclude: Column) -> Column:
    """(group, text) structs without near repeats of excluded or earlier
    texts."""
    shaped = F.transform(texts, lambda t: F.struct(
        t["group"].cast("int").alias("group"), t["text"].alias("text"), F.array_distinct(tx.content_words(t["text"])).alias("set"), tx.fingerprint(t["text"]).alias("mark")))
    start = F.array().cast("array<struct<group: int, text: string, set: array<string>, mark: string>>")
    barred = F.transform(exclude, lambda e: F.array_distinct(tx.content_words(e)))

    def step(acc: Column, t: Column) -> Column:
        seen = F.exists(acc, lambda k: (k["mark"] == t["mark"]) | se.near(t["set"], k["set"])) | F.exists(barred, lambda b: se.near(t["set"], b))
        return F.when((t["text"] == "") | seen, acc).otherwise(F.concat(acc, F.array(t)))

    return F.aggregate(shaped, start, step)


def sections(stories: DataFrame, daily: DataFrame, clusters: DataFrame, signal_terms=tuple(rules.SIGNAL_TERMS), patterns: Sequence[str] | None = None) -> DataFrame:
    """Sections of every story: ranked evidence, concepts, groups, then
    paragraphs without repeats. Extractive sentences only."""
    members = daily.join(clusters, "id").withColumn("text", F.coalesce(tx.non_empty(F.col("source_text")), "summary", "title"))
    sents = stage(se.group_texts(members, "cluster", "id", "text"), "story-sentences")
    ranked = se.rank_evidence(sents, "cluster", "sentence_no", 12, signal_terms)
    evidence = ranked.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "sentence"))), lambda s: s.sentence).alias("evidence"))
    # a story without usable sentences falls back to the first sentences of its items' summaries
    spare = top_per_key(members.withColumn("_first", tx.summarize(F.col("summary"), 2)).filter(F.col("_first") != ""), ["cluster"], ["id"], 12)
    spare = spare.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "_first"))), lambda s: s["_first"]).alias("spare"))
    rows = stories.select("cluster", "day", "title").join(evidence, "cluster", "left").join(spare, "cluster", "left")
    rows = rows.withColumn("evidence", F.coalesce("evidence", "spare", F.array("title"))).drop("spare")
    rows = stage(rows.withColumn("all_text", tx.strip_noise(F.concat("title", F.lit(". "), F.array_join("evidence", " ")))), "story-evidence")
    rows = rows.withColumn("concepts", se.concepts(F.col("all_text"), patterns))
    rows = rows.withColumn("groups", se.assign_evidence(F.col("concepts"), F.col("evidence")))
    flat = F.flatten(F.transform(F.col("groups"), lambda g, i: F.transform(g.sentences, lambda s: F.struct(i.alias("group"), tx.spoken_fillers(s).alias("text")))))
    rows = rows.withColumn("kept", _keep_new(flat, F.array("title")))
    # where every paragraph only repeats the title, the title's own paragraph stays
    rows = rows.withColumn("kept", F.when(F.size("kept") > 0, F.col("kept")).otherwise(F.slice(_keep_new(flat, F.array().cast("array<string>")), 1, 1)))
    built = F.transform(F.col("groups"), lambda g, i: F.struct(
        g.concept.alias("concept"), F.transform(F.filter(F.col("kept"), lambda k: k["group"] == i), lambda k: k["text"]).alias("paragraphs")))
    rows = rows.withColumn("topic", tx.first_rule_tag(F.col("all_text"), rules.TOPIC_RULES, rules.DEFAULT_TOPIC))
    found = rows.select("cluster", "day", "title", "topic", F.posexplode(F.filter(built, lambda s: F.size(s.paragraphs) > 0)).alias("section_no", "s"))
    found = found.withColumns({"joined": F.array_join("s.paragraphs", " "), "text": F.concat_ws(" ", "s.concept", F.array_join("s.paragraphs", " "))})
    text = F.col("text")
    named = F.coalesce(tx.non_empty(F.col("s.concept")), F.get(se.concepts(F.col("joined"), patterns), F.lit(0)), F.lit("Development"))
    return found.select(
        "cluster", "day", "section_no", "topic", tx.title_case(tx.collapse(named)).alias("heading"), tx.first_rule_tag(text, rules.HEADING_RULES, rules.DEFAULT_THEME).alias("theme"),
        tx.first_rule_tag(text, rules.INTENT_RULES, rules.DEFAULT_INTENT).alias("intent"), F.col("s.paragraphs").alias("paragraphs"))


def brief_outputs(briefs: DataFrame) -> DataFrame:
    """Briefs as articles, in the shape the rubric reads: sections as
    markdown, then the takeaways; the sources are what may be cited."""
    sections = F.transform(F.col("section_list"), lambda s: F.concat(F.lit("## "), s.heading, F.lit("\n\n"), F.array_join(s.paragraphs, "\n"), F.lit("\n")))
    points = F.transform(F.col("takeaways"), lambda t: F.concat(F.lit("- "), t))
    body = F.array_join(F.concat(sections, F.array(F.lit("## Key Takeaways\n")), points), "\n")
    none = F.array().cast("array<struct<body: string, citation_urls: array<string>>>")
    return briefs.select(
        "output_id", F.lit("article").alias("kind"), "title", F.coalesce(F.get("paragraphs", F.lit(0)), F.lit("")).alias("description"), body.alias("body"),
        F.col("sources").alias("citations"), F.transform("sources", lambda c: c.url).alias("allowed_urls"), F.concat_ws(" ", "title", F.array_join("source_titles", " ")).alias("relevance_text"),
        F.lit("").alias("summary"), none.alias("sections"))


def publishable(items: DataFrame, terms, dictionary, per_day: int = 4, multiplier: int = 3, detail_terms=tuple(rules.BRIEF_DETAIL_TERMS),
                signal_terms=tuple(rules.SIGNAL_TERMS), patterns: Sequence[str] | None = None, voice: dict = rules.VOICE_PROFILES["journalist"]) -> DataFrame:
    """Evidence gate, candidates, content rules and rubric, then the day's
    quota of passing stories: those with every content rule, a passing rubric
    and a mean of all rules at the threshold."""
    briefs, verdicts = judged_briefs(items, terms, dictionary, per_day * multiplier, detail_terms, signal_terms, patterns, voice)
    stories = briefs.select("output_id", "day", "rank", "title", "source_count")
    return ql.publish_quota(stories.join(verdicts, "output_id"), per_day)


def judged_briefs(items: DataFrame, terms, dictionary, candidates: int, detail_terms, signal_terms, patterns, voice) -> tuple[DataFrame, DataFrame]:
    """(briefs, verdicts) of the day's candidates; a verdict is ``output_id, failed_rules, rubric_score, score, passed``."""
    gated = tx.with_usable(items.withColumn("_head", tx.clean_title(F.col("title"))), "summary", "_head", "_usable")
    usable = stage(gated.drop("_head"), "gated").filter("_usable").drop("_usable")
    daily = stage(selected_items(usable, terms, dictionary), "selected")
    clusters = stage(story_clusters(daily), "clusters")
    stories = stage(rank_briefs(cluster_summaries(daily, clusters), candidates), "stories")
    parts = sections(stories, daily, clusters, signal_terms, patterns)
    body = parts.groupBy("cluster").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("section_no", "paragraphs"))), lambda s: s.paragraphs)).alias("paragraphs"),
        F.transform(F.array_sort(F.collect_list(F.struct("section_no", "heading"))), lambda s: s.heading).alias("headings"),
        F.transform(F.array_sort(F.collect_list(F.struct("section_no", "heading", "paragraphs"))), lambda s: F.struct(s.heading.alias("heading"), s.paragraphs.alias("paragraphs"))).alias("section_list"))
    # titles and evidence of the cited sources, at most twelve per story
    cited = top_per_key(daily.join(clusters, "id").join(stories.select("cluster"), "cluster"), ["cluster"], ["id"], 12).groupBy("cluster").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("id", "title"))), lambda s: s.title).alias("source_titles"),
        F.transform(F.array_sort(F.collect_list(F.struct("id", "title", "url", "source_name"))), lambda s: F.struct(s.title.alias("title"), s.url.alias("url"), s.source_name.alias("source"))).alias("sources"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "source_text"))), lambda s: s.source_text), " ").alias("source_evidence"))
    none = F.array().cast("array<string>")
    briefs = stories.join(body, "cluster", "left").join(cited, "cluster", "left").withColumns({
        **{c: F.coalesce(c, none) for c in ("paragraphs", "headings", "source_titles")}, "source_evidence": F.coalesce("source_evidence", F.lit(""))})
    briefs = briefs.withColumn("text", F.concat_ws("\n", F.array_join("headings", "\n"), F.array_join("paragraphs", "\n"))).withColumnRenamed("cluster", "output_id")
    briefs = briefs.withColumns({
        "section_list": F.coalesce("section_list", F.array().cast("array<struct<heading: string, paragraphs: array<string>>>")),
        "sources": F.coalesce("sources", F.array().cast("array<struct<title: string, url: string, source: string>>"))})
    briefs = stage(briefs.withColumn("takeaways", se.takeaways(F.col("title"), F.col("paragraphs"), F.slice("paragraphs", 1, 1))), "briefs")
    rows = ql.brief_results(briefs, detail_terms)
    rubric = stage(ql.scored_outputs(brief_outputs(briefs), article_voice=voice), "rubric")
    failed = rows.groupBy("output_id").agg(F.count_if(~F.col("passed")).alias("failed_rules"))
    final = ql.brief_verdict(rows, rubric).select("output_id", "score", (F.col("verdict") == "pass").alias("passed"))
    return briefs, failed.join(rubric.select("output_id", F.col("score").alias("rubric_score")), "output_id").join(final, "output_id")
