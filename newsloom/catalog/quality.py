"""Quality rule queries over outputs derived from the items."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom import rules
from newsloom.catalog import sqltext as q
from newsloom.catalog.base import CORPUS_TERMS, register
from newsloom.functions import text as tx
from newsloom.operators import quality as ql

VOICE_TERMS = ["the", "with", "that", "therea"]
ARTICLE = {"prefer": VOICE_TERMS, "avoid": ["idiot", "pathetic oner"]}
WIKI = {"prefer": ["les", "der", "de"], "avoid": ["una"]}


def outputs(t):
    """Items as generated outputs: English articles, other topic pages."""
    article = F.col("kind") == "en"
    head = F.substring("summary", 1, 80)
    body = F.concat(F.lit("## "), "title", F.lit("\n\n"), "summary", F.lit("\n\n## More\n\n[link]("), "url", F.lit(")"))
    cites = F.array(F.struct(F.col("title").alias("title"), F.col("url").alias("url"), F.when(F.col("kind") == "fr", "").otherwise(F.col("source_name")).alias("source")))
    none = F.expr("cast(array() as array<struct<title: string, url: string, source: string>>)")
    section = F.array(F.struct(F.get(tx.sentences(F.col("summary")), F.lit(0)).alias("body"), F.array("url").alias("citation_urls")))
    no_section = F.expr("cast(array() as array<struct<body: string, citation_urls: array<string>>>)")
    return t.items.select(
        F.col("id").alias("output_id"), F.when(article, "article").otherwise("wiki").alias("kind"), "title", head.alias("description"),
        F.when(article, body).otherwise(F.col("summary")).alias("body"), F.when(F.col("status") == "ok", cites).otherwise(none).alias("citations"),
        F.when(F.col("kind") == "es", F.array(F.lit("https://x.example"))).otherwise(F.array("url")).alias("allowed_urls"),
        F.col("title").alias("relevance_text"), head.alias("summary"), F.when(article, no_section).otherwise(section).alias("sections"))


ART = "kind = 'en'"
OUT = f"""outs AS (SELECT *, substring(summary, 1, 80) AS head,
  CASE WHEN {ART} THEN '## ' || title || chr(10) || chr(10) || summary || chr(10) || chr(10) || '## More' || chr(10) || chr(10) || '[link](' || url || ')' ELSE summary END AS body FROM items),
texts AS (SELECT *, concat_ws(chr(10), nullif(title, ''), nullif(head, ''), nullif(body, '')) AS text FROM outs)"""
HARD = list(dict.fromkeys(VOICE_TERMS + rules.HARD_SCIENCE_TERMS))
PLAIN = list(dict.fromkeys(WIKI["prefer"] + rules.WIKI_REFERENCE_TERMS))
FIRST = f"coalesce(({q.sentences('summary')})[1], '')"
EXPECT, SEEN = q.keywords("title"), q.keywords("text")
CHECKS = {
    "citation-coverage": "status = 'ok'",
    "citation-richness": "status <> 'ok' OR (kind <> 'fr' AND trim(title) <> '')",
    "link-health": "true",
    "grounding": "kind <> 'es'",
    "relevance": f"len({EXPECT}) = 0 OR len(list_intersect({EXPECT}, {SEEN})) >= greatest(1, least(3, ceil(len({EXPECT}) * 0.2)))",
    "speculation-boundary": f"NOT {q.any_match('text', ['speculation as fact|will definitely|guaranteed to'])}",
    "reader-facing-language": f"NOT {q.any_match('text', rules.INTERNAL_LANGUAGE_PATTERNS)}",
    "tone-match": f"CASE WHEN {ART} THEN NOT {q.any_match('text', rules.WIKI_LIKE_PATTERNS)} AND {q.term_hits('text', HARD)} >= 2 ELSE NOT {q.any_match('text', rules.ARTICLE_RHETORIC_PATTERNS)} END",
    "word-choice": f"CASE WHEN {ART} THEN {q.term_hits('text', ARTICLE['avoid'])} = 0 AND {q.term_hits('text', HARD)} >= 2 ELSE {q.term_hits('text', WIKI['avoid'])} = 0 AND {q.term_hits('text', PLAIN)} >= 1 END",
    "detail-level": f"CASE WHEN {ART} THEN {q.word_count('body')} >= 90 ELSE {q.word_count('head')} <= 45 AND {q.word_count(FIRST)} <= 30 END",
    "voice-adherence": f"NOT {q.any_match('text', rules.HYPE_PATTERNS)}",
}
RULES = "rules AS (" + "\nUNION ALL ".join(f"SELECT id AS output_id, '{n}' AS rule, ({c}) AS passed FROM texts" for n, c in CHECKS.items()) + ")"
WEIGHTS = "weights(rule, weight, required) AS (VALUES " + ", ".join(f"('{n}', {w}, {str(r).lower()})" for n, w, r in rules.RUBRIC) + ")"
SCORED = """scored AS (SELECT output_id, sum(CASE WHEN passed THEN CAST(weight AS DOUBLE) ELSE 0 END) / sum(CAST(weight AS DOUBLE)) AS raw,
  count(*) FILTER (WHERE required AND NOT passed) AS required_failures, count(*) FILTER (WHERE NOT passed) AS failures FROM rules JOIN weights USING (rule) GROUP BY output_id)"""


def rule_rows(t):
    return ql.evaluate(outputs(t), article_voice=ARTICLE, wiki_voice=WIKI)


@register("rule_results", "Q1 Q2 Q3 Q4 Q5 Q6 Q7 Q8 Q9 Q10 Q11 X17 E4", q.with_([q.ITEMS, OUT, RULES], "SELECT output_id, rule, passed FROM rules"))
def _(t):
    return rule_rows(t)


@register("rule_failure_counts", "Q1 Q7 Q12", q.with_([q.ITEMS, OUT, RULES, WEIGHTS], """
SELECT rule, required, count(*) FILTER (WHERE NOT passed) AS failures, count(*) AS n FROM rules JOIN weights USING (rule) GROUP BY rule, required"""))
def _(t):
    joined = rule_rows(t).join(F.broadcast(ql.rubric(t.spark)), "rule")
    return joined.groupBy("rule", "required").agg(F.count_if(~F.col("passed")).alias("failures"), F.count("*").alias("n"))


@register("rubric_scores", "A7 Q12", q.with_([q.ITEMS, OUT, RULES, WEIGHTS, SCORED], """
SELECT output_id, round(raw, 4) AS score, CASE WHEN round(raw, 9) >= 0.86 AND required_failures = 0 THEN 'pass' ELSE 'fail' END AS verdict, required_failures, failures FROM scored"""))
def _(t):
    return ql.scored_outputs(outputs(t), article_voice=ARTICLE, wiki_voice=WIKI)


@register("combined_evaluators", "A8 E1 E2", q.with_([q.ITEMS], f"""
SELECT output_id, score, 2 AS n_reports, required_failures, CASE WHEN score >= 0.86 THEN 'pass' ELSE 'fail' END AS verdict,
  concat_ws('|', 'has ' || n_words || ' words', CASE WHEN required_failures = 0 THEN 'is cited' ELSE 'is not cited' END) AS assertions,
  concat_ws('|', CASE WHEN n_words < 100 THEN 'write more' END, CASE WHEN required_failures > 0 THEN 'name a source' END) AS feedback,
  CASE WHEN required_failures > 0 THEN 'cite a source' ELSE '' END AS required_fixes FROM (
  SELECT id AS output_id, round((least({q.word_count('summary')} / 100.0, 1.0) + CASE WHEN status = 'ok' THEN 1.0 ELSE 0.0 END) / 2, 4) AS score,
    CASE WHEN status = 'ok' THEN 0 ELSE 1 END AS required_failures, {q.word_count('summary')} AS n_words FROM items)"""))
def _(t):
    ok = F.col("n_cited") > 0
    found = lambda c, text: F.when(c, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    length = lambda df: df.select(
        "output_id", (F.col("n_words") / 100.0).alias("score"), F.lit(0).alias("required_failures"), F.array(F.format_string("has %d words", "n_words")).alias("assertions"),
        found(F.col("n_words") < 100, "write more").alias("feedback"))
    cited = lambda df: df.select(
        "output_id", F.when(ok, 1.0).otherwise(-0.5).alias("score"), F.when(ok, 0).otherwise(1).alias("required_failures"),
        F.when(ok, F.array(F.lit("is cited"))).otherwise(F.array(F.lit("is not cited"))).alias("assertions"), found(~ok, "name a source").alias("feedback"), found(~ok, "cite a source").alias("required_fixes"))
    normalise = lambda df: df.select("output_id", F.size("citations").alias("n_cited"), tx.word_count(F.col("full")).alias("n_words"))
    rows = outputs(t).join(t.items.select(F.col("id").alias("output_id"), F.col("summary").alias("full")), "output_id")
    merged = ql.run_evaluators(rows.transform(normalise), {"length": length, "cited": cited})
    return merged.withColumns({c: F.array_join(c, "|") for c in ql.FINDINGS})


@register("best_attempts", "W8", q.with_([q.LEDGER], """
SELECT id, attempt, score, CASE WHEN passed THEN 'passed' ELSE 'best_effort' END AS eval_status FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY passed DESC, CASE WHEN passed THEN attempt END, score DESC, attempt) AS rn FROM (
    SELECT id, seq AS attempt, score / 40 AS score, score / 40 >= 0.86 AND status <> 'revisit_pending' AND status <> 'discovered' AS passed FROM ledger)) WHERE rn = 1"""))
def _(t):
    attempts = t.ledger.select("id", F.col("seq").alias("attempt"), (F.col("score") / 40).alias("score"),
                               F.when(F.col("status") == "revisit_pending", "fail").otherwise("pass").alias("verdict"), (F.col("status") == "discovered").cast("int").alias("required_failures"))
    return ql.best_attempts(attempts, "id").select("id", "attempt", "score", "eval_status")


PARAS = "list_filter(string_split(text, chr(10)), lambda p: p <> '')"


TEMPLATE_HEADING = "How it changes the practical tradeoff"
OTHER_EVIDENCE = "Quarterly shipments of refrigerated machinery slowed while harbour inspectors questioned warehouse paperwork"


def briefs(t):
    """Documents as briefs. Some have a template's heading, some cite evidence that they don't use, some have none."""
    lines = F.filter(F.split("text", "\n"), lambda p: p != "")
    template = F.when(F.col("doc_id") % 7 == 0, F.array(F.lit(TEMPLATE_HEADING))).otherwise(F.array().cast("array<string>"))
    evidence = F.when(F.col("doc_id") % 5 == 1, OTHER_EVIDENCE).when(F.col("doc_id") % 5 == 2, "").otherwise(F.col("text"))
    return t.documents.select(
        F.col("doc_id").alias("output_id"), tx.clean_title(F.substring_index(tx.collapse(F.col("text")), " ", 8)).alias("title"), lines.alias("paragraphs"),
        F.concat(F.slice(lines, 1, 2), template).alias("headings"), F.array("source", F.substring_index(tx.collapse(F.col("text")), " ", 8)).alias("source_titles"), "text", evidence.alias("source_evidence"))


LEAD = f"array_to_string(string_split({q.collapse('text')}, ' ')[1:8], ' ')"
JOINED = "array_to_string(paras, ' ')"
BRIEF_ROWS = f"""raw AS (SELECT doc_id AS output_id, text, {PARAS} AS paras, {LEAD} AS lead, source FROM documents),
lead_words AS (SELECT *, list_distinct({q.words('lead')}) AS tw FROM raw),
paras AS (SELECT output_id, unnest(paras) AS p, tw, lead FROM lead_words),
echoes AS (SELECT output_id, bool_or(n < 18 OR (n < 40 AND shared / greatest(1, least(n, greatest(1, len(tw)))) >= 0.75) OR fp = {q.alnum_key('lead', 180)}) AS echo FROM (
  SELECT output_id, tw, lead, len({q.words('p')}) AS n, len(list_filter({q.words('p')}, lambda w: list_contains(tw, w))) AS shared,
    {q.alnum_key("regexp_replace(p, '^[^:]{3,80}:\\s*', '')", 180)} AS fp FROM paras) GROUP BY output_id),
terms AS (SELECT *, {q.grounding_terms(f"CASE output_id % 5 WHEN 1 THEN '{OTHER_EVIDENCE}' WHEN 2 THEN '' ELSE text END")} AS gt, {q.grounding_terms('text')} AS used FROM lead_words)"""
BRIEF_CHECKS = {
    "word-count": f"{q.word_count(JOINED)} >= 120", "section-count": "least(len(paras), 2) + CASE WHEN output_id % 7 = 0 THEN 1 ELSE 0 END >= 2", "no-title-echo": "NOT coalesce(echo, false)", "no-template-heading": f"output_id % 7 <> 0 AND NOT {q.any_match('array_to_string(paras[1:2], chr(10))', [rules.TEMPLATE_HEADING_PATTERN])}",
    "detail-terms": f"{q.term_hits(JOINED, CORPUS_TERMS)} >= 2",
    "no-copied-headline": f"NOT (length({q.headline('lead')}) > 28 AND contains(lower({JOINED}), lower({q.headline('lead')})))",
    "no-meta-language": f"NOT {q.any_match('text', rules.META_PATTERNS)}", "usable-evidence": "len(gt) > 0",
    "grounded": "len(gt) = 0 OR len(list_intersect(gt, used)) >= least(4, greatest(2, ceil(len(gt) * 0.2)))",
}
BRIEF_SQL = "brief_rules AS (" + "\nUNION ALL ".join(
    f"SELECT output_id, '{n}' AS rule, ({c}) AS passed FROM terms LEFT JOIN echoes USING (output_id)" for n, c in BRIEF_CHECKS.items()) + ")"


@register("brief_rule_results", "Q13", q.with_([BRIEF_ROWS, BRIEF_SQL], "SELECT output_id, rule, passed FROM brief_rules"))
def _(t):
    return ql.brief_results(briefs(t), CORPUS_TERMS)


@register("brief_verdicts", "Q14", q.with_([q.ITEMS, OUT, RULES, WEIGHTS, SCORED, BRIEF_ROWS, BRIEF_SQL], """
SELECT output_id, round(least(mean, round(raw, 4)), 4) AS score,
  CASE WHEN mean >= 0.86 AND round(raw, 9) >= 0.86 AND required_failures = 0 AND p = n THEN 'pass' ELSE 'fail' END AS verdict
FROM (SELECT *, (p + 11 - failures) / (n + 11) AS mean FROM scored JOIN (SELECT output_id, count(*) AS n, count(*) FILTER (WHERE passed) AS p FROM brief_rules GROUP BY output_id) USING (output_id))"""))
def _(t):
    return ql.brief_verdict(ql.brief_results(briefs(t), CORPUS_TERMS), ql.score(rule_rows(t), ql.rubric(t.spark)))


@register("publish_guard", "Q15", """
SELECT strftime(day, '%Y-%m-%d') AS day, CASE WHEN items = 0 THEN 'no source items' ELSE 'no rows' END AS problem FROM (
  SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE user_id = 1) AS items, count(*) FILTER (WHERE user_id = 1 AND event_type = 'view') AS n_rows
  FROM events GROUP BY 1) WHERE items = 0 OR n_rows = 0""")
def _(t):
    mine = F.col("user_id") == 1
    days = t.events.groupBy(F.to_date("ts").cast("string").alias("day")).agg(
        F.count_if(mine).alias("source_items"), F.count_if(mine & (F.col("event_type") == "view")).alias("n_rows"))
    return ql.publish_guard(days)


@register("navigation_problems", "Q16", q.with_([q.ITEMS], """
SELECT day, slug, problem FROM (
  SELECT strftime(day, '%Y-%m-%d') AS day, CASE WHEN kind = 'de' THEN '' ELSE source_name END AS slug,
    CASE WHEN kind = 'de' THEN 'missing slug' WHEN kind = 'fr' THEN 'missing title' WHEN kind = 'es' THEN 'unexpected href' END AS problem FROM items) WHERE problem IS NOT NULL
UNION ALL SELECT strftime(day, '%Y-%m-%d'), source_name, 'duplicate slug' FROM items WHERE kind <> 'de' GROUP BY day, source_name HAVING count(*) > 1"""))
def _(t):
    day = F.col("day").cast("string")
    stubs = t.items.select(
        day.alias("day"), F.when(F.col("kind") == "de", "").otherwise(F.col("source_name")).alias("slug"), F.when(F.col("kind") == "fr", "").otherwise(F.concat(F.lit("t"), "title")).alias("title"),
        F.when(F.col("kind") == "es", "/x/").otherwise(F.concat(F.lit("/daily/"), day, F.lit("/"), "source_name", F.lit("/"))).alias("href"))
    return ql.navigation_problems(stubs)


@register("artifact_problems", "Q18", """
SELECT event_id AS artifact_id, 'unexpected day' AS problem FROM events WHERE CAST(ts AS DATE) <> DATE '2024-01-05'
UNION ALL SELECT event_id, 'forbidden field' FROM events WHERE event_type = 'error'
UNION ALL SELECT event_id, 'day not indexed' FROM events WHERE CAST(ts AS DATE) NOT IN (SELECT CAST(ts AS DATE) FROM events WHERE value > 45)""")
def _(t):
    day = F.to_date("ts").cast("string")
    payload = F.when(F.col("event_type") == "error", F.concat(F.lit('{"a": [{"transcript": '), "props", F.lit("}]}"))).otherwise(F.col("props"))
    artifacts = t.events.select(F.col("event_id").alias("artifact_id"), day.alias("day"), payload.alias("payload"))
    indexed = t.events.filter(F.col("value") > 45).select(day.alias("day"))
    return ql.artifact_problems(artifacts, indexed, "2024-01-05")


@register("content_shape", "Q21", f"""
SELECT doc_id, len(paras) >= 2 AS sections_ok, length(text) >= 48 AS dek_ok, len(list_filter(paras, lambda p: length(p) < 70)) = 0 AS paragraphs_ok,
  (len(paras) >= 2 AND len(list_filter(paras, lambda p: length(p) < 45)) = 0) AS takeaways_ok FROM (SELECT *, {PARAS} AS paras FROM documents)""")
def _(t):
    lines = F.filter(F.split("text", "\n"), lambda p: p != "")
    rows = t.documents.select("doc_id", F.col("text").alias("dek"), lines.alias("takeaways"), F.transform(
        lines, lambda p: F.struct(F.lit("A heading").alias("heading"), F.array(p).alias("paragraphs"), F.array(F.lit("https://a.example/b")).alias("citations"))).alias("sections"))
    c = ql.content_shape()
    return rows.select("doc_id", c["section-count"].alias("sections_ok"), c["dek-length"].alias("dek_ok"), c["paragraphs"].alias("paragraphs_ok"), c["takeaways"].alias("takeaways_ok"))


@register("restricted_citations", "Q22", q.with_([q.ITEMS], """
SELECT id, CASE WHEN status = 'ok' THEN url ELSE 'https://first.example' END AS kept FROM items"""))
def _(t):
    cited = F.array(F.lit("https://no.example"), F.when(F.col("status") == "ok", F.col("url")).otherwise("https://none.example"))
    return t.items.select("id", F.array_join(ql.restrict_citations(cited, F.array(F.lit("https://first.example"), F.col("url"))), "|").alias("kept"))


@register("live_links", "Q3", q.with_([q.PAGE_LINKS], """
SELECT page_id, url, http_status FROM page_links LEFT JOIN (SELECT DISTINCT url, CASE WHEN length(url) % 2 = 0 THEN 200 ELSE 404 END AS http_status FROM page_links WHERE length(url) % 3 <> 0) USING (url)
WHERE NOT coalesce(http_status = 200, false)"""))
def _(t):
    links = t.page_links.select("page_id", "url")
    size = F.length("url")
    probes = links.filter(size % 3 != 0).select("url", F.when(size % 2 == 0, 200).otherwise(404).alias("http_status")).distinct()
    return ql.live_links(links, probes, "page_id").withColumn("http_status", F.col("http_status").cast("bigint"))


@register("reader_text_of_outputs", "P25 P26", q.with_([q.ITEMS], f"""
SELECT id, title || chr(10) || 'What ' || kind || chr(10) || summary || chr(10) || source_name AS text,
  array_to_string(list_sort({q.keywords("title || ' ' || summary")}), '|') AS relevance FROM items WHERE summary <> ''"""))
def _(t):
    section = F.array(F.struct(F.concat(F.lit("What "), "kind").alias("heading"), F.array("summary", F.lit("")).alias("paragraphs")))
    text = ql.flatten_output(F.col("title"), section, F.array("source_name", F.lit(None).cast("string")))
    return t.items.filter(F.col("summary") != "").select("id", text.alias("text"), F.array_join(F.array_sort(tx.relevance_keywords(F.concat("title", F.lit(" "), "summary"))), "|").alias("relevance"))


SHOWN = "CASE WHEN id % 11 = 0 THEN 'RT ' || summary WHEN id % 13 = 0 THEN summary || ' Read more here: https://x.example/1' ELSE summary END"
SOURCE = f"CASE id % 3 WHEN 0 THEN '{OTHER_EVIDENCE}' ELSE summary END"
PREVIEW = {
    "raw-repost-marker": r"regexp_matches(shown, '\bRT\b')", "flattened-quoted-link": r"regexp_matches(shown, '(?i)Read more here:\s*https?://')",
    "instruction-language": q.any_match("shown", rules.META_PATTERNS), "missing-social-preview": "kind = 'en' AND id % 17 = 0", "missing-repost-preview": "kind = 'en' AND id % 5 = 0",
    "repost-label": "kind = 'en' AND id % 5 <> 0 AND id % 7 = 0", "repost-author": "kind = 'en' AND id % 5 <> 0 AND id % 9 = 0", "quoted-link": "kind = 'en' AND id % 5 <> 0 AND status <> 'ok'",
    "body-length": f"trim(source) <> '' AND {q.word_count('shown')} < 120", "section-count": "trim(source) <> '' AND id % 19 = 0",
    "headline-echo": r"trim(source) <> '' AND regexp_matches(shown, '(?m)^[A-Z][^\n:]{3,90}:\s*[A-Z][^\n]+$')",
    "detail-terms": f"trim(source) <> '' AND {q.term_hits('shown', rules.BRIEF_DETAIL_TERMS)} = 0",
    "source-terms": f"trim(source) <> '' AND len(list_intersect({q.grounding_terms('source')}, {q.grounding_terms('shown')})) < 2",
}
STUBS = f"stubs AS (SELECT *, {SHOWN} AS shown, {SOURCE} AS source FROM items)"


@register("preview_contract", "Q20", q.with_([q.ITEMS, STUBS], "\nUNION ALL ".join(f"SELECT id AS stub_id, '{rule}' AS rule FROM stubs WHERE {test}" for rule, test in PREVIEW.items())))
def _(t):
    from newsloom.operators.citations import preview_contract

    every = lambda n: F.col("id") % n == 0
    english = F.col("kind") == "en"
    shown = F.when(every(11), F.concat(F.lit("RT "), "summary")).when(every(13), F.concat("summary", F.lit(" Read more here: https://x.example/1"))).otherwise(F.col("summary"))
    stubs = t.items.withColumn("shown", shown).select(
        F.col("id").alias("stub_id"), F.col("shown").alias("text"), F.when(every(3), OTHER_EVIDENCE).otherwise(F.col("summary")).alias("source_text"), english.alias("expects_social"),
        F.when(every(17), 0).otherwise(1).alias("n_social"), (english & ~every(5)).cast("int").alias("n_retweets"), F.when(every(7), "Repost").otherwise("Retweet").alias("retweet_label"),
        F.when(~every(9), F.col("source_name")).alias("original_author"), F.when(F.col("status") == "ok", F.col("url")).alias("quoted_url"), tx.word_count(F.col("shown")).alias("body_words"),
        F.when(every(19), 1).otherwise(2).alias("n_sections"))
    return preview_contract(stubs)
