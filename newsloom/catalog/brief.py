"""Daily brief queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom import rules
from newsloom.catalog import sqltext as q
from newsloom.catalog.base import CORPUS_ENTITIES, CORPUS_TERMS, register
from newsloom.catalog.search import CORPUS_SIGNALS, DAILY, GENERIC, HEADS, RANKED
from newsloom.operators import search as se
from newsloom.plans import daily_brief as br
from newsloom.session import stage

ENT = q.known_entities("title || ' ' || evidence || ' ' || array_to_string(tags, ' ')", CORPUS_ENTITIES)
CLUSTERS = f"""d AS MATERIALIZED (SELECT id, day, url, title, coalesce(keywords, CAST([] AS VARCHAR[])) AS kw, {ENT} AS ent FROM daily),
near AS MATERIALIZED (SELECT a.id AS x, b.id AS y FROM d a JOIN d b ON a.day = b.day AND a.id <> b.id
  WHERE a.url = b.url OR (len(list_intersect(a.ent, b.ent)) > 0 AND len(list_intersect(a.kw, b.kw)) > 0) OR len(list_intersect(a.kw, b.kw)) >= 4),
reach(id, other) AS (SELECT id, id FROM d UNION SELECT r.id, n.y FROM reach r JOIN near n ON n.x = r.other),
clusters AS (SELECT id, min(other) AS cluster FROM reach GROUP BY id)"""


def recursive(ctes, select):
    return q.with_(ctes, select).replace("WITH ", "WITH RECURSIVE ", 1)


def daily(t):
    return stage(se.daily_items(t.ok_items, CORPUS_ENTITIES), "daily")


@register("story_clusters", "C1 C2", recursive([q.OK_ITEMS, DAILY, CLUSTERS], "SELECT id, cluster FROM clusters"))
def _(t):
    return br.story_clusters(daily(t))


SUMMARY = """m AS (SELECT * FROM clusters JOIN d USING (id)),
ents AS (SELECT cluster, list(e ORDER BY first)[1:6] AS el FROM (SELECT cluster, e, min(id * 100 + pos) AS first FROM (
  SELECT cluster, id, unnest(ent) AS e, unnest(range(len(ent))) AS pos FROM m) GROUP BY cluster, e) GROUP BY cluster),
kws AS (SELECT cluster, list(w ORDER BY first)[1:12] AS kl FROM (SELECT cluster, w, min(id * 100 + pos) AS first FROM (
  SELECT cluster, id, unnest(kw) AS w, unnest(range(len(kw))) AS pos FROM m) GROUP BY cluster, w) GROUP BY cluster),
base AS (SELECT cluster, count(*) AS source_count, max(day) AS day, arg_min(title, id) AS lead_title, arg_min(url, id) AS lead_url FROM m GROUP BY cluster),
joined AS (SELECT *, list_filter(coalesce(kl, []), lambda w: el IS NULL OR NOT list_contains(string_split(lower(el[1]), ' '), w))[1:3] AS tw FROM base LEFT JOIN ents USING (cluster) LEFT JOIN kws USING (cluster)),
summaries AS (SELECT cluster, source_count, day, lead_url, CASE WHEN el IS NOT NULL AND len(tw) > 0 THEN el[1] || ' ' || array_to_string(list_transform(tw, lambda w: upper(w[1]) || w[2:]), ' ') || ' Update' ELSE lead_title END AS title FROM joined)"""


@register("story_summaries", "C4", recursive([q.OK_ITEMS, DAILY, CLUSTERS, SUMMARY], f"""
SELECT cluster, source_count, strftime(day, '%Y-%m-%d') AS day, title, lead_url, strftime(day, '%Y-%m-%d') || '-' || {q.slug('title')} AS slug FROM summaries"""))
def _(t):
    rows = daily(t)
    return br.cluster_summaries(rows, stage(br.story_clusters(rows), "clusters")).select(
        "cluster", "source_count", F.col("day").cast("string").alias("day"), "title", "lead_url", "slug")


@register("ranked_stories", "W9", recursive([q.OK_ITEMS, DAILY, CLUSTERS, SUMMARY], """
SELECT strftime(day, '%Y-%m-%d') AS day, rank, cluster, source_count FROM (
  SELECT *, row_number() OVER (PARTITION BY day ORDER BY source_count DESC, cluster) AS rank FROM summaries) WHERE rank <= 5"""))
def _(t):
    rows = daily(t)
    stories = br.cluster_summaries(rows, stage(br.story_clusters(rows), "clusters"))
    return br.rank_briefs(stories, 5).select(F.col("day").cast("string").alias("day"), F.col("rank").cast("bigint").alias("rank"), "cluster", "source_count")


HAY = "title || ' ' || summary || ' ' || array_to_string(entities, ' ')"
SELECTED = f"""ready AS (SELECT id, day, url, title, coalesce(nullif(evidence, ''), summary) AS summary, evidence, keywords, tags,
    {q.known_entities("title || ' ' || evidence || ' ' || array_to_string(tags, ' ')", CORPUS_ENTITIES)} AS entities FROM daily_all),
relevant AS (SELECT *, {q.content_key("title || ' ' || summary || ' ' || evidence")} AS text_key FROM ready
  WHERE url <> '' AND title <> '' AND {q.contains_any(HAY, CORPUS_TERMS)}
    AND NOT ({q.any_match('title', [rules.LOW_SIGNAL_PATTERN])} AND NOT {q.any_match(HAY, [rules.RESCUE_PATTERN])})),
daily AS (SELECT * FROM relevant QUALIFY text_key = '' OR row_number() OVER (PARTITION BY day, text_key ORDER BY id) = 1)"""
SELECTED_ITEMS = [q.OK_ITEMS, DAILY.replace("daily AS", "daily_all AS", 1), SELECTED]


@register("daily_briefs", "C5 C2 W9", recursive([*SELECTED_ITEMS, CLUSTERS, SUMMARY], f"""
SELECT strftime(day, '%Y-%m-%d') AS day, rank, cluster, title, strftime(day, '%Y-%m-%d') || '-' || {q.slug('title')} AS slug, source_count FROM (
  SELECT *, row_number() OVER (PARTITION BY day ORDER BY source_count DESC, cluster) AS rank FROM summaries) WHERE rank <= 12"""))
def _(t):
    return br.daily_briefs(t.ok_items, CORPUS_TERMS, CORPUS_ENTITIES).select(
        F.col("day").cast("string").alias("day"), F.col("rank").cast("bigint").alias("rank"), "cluster", "title", "slug", "source_count")


FILLERS = [r"^So,\s*", r"^Okay,\s*", r"^Now,\s*now\s*", r"\bbeautiful\b\.?", r"\bhere\b"]


def _fillers(x: str) -> str:
    x = q.strip_noise(x)
    for pattern in FILLERS:
        x = f"regexp_replace({x}, {q.quote(pattern)}, '', 'gi')"
    return q.collapse(x)


def _concepts(x: str) -> str:
    """At most five concepts of a text, first seen first."""
    found = f"list_concat(list_filter(regexp_extract_all({x}, '{GENERIC}', 0, 'i'), lambda p: length(p) > 3), list_filter([array_to_string(({q.words(x)})[1:5], ' ')], lambda p: p <> ''))"
    return f"coalesce((SELECT list(w ORDER BY pos) FROM (SELECT w, min(pos) AS pos FROM (SELECT unnest(c) AS w, unnest(range(len(c))) AS pos FROM (SELECT {found} AS c)) GROUP BY w ORDER BY pos LIMIT 5)), CAST([] AS VARCHAR[]))"


NEAR = "least(len({a}), len({b})) >= {least} AND len(list_intersect({a}, {b})) >= least(len({a}), len({b})) * {share} - 1e-9"
_near = lambda a, b: NEAR.format(a=a, b=b, least=rules.NEAR_DUPLICATE_MIN_WORDS, share=rules.NEAR_DUPLICATE_OVERLAP)
SECTIONS = f"""members AS (SELECT c.cluster AS grp, id, title, coalesce(nullif(evidence, ''), summary) AS summary, coalesce(nullif(evidence, ''), summary, title) AS text FROM daily JOIN clusters c USING (id)),
texts AS (SELECT grp, {q.collapse("string_agg(text, ' ' ORDER BY id)")} AS text FROM members GROUP BY grp),
{RANKED[RANKED.index("s AS (SELECT grp"):]},
best AS (SELECT grp, list(sentence ORDER BY rank) AS ev FROM (SELECT grp, sentence, row_number() OVER (PARTITION BY grp ORDER BY score DESC, no) AS rank FROM r) WHERE rank <= 12 GROUP BY grp),
spare AS (SELECT grp, list(lead ORDER BY id) AS sp FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY id) AS rn FROM (SELECT grp, id, {q.summarize('summary', 2)} AS lead FROM members) WHERE lead <> '') WHERE rn <= 12 GROUP BY grp),
told AS (SELECT *, {q.strip_noise("title || '. ' || array_to_string(ev, ' ')")} AS all_text FROM (SELECT cluster AS grp, title, coalesce(ev, sp, [title]) AS ev FROM summaries LEFT JOIN best ON best.grp = cluster LEFT JOIN spare ON spare.grp = cluster)),
begun AS (SELECT grp, title, ev, all_text, {_concepts('all_text')} AS cs FROM told),
grouping(grp, k, cs, ev, used, groups) AS (
  SELECT grp, 1, cs, ev, CAST([] AS VARCHAR[]), CAST([] AS STRUCT(concept VARCHAR, lines VARCHAR[])[]) FROM begun
  UNION ALL SELECT grp, k + 1, cs, ev, list_concat(used, hits), CASE WHEN len(hits) = 0 THEN groups ELSE list_append(groups, {{'concept': cs[k], 'lines': hits}}) END
  FROM (SELECT *, (list_filter(ev, lambda s: NOT list_contains(used, s) AND len(list_filter(terms, lambda t: contains(lower(s), t))) > 0))[1:3] AS hits
    FROM (SELECT *, {q.words('cs[k]')} AS terms FROM grouping WHERE k <= len(cs)))),
ended AS (SELECT grp, groups, list_filter(ev, lambda s: NOT list_contains(used, s)) AS rest FROM grouping WHERE k = len(cs) + 1),
cut AS (SELECT grp, list_concat(groups, list_transform(range(0, len(rest), 3), lambda i: {{'concept': CAST(NULL AS VARCHAR), 'lines': rest[i + 1:i + 3]}}))[1:4] AS g FROM ended),
parts AS (SELECT grp, unnest(g) AS part, unnest(range(len(g))) AS gi FROM cut),
lines AS (SELECT grp, gi, si, {_fillers('line')} AS text FROM (SELECT grp, gi, unnest(part.lines) AS line, unnest(range(len(part.lines))) AS si FROM parts)),
said AS (SELECT *, list_distinct({q.words('text')}) AS ws, {q.alnum_key('text', 180)} AS mark, row_number() OVER (PARTITION BY grp ORDER BY gi, si) AS k FROM lines),
picks(grp, k, tw, kept, sets, marks) AS (
  SELECT grp, 0, list_distinct({q.words('title')}), CAST([] AS BIGINT[]), CAST([] AS VARCHAR[][]), CAST([] AS VARCHAR[]) FROM begun
  UNION ALL SELECT grp, k + 1, tw, CASE WHEN again THEN kept ELSE list_append(kept, k + 1) END, CASE WHEN again THEN sets ELSE list_append(sets, ws) END, CASE WHEN again THEN marks ELSE list_append(marks, mark) END
  FROM (SELECT p.*, s.ws, s.mark, s.text = '' OR list_contains(marks, s.mark) OR ({_near('p.tw', 's.ws')}) OR len(list_filter(sets, lambda x: {_near('x', 's.ws')})) > 0 AS again
    FROM picks p JOIN said s ON s.grp = p.grp AND s.k = p.k + 1)),
chosen AS (SELECT grp, CASE WHEN len(kept) > 0 THEN kept ELSE [(SELECT min(s.k) FROM said s WHERE s.grp = p.grp AND s.text <> '')] END AS kept FROM (SELECT grp, arg_max(kept, k) AS kept FROM picks GROUP BY grp) p),
built AS (SELECT s.grp, s.gi, count(*) AS n, string_agg(s.text, ' ' ORDER BY s.k) AS joined FROM said s JOIN chosen c ON c.grp = s.grp AND list_contains(c.kept, s.k) GROUP BY s.grp, s.gi),
named AS (SELECT b.*, p.part.concept AS concept, row_number() OVER (PARTITION BY b.grp ORDER BY b.gi) - 1 AS section_no, {_concepts('joined')} AS own FROM built b JOIN parts p ON p.grp = b.grp AND p.gi = b.gi)"""


@register("story_sections", "C9 T5 T12 D13", recursive([q.OK_ITEMS, DAILY, CLUSTERS, SUMMARY, SECTIONS], f"""
SELECT grp AS cluster, CAST(section_no AS INTEGER) AS section_no, topic, theme, intent, lower(heading) AS heading, CAST(n AS INTEGER) AS n_paragraphs FROM (
  SELECT grp, section_no, n, {q.collapse("coalesce(nullif(concept, ''), own[1], 'Development')")} AS heading,
    {q.first_rule("concat_ws(' ', concept, joined)", rules.HEADING_RULES, rules.DEFAULT_THEME)} AS theme, {q.first_rule("concat_ws(' ', concept, joined)", rules.INTENT_RULES, rules.DEFAULT_INTENT)} AS intent,
    (SELECT {q.first_rule('all_text', rules.TOPIC_RULES, rules.DEFAULT_TOPIC)} FROM begun WHERE begun.grp = named.grp) AS topic FROM named)"""))
def _(t):
    rows = daily(t)
    clusters = stage(br.story_clusters(rows), "clusters")
    stories = stage(br.cluster_summaries(rows, clusters), "stories")
    patterns = se.concept_patterns(HEADS)
    # title case of headings has its own query
    return br.sections(stories, rows, clusters, CORPUS_SIGNALS, patterns).select(
        "cluster", "section_no", "topic", "theme", "intent", F.lower("heading").alias("heading"), F.size("paragraphs").alias("n_paragraphs"))


# items whose own summary is usable evidence
GATED = q.ITEMS + f""",
ok_items AS (SELECT * FROM items WHERE status = 'ok' AND {q.usable('summary', 'title')})"""
CANDIDATES = """cands AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY source_count DESC, cluster) AS rank FROM summaries) WHERE rank <= 12)"""
PARAS = "array_to_string(paras, ' ')"
# takeaways repeat paragraphs, so no rule of a story with 120 words depends on them
BRIEFS = f"""bodies AS (SELECT s.grp, list(s.text ORDER BY s.k) AS paras FROM said s JOIN chosen c ON c.grp = s.grp AND list_contains(c.kept, s.k) GROUP BY s.grp),
heads AS (SELECT grp, list({q.collapse("coalesce(nullif(concept, ''), own[1], 'Development')")} ORDER BY section_no) AS heads FROM named GROUP BY grp),
cited AS (SELECT grp, list(title ORDER BY id) AS titles, string_agg(evidence, ' ' ORDER BY id) AS told FROM (
  SELECT c.cluster AS grp, x.id, x.title, x.evidence, row_number() OVER (PARTITION BY c.cluster ORDER BY x.id) AS rn FROM daily x JOIN clusters c USING (id)) WHERE rn <= 12 GROUP BY grp),
briefs AS (SELECT *, array_to_string(heads, chr(10)) || chr(10) || array_to_string(paras, chr(10)) AS text, concat_ws(chr(10), title, paras[1], array_to_string(heads, chr(10)), {PARAS}) AS shown, list_distinct({q.words('title')}) AS tw
  FROM cands JOIN bodies ON bodies.grp = cluster JOIN heads ON heads.grp = cluster JOIN cited ON cited.grp = cluster),
echoes AS (SELECT cluster, bool_or(n < 18 OR (n < 40 AND shared / greatest(1, least(n, greatest(1, len(tw)))) >= 0.75) OR list_contains(marks, fp)) AS echo FROM (
  SELECT cluster, tw, len({q.words('p')}) AS n, len(list_filter({q.words('p')}, lambda w: list_contains(tw, w))) AS shared, list_transform(titles, lambda x: {q.alnum_key('x', 180)}) AS marks,
    {q.alnum_key("regexp_replace(p, '^[^:]{3,80}:\\s*', '')", 180)} AS fp FROM (SELECT cluster, tw, titles, unnest(paras) AS p FROM briefs)) GROUP BY cluster),
own_rules AS (SELECT b.*, [{q.word_count(PARAS)} >= 120, len(heads) >= 2, NOT coalesce(echo, false), NOT {q.any_match('array_to_string(heads, chr(10))', [rules.TEMPLATE_HEADING_PATTERN])},
    {q.term_hits(PARAS, CORPUS_TERMS)} >= 2, len(list_filter(titles, lambda x: length({q.headline('x')}) > 28 AND contains(lower({PARAS}), lower({q.headline('x')})))) = 0,
    NOT {q.any_match('text', rules.META_PATTERNS)}, len({q.grounding_terms('told')}) > 0,
    len({q.grounding_terms('told')}) = 0 OR len(list_intersect({q.grounding_terms('told')}, {q.grounding_terms('text')})) >= least(4, greatest(2, ceil(len({q.grounding_terms('told')}) * 0.2)))] AS own
  FROM briefs b LEFT JOIN echoes USING (cluster)),
rubric AS (SELECT *, @expected AS expected, @hits AS hits FROM own_rules),
checked AS (SELECT *, MAP {{'citation-coverage': true, 'citation-richness': true, 'link-health': true, 'grounding': true, 'detail-level': {q.word_count(PARAS)} >= 90,
    'relevance': len(expected) = 0 OR len(list_intersect(expected, {q.keywords('shown')})) >= greatest(1, least(3, ceil(len(expected) * 0.2))),
    'speculation-boundary': NOT {q.any_match('shown', ['speculation as fact|will definitely|guaranteed to'])}, 'reader-facing-language': NOT {q.any_match('shown', rules.INTERNAL_LANGUAGE_PATTERNS)},
    'tone-match': NOT {q.any_match('shown', rules.WIKI_LIKE_PATTERNS)} AND hits >= 2, 'word-choice': @avoided = 0 AND hits >= 2, 'voice-adherence': NOT {q.any_match('shown', rules.HYPE_PATTERNS)}}} AS marks FROM rubric),
verdicts AS (SELECT c.cluster, any_value(c.day) AS day, any_value(c.rank) AS rank, any_value(c.title) AS title, any_value(len(list_filter(own, lambda x: NOT x))) AS failed_rules,
    sum(CASE WHEN marks[rule] THEN CAST(weight AS DOUBLE) ELSE 0 END) / sum(CAST(weight AS DOUBLE)) AS raw, count(*) FILTER (required AND NOT marks[rule]) AS required_failures, count(*) FILTER (NOT marks[rule]) AS failures
  FROM checked c, weights GROUP BY c.cluster),
judged AS (SELECT *, (9 - failed_rules + 11 - failures) / 20 AS mean FROM verdicts)"""


def gated_sql(select):
    from newsloom.catalog.quality import ARTICLE, HARD, WEIGHTS

    terms = {"@expected": q.keywords("title || ' ' || array_to_string(titles, ' ')"), "@hits": q.term_hits("shown", HARD), "@avoided": q.term_hits("shown", ARTICLE["avoid"])}
    briefs = BRIEFS
    for mark, text in terms.items():
        briefs = briefs.replace(mark, text)
    return recursive([GATED, *SELECTED_ITEMS[1:], CLUSTERS, SUMMARY, SECTIONS, CANDIDATES, WEIGHTS, briefs], select)


PASSED = "failed_rules = 0 AND required_failures = 0 AND round(raw, 9) >= 0.86 AND mean >= 0.86"


@register("publishable_stories", "C10 W10 Q14", gated_sql(f"""
SELECT strftime(day, '%Y-%m-%d') AS day, CAST(place AS INTEGER) AS place, cluster AS output_id, title, failed_rules, round(raw, 4) AS rubric_score, round(least(mean, round(raw, 4)), 4) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY day ORDER BY rank) AS place FROM judged WHERE {PASSED}) WHERE place <= 4"""))
def _(t):
    from newsloom.catalog.quality import ARTICLE

    return br.publishable(t.ok_items, CORPUS_TERMS, CORPUS_ENTITIES, 4, 3, CORPUS_TERMS, CORPUS_SIGNALS, se.concept_patterns(HEADS), ARTICLE).select(
        F.col("day").cast("string").alias("day"), "place", "output_id", "title", "failed_rules", "rubric_score", "score")


@register("story_verdicts", "C10 Q13 Q14", gated_sql(f"SELECT cluster AS output_id, failed_rules, ({PASSED}) AS passed FROM judged"))
def _(t):
    """Every candidate, published or not."""
    from newsloom.catalog.quality import ARTICLE

    return br.judged_briefs(t.ok_items, CORPUS_TERMS, CORPUS_ENTITIES, 12, CORPUS_TERMS, CORPUS_SIGNALS, se.concept_patterns(HEADS), ARTICLE)[1].select("output_id", "failed_rules", "passed")


@register("publish_quota", "W10", """
SELECT strftime(day, '%Y-%m-%d') AS day, event_id, place FROM (
  SELECT CAST(ts AS DATE) AS day, event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) AS place FROM events WHERE value >= 10) WHERE place <= 7""")
def _(t):
    from newsloom.operators.quality import publish_quota

    rows = t.events.select(F.to_date("ts").cast("string").alias("day"), "event_id", (F.col("value") >= 10).alias("passed"))
    return publish_quota(rows, 7, "day", ["event_id"]).select("day", "event_id", F.col("place").cast("bigint").alias("place"))
