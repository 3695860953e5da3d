"""Deduplication queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom import rules
from newsloom.catalog import sqltext as q
from newsloom.catalog.base import register
from newsloom.functions import text as tx
from newsloom.operators import dedup as dd, knowledge as kn

DEDUP_URL = "'https://www.' || source || '.example/' || (n_chars // 10) || '/?utm_source=x'"


@register("greedy_two_key_dedup", "D2", f"""
WITH RECURSIVE keyed AS MATERIALIZED (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn,
    {q.canonical_key('url')} AS u, {q.content_key('text')} AS t
  FROM (SELECT *, {DEDUP_URL} AS url FROM documents)),
walk AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS kept, CAST([] AS VARCHAR[]) AS us, CAST([] AS VARCHAR[]) AS ts
  UNION ALL SELECT k.rn, CASE WHEN hit THEN kept ELSE list_append(kept, doc_id) END,
    CASE WHEN hit THEN us ELSE list_append(us, u) END, CASE WHEN hit OR t = '' THEN ts ELSE list_append(ts, t) END
  FROM (SELECT w.kept, w.us, w.ts, k.*, (list_contains(w.us, k.u) OR (k.t <> '' AND list_contains(w.ts, k.t))) AS hit
        FROM walk w JOIN keyed k ON k.rn = w.rn + 1) k)
SELECT unnest(kept) AS doc_id FROM (SELECT kept FROM walk ORDER BY rn DESC LIMIT 1)""")
def _(t):
    url = F.concat(F.lit("https://www."), "source", F.lit(".example/"), F.floor(F.col("n_chars") / 10).cast("string"), F.lit("/?utm_source=x"))
    rows = t.documents.select("doc_id", "text", url.alias("url"))
    return dd.dedupe_citations_like(rows, "doc_id", "url", F.col("text")).select("doc_id")


NEAR = f"""sets AS (SELECT doc_id, list_distinct({q.words('text')}) AS ws FROM documents),
big AS (SELECT doc_id, len(ws) AS n, ws FROM sets WHERE len(ws) >= 5),
tok AS (SELECT doc_id, n, unnest(ws) AS w FROM big),
pairs AS (SELECT a.doc_id AS lo, b.doc_id AS hi FROM tok a JOIN tok b ON a.w = b.w AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) / least(a.n, b.n) >= 0.78),
nodes AS MATERIALIZED (SELECT hi, row_number() OVER (ORDER BY hi) AS rn, list(lo) AS lows FROM pairs GROUP BY hi),
walk AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS gone
  UNION ALL SELECT n.rn, CASE WHEN len(list_filter(n.lows, lambda x: NOT list_contains(w.gone, x))) > 0 THEN list_append(w.gone, n.hi) ELSE w.gone END
  FROM walk w JOIN nodes n ON n.rn = w.rn + 1)"""


@register("near_duplicate_documents", "D3", f"""
WITH RECURSIVE {NEAR}
SELECT unnest(gone) AS doc_id FROM (SELECT gone FROM walk ORDER BY rn DESC LIMIT 1)""")
def _(t):
    return dd.near_duplicates(t.documents, "doc_id", "text").select("doc_id").distinct()


@register("unique_sentences", "D4", f"""
SELECT doc_id, sentence FROM (
  SELECT doc_id, sentence, row_number() OVER (PARTITION BY doc_id, {q.alnum_key('sentence', 120)} ORDER BY pos) AS rn
  FROM (SELECT doc_id, unnest(s) AS sentence, unnest(range(len(s))) AS pos FROM (SELECT doc_id, {q.sentences('text')} AS s FROM documents))
  WHERE {q.alnum_key('sentence', 120)} <> '') WHERE rn = 1""")
def _(t):
    return dd.unique_sentences(t.documents, "text", "s").select("doc_id", F.explode("s").alias("sentence"))


@register("citation_key_dedup", "D8", q.with_([q.PAGE_LINKS], f"""
SELECT page_id, url_key, pos FROM (SELECT page_id, pos, {q.canonical_key('url')} AS url_key,
  row_number() OVER (PARTITION BY page_id, {q.canonical_key('url')} ORDER BY pos) AS rn FROM page_links) WHERE rn = 1 AND url_key <> ''"""))
def _(t):
    return dd.citations_by_key(t.page_links, "page_id", ["pos"]).select("page_id", "url_key", "pos")


@register("citation_url_dedup", "D9", q.with_([q.PAGE_LINKS], """
SELECT page_id, title, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id, coalesce(url2, '{"title":"' || title || '"}') ORDER BY pos) AS rn
  FROM (SELECT page_id, pos, 'link' AS title, CASE WHEN pos % 3 = 0 THEN NULL ELSE url END AS url2 FROM page_links)) WHERE rn = 1"""))
def _(t):
    cited = t.page_links.select("page_id", "pos", F.lit("link").alias("title"), F.when(F.col("pos") % 3 != 0, F.col("url")).alias("url"))
    return dd.citations_by_url(cited, "page_id", ["pos"]).select("page_id", "title", "pos")


@register("repeated_line_removal", "D10 D11", f"""
SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS body FROM (
  SELECT doc_id, line, pos, row_number() OVER (PARTITION BY doc_id, {q.block_key('line')} ORDER BY pos) AS rn
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
  WHERE {q.block_key('line')} <> '') WHERE rn = 1 GROUP BY doc_id""")
def _(t):
    # the documents have no blank-line blocks, so their lines are the blocks
    return dd.unique_blocks(t.documents, "text", "body", separator=r"\n", glue="\n").filter(F.col("body") != "").select("doc_id", "body")


@register("markdown_body_dedup", "D10 D11", f"""
SELECT doc_id, '# Title' || chr(10) || chr(10) || lead || chr(10) || chr(10) || '- ' || lead || chr(10) || '- end' || chr(10) || chr(10) || '# Title' AS body
FROM (SELECT doc_id, array_to_string(string_split({q.collapse('text')}, ' ')[1:8], ' ') AS lead FROM documents)
WHERE {q.alnum_key('lead', 240)} NOT IN ('', 'end')""")
def _(t):
    lead = F.substring_index(tx.collapse(F.col("text")), " ", 8)
    nn, dash = F.lit("\n\n"), F.lit("\n- ")
    body = F.concat(F.lit("# Title"), nn, lead, nn, F.lit("- "), lead, dash, lead, dash, F.lit("end"), nn, F.lit("# Title"), nn, lead)
    rows = t.documents.filter(~tx.block_key(lead).isin("", "end")).select("doc_id", body.alias("raw"))
    return dd.unique_blocks(rows, "raw", "body").select("doc_id", "body")


def dev_text(x):
    t = f"regexp_replace({x}, 'https?://\\S+', ' ', 'gi')"
    t = f"regexp_replace({t}, '([a-z])([A-Z])', '\\1 \\2', 'g')"
    t = f"regexp_replace({t}, '\\.([A-Z])', '. \\1', 'g')"
    t = q.collapse(f"regexp_replace({q.collapse(t)}, '\\s+[-|]\\s+[^-|]{{2,40}}$', '')")
    return f"CASE WHEN regexp_matches({t}, '^[a-z]') THEN upper(substring({t}, 1, 1)) || substring({t}, 2) ELSE {t} END"


USEFUL = f"length(text) >= 35 AND NOT {q.any_match('text', rules.DEVELOPMENT_DENY)} AND {q.any_match('text', [rules.DEVELOPMENT_ALLOW])}"


RAW_DEVELOPMENTS = f"""raw AS (
  SELECT source_name AS packet, 0 AS origin, id * 1000 + pos AS pos, {dev_text('sentence')} AS text
  FROM (SELECT *, unnest(s) AS sentence, unnest(range(1, len(s) + 1)) AS pos FROM (SELECT *, ({q.sentences('summary')})[1:4] AS s FROM ok_items))
  UNION ALL SELECT source_name, 1, id, {dev_text('title')} FROM ok_items)"""


@register("useful_developments", "D12 F9", q.with_([q.OK_ITEMS, RAW_DEVELOPMENTS], f"""
SELECT packet, origin, text FROM (
  SELECT *, row_number() OVER (PARTITION BY packet, substring(lower(text), 1, 90) ORDER BY origin, pos) AS rn FROM raw WHERE {USEFUL}) WHERE rn = 1"""))
def _(t):
    claims = kn.claims(t.ok_items).select(F.col("source_name").alias("packet"), (F.col("evidence_id") * 1000 + F.col("pos")).alias("pos"), "text")
    titles = t.ok_items.select(F.col("source_name").alias("packet"), F.col("id").alias("pos"), F.col("title").alias("text"))
    return dd.developments(claims, titles, "packet").select("packet", F.col("origin").cast("bigint").alias("origin"), "text")


PARAS = f"""lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
sets AS (SELECT doc_id * 10000 + pos AS ord, doc_id, pos, list_distinct({q.words('line')}) AS ws FROM lines),
tok AS (SELECT ord, doc_id, len(ws) AS n, unnest(ws) AS w FROM sets WHERE len(ws) >= 5),
pairs AS (SELECT a.ord AS lo, b.ord AS hi FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND a.w = b.w AND a.ord < b.ord
  GROUP BY a.ord, b.ord, a.n, b.n HAVING count(*) / least(a.n, b.n) >= 0.78),
nodes AS MATERIALIZED (SELECT hi, row_number() OVER (ORDER BY hi) AS rn, list(lo) AS lows FROM pairs WHERE hi % 10000 <> 0 GROUP BY hi),
walk AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS gone
  UNION ALL SELECT n.rn, CASE WHEN len(list_filter(n.lows, lambda x: NOT list_contains(w.gone, x))) > 0 THEN list_append(w.gone, n.hi) ELSE w.gone END
  FROM walk w JOIN nodes n ON n.rn = w.rn + 1)"""


@register("repeated_paragraphs", "D13 D3", f"""
WITH RECURSIVE {PARAS}
SELECT unnest(gone) AS ord FROM (SELECT gone FROM walk ORDER BY rn DESC LIMIT 1)""")
def _(t):
    """Lines that repeat an earlier line of their document; the first line
    stands for the dek and always stays."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = lines.select((F.col("doc_id") * 10000 + F.col("pos")).alias("ord"), "doc_id", "pos", "line")
    return dd.near_duplicates(rows, "ord", "line", scope=F.col("doc_id"), fixed=F.col("pos") == 0).select("ord").distinct()


@register("case_insensitive_strings", "D14", f"""
SELECT doc_id, string_agg(w, ' ' ORDER BY pos) AS words FROM (
  SELECT doc_id, w, pos, row_number() OVER (PARTITION BY doc_id, lower(w) ORDER BY pos) AS rn
  FROM (SELECT doc_id, unnest(l) AS w, unnest(range(len(l))) AS pos FROM (SELECT doc_id, string_split({q.collapse('text')}, ' ') AS l FROM documents)))
WHERE rn = 1 GROUP BY doc_id""")
def _(t):
    return dd.unique_strings(t.documents, F.split(tx.collapse(F.col("text")), " "), "w").select("doc_id", F.array_join("w", " ").alias("words"))
