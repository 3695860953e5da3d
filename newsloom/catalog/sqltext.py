"""SQL text shared by the expected-result statements (DuckDB dialect).

Each function returns the SQL of one expression; the CTE constants define
the adapter views.
"""

from __future__ import annotations

from newsloom import rules


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def str_list(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def collapse(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"


def raw_sentences(x: str) -> str:
    return rf"string_split(regexp_replace({collapse(x)}, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10))"


def sentences(x: str) -> str:
    return f"list_filter({raw_sentences(x)}, lambda s: s <> '')"


def summarize(x: str, n: int) -> str:
    picked = f"(list_filter({raw_sentences(x)}, lambda s: length(s) > 40))[1:{n}]"
    return (
        f"CASE WHEN {collapse(x)} = '' THEN {quote(rules.NO_TEXT_PLACEHOLDER)} "
        f"WHEN len({picked}) > 0 THEN array_to_string({picked}, ' ') ELSE substring({collapse(x)}, 1, 500) END"
    )


def slug(x: str, cap: int | None = 80, quotes: bool = True, fallback: str | None = None) -> str:
    t = f"trim(lower({x}))"
    if quotes:
        t = f"regexp_replace({t}, '[''\"]', '', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
    if cap:
        t = f"substring({t}, 1, {cap})"
    if fallback:
        t = f"coalesce(nullif({t}, ''), {quote(fallback)})"
    return t


def ellipsis(x: str, n: int) -> str:
    c = collapse(x)
    return f"CASE WHEN length({c}) > {n} THEN rtrim(substring({c}, 1, {n - 3})) || '...' ELSE {c} END"


def words(x: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(replace(lower(coalesce({x}, '')), '&', ' and '), '[^a-z0-9]+'), "
        f"lambda w: length(w) > 2 AND NOT list_contains({str_list(rules.STOP_WORDS)}, w))"
    )


def search_tokens(x: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({x}, '')), 'https?://\\S+', ' ', 'g'), "
        f"'[^a-z0-9+#.\\-]+'), lambda w: length(w) > 2)"
    )


def keywords(x: str) -> str:
    t = f"regexp_replace(lower(coalesce({x}, '')), 'https?://\\S+', ' ', 'g')"
    t = f"regexp_replace({t}, '[^a-z0-9\\s-]', ' ', 'g')"
    t = f"list_transform(regexp_split_to_array({t}, '\\s+'), lambda w: regexp_replace(w, '^-+|-+$', '', 'g'))"
    return (
        f"list_distinct(list_filter({t}, lambda w: length(w) >= 4 AND NOT "
        f"list_contains({str_list(rules.RELEVANCE_STOP_WORDS)}, w)))"
    )


def alnum_key(x: str, n: int) -> str:
    return f"substring(trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g')), 1, {n})"


def content_key(x: str) -> str:
    t = f"trim(regexp_replace(regexp_replace(lower({collapse(x)}), 'https?://\\S+', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
    w = f"list_filter(string_split({t}, ' '), lambda w: length(w) > 2)"
    return f"CASE WHEN len({w}) < 8 THEN '' ELSE array_to_string(({w})[1:42], ' ') END"


def block_key(x: str) -> str:
    t = f"regexp_replace(lower(coalesce({x}, '')), '\\]\\((https?://[^)]+)\\)', ']', 'g')"
    return alnum_key(f"regexp_replace({t}, 'https?://\\S+', ' ', 'g')", 240)


def word_count(x: str) -> str:
    return f"len(list_filter(string_split({collapse(x)}, ' '), lambda w: w <> ''))"


def strip_noise(x: str) -> str:
    return collapse(
        f"regexp_replace(coalesce({x}, ''), '\\bThe post\\s+.+?\\s+appeared first on\\s+[^.?!]+[.?!]?', ' ', 'gis')"
    )


def headline(x: str) -> str:
    return collapse(f"regexp_replace(coalesce({x}, ''), '\\s+-\\s+[^-]+$', '')")


def first_rule(x: str, table, default: str) -> str:
    """Tag of the first rule with a needle in the lower-cased text."""
    return "CASE " + " ".join(f"WHEN {contains_any(x, needles)} THEN {quote(tag)}" for _, needles, tag in sorted(table)) + f" ELSE {quote(default)} END"


def reader(x: str) -> str:
    """Internal ids and jargon rewritten, in order."""
    steps = [(r"https?://\S+", " ", "gi"), (r"\b(?:claim|topic|community|source-doc):[a-z0-9_.:-]+", " ", "gi"), (r"\bknowledge graph\b", "source corpus", "gi"),
             (r"\bgraph\b", "source corpus", "gi"), (r"\bnode\b", "source", "gi"), (r"\bneighborhood\b", "topic area", "gi"), (r"\btraversal\b", "research", "gi"),
             (r"([a-z])([A-Z])", r"\1 \2", "g"), (r"\.([A-Z])", r". \1", "g"), (r"\bOpen AI\b", "OpenAI", "g"), (r"\bGit Hub\b", "GitHub", "g"),
             (r"\bDeep Mind\b", "DeepMind", "g"), (r"\bx AI\b", "xAI", "g")]
    for pattern, new, flags in steps:
        x = f"regexp_replace({x}, {quote(pattern)}, {quote(new)}, '{flags}')"
    return collapse(x)


def title_only(text: str, title: str) -> str:
    e, h = headline(text), headline(title)
    a, b = f"list_distinct({words(e)})", f"list_distinct({words(h)})"
    return (
        f"({e} <> '' AND {h} <> '' AND ({alnum_key(e, 180)} = {alnum_key(h, 180)} OR "
        f"(least(len({a}), len({b})) > 0 AND {word_count(e)} <= {word_count(h)} + 4 AND "
        f"len(list_intersect({a}, {b})) / greatest(1, least(len({a}), len({b}))) >= 0.8)))"
    )


def usable(text: str, title: str) -> str:
    t = strip_noise(text)
    return (
        f"({t} <> '' AND NOT regexp_matches({t}, {quote('(?i)' + rules.UNUSABLE_TEXT_PATTERN)}) "
        f"AND NOT {title_only(t, title)} AND {word_count(t)} >= 5)"
    )


def grounding_terms(x: str) -> str:
    w = f"list_filter({words(x)}, lambda w: length(w) > 3 AND NOT list_contains({str_list(rules.GENERIC_GROUNDING_WORDS)}, w))"
    return f"list_distinct(({w})[1:120])"


def has_term(x: str, term: str) -> str:
    special = set(".*+?^${}()|[]\\")
    body = "".join(f"\\{c}" if c in special else c for c in term.strip()).replace(" ", "[\\s-]+")
    return f"regexp_matches({x}, {quote('(?i)' + chr(92) + 'b' + body + chr(92) + 'b')})"


def term_hits(x: str, terms) -> str:
    unique = list(dict.fromkeys(t.lower() for t in terms))
    return "(" + " + ".join(f"CAST({has_term(x, t)} AS BIGINT)" for t in unique) + ")"


def any_match(x: str, patterns) -> str:
    return f"regexp_matches({x}, {quote('(?i)' + '|'.join(f'(?:{p})' for p in patterns))})"


def contains_any(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), {quote(t)})" for t in terms) + ")"


def known_entities(x: str, pairs) -> str:
    parts = ", ".join(f"CASE WHEN contains(lower({x}), {quote(n)}) THEN {quote(lab)} END" for n, lab in pairs)
    return f"list_filter([{parts}], lambda e: e IS NOT NULL)"


def entities(x: str) -> str:
    t = f"regexp_replace(coalesce({x}, ''), 'https?://\\S+', ' ', 'g')"
    t = f"regexp_replace({t}, '\\b(?:Article URL|Comments URL|Points|# Comments):', ' ', 'g')"
    run = r"\b(?:[A-Z][A-Za-z0-9+.\-]*(?:\s+[A-Z][A-Za-z0-9+.\-]*){0,3})\b"
    return (
        f"list_filter(regexp_extract_all({t}, '{run}'), lambda m: length(m) > 2 AND NOT "
        f"list_contains({str_list(rules.STOP_ENTITIES)}, m))"
    )


def strip_html(x: str) -> str:
    t = f"regexp_replace(coalesce({x}, ''), '<script.*?</script>', ' ', 'gis')"
    t = f"regexp_replace({t}, '<style.*?</style>', ' ', 'gis')"
    return collapse(f"regexp_replace({t}, '<[^>]+>', ' ', 'g')")


def decode_entities(x: str) -> str:
    for name, ch in [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                     ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]:
        x = f"replace({x}, {quote(name)}, {quote(ch)})"
    return x


def visible(x: str) -> str:
    return strip_html(decode_entities(f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"))


def drop_blocks(x: str) -> str:
    for name in ["script", "style", "nav", "footer", "noscript"]:
        x = f"regexp_replace({x}, '<{name}\\b.*?(?:</{name}\\s*>|$)', ' ', 'gis')"
    return f"regexp_replace({x}, '<!--.*?-->', ' ', 'gs')"


def paragraphs(x: str) -> str:
    """Split at paragraph starts and block tags instead of matching ahead."""
    closers = "article|aside|blockquote|body|div|footer|form|h[1-6]|header|hr|html|main|nav|ol|p|pre|section|table|ul"
    t = f"regexp_replace({drop_blocks(x)}, '<p(?:\\s[^>]*)?>', chr(1) || 'P', 'gi')"
    t = f"regexp_replace({t}, '(</?(?:{closers})[\\s>/])', chr(1) || 'E\\1', 'gi')"
    opened = f"list_filter(string_split({t}, chr(1)), lambda s: s[1] = 'P')"
    return f"list_filter(list_transform({opened}, lambda s: {visible('s[2:]')}), lambda s: length(s) >= 24)"


def body_text(x: str) -> str:
    """Text of main, else article, else body, else the whole page."""
    clean = drop_blocks(x)
    inside = lambda tag: visible(f"regexp_extract({clean}, '<{tag}\\b[^>]*>(.*?)(?:</{tag}\\s*>|$)', 1, 'is')")
    return f"coalesce(nullif({inside('main')}, ''), nullif({inside('article')}, ''), nullif({inside('body')}, ''), {visible(clean)})"


def text_spans(x: str) -> str:
    """Paragraphs, else the whole body text when long enough."""
    return f"coalesce(nullif({paragraphs(x)}, CAST([] AS VARCHAR[])), list_filter([{body_text(x)}], lambda s: length(s) >= 24))"


def concept_name(x: str) -> str:
    named = f"regexp_replace(regexp_replace({strip_noise(x)}, '\\bllm\\b', 'LLM', 'gi'), '\\bai\\b', 'AI', 'gi')"
    fixed = [("recurrence based memory|rec memory", "Recurrent Memory"), ("semantic store", "Semantic Memory"), ("episodic store", "Episodic Memory")]
    return "CASE " + " ".join(f"WHEN regexp_matches({named}, {quote(p)}, 'i') THEN {quote(name)}" for p, name in fixed) + f" ELSE {named} END"


def url_part(x: str, i: int) -> str:
    return rf"regexp_extract(trim({x}), '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#\s]+)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$', {i})"


def is_url(x: str) -> str:
    return rf"regexp_matches(trim({x}), '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#\s]+)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$')"


def scheme(x: str) -> str:
    return f"lower({url_part(x, 1)})"


def authority(x: str) -> str:
    h = f"lower(regexp_replace({url_part(x, 2)}, '^.*@', ''))"
    return (
        f"CASE {scheme(x)} WHEN 'https' THEN regexp_replace({h}, ':443$', '') "
        f"WHEN 'http' THEN regexp_replace({h}, ':80$', '') ELSE {h} END"
    )


def hostname(x: str) -> str:
    return f"regexp_replace({authority(x)}, ':\\d+$', '')"


def bare_host(x: str) -> str:
    return f"regexp_replace({hostname(x)}, '^www\\.', '')"


def path(x: str) -> str:
    p = url_part(x, 3)
    enc = (
        f"array_to_string(list_transform(string_split({p}, ''), lambda c: CASE WHEN regexp_matches(c, '[^\\x21-\\x7e]') "
        f"THEN url_encode(c) ELSE c END), '')"
    )
    return f"CASE WHEN {p} = '' THEN '/' WHEN regexp_matches({p}, '[^\\x21-\\x7e]') THEN {enc} ELSE {p} END"


def search(x: str, drop_tracking: bool) -> str:
    pairs = f"list_filter(string_split({url_part(x, 4)}, '&'), lambda p: p <> '')"
    if drop_tracking:
        pairs = (
            f"list_filter({pairs}, lambda p: NOT regexp_matches(split_part(p, '=', 1), '(?i)^(utm_.*|fbclid|gclid|oc)$'))"
        )
    keyed = f"list_sort(list_transform({pairs}, lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END))"
    return f"CASE WHEN len({pairs}) > 0 THEN '?' || array_to_string({keyed}, '&') ELSE '' END"


def canonical_uri(x: str) -> str:
    return (
        f"CASE WHEN {is_url(x)} THEN {scheme(x)} || '://' || {authority(x)} || ({path(x)}) || ({search(x, False)}) END"
    )


def canonical_key(x: str) -> str:
    """Without the video and post aliases, which the pages do not have."""
    return (
        f"CASE WHEN NOT {is_url(x)} THEN lower({collapse(x)}) ELSE {bare_host(x)} || "
        f"lower(regexp_replace({path(x)}, '/+$', '')) || ({search(x, True)}) END"
    )


def hash_id(x: str, n: int) -> str:
    return f"substring(sha256({x}), 1, {n})"


BODY = collapse("text")

ITEMS = f"""items AS (
  SELECT doc_id AS id, source AS source_name, lang AS kind,
         array_to_string(string_split(body, ' ')[1:8], ' ') AS title, body AS summary,
         'https://' || source || '.example/' || doc_id AS url,
         DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS day,
         [lang, source] AS tags,
         CASE WHEN quality = 0 THEN 'error' ELSE 'ok' END AS status
  FROM (SELECT *, {BODY} AS body FROM documents) d LEFT JOIN labels USING (doc_id))"""

OK_ITEMS = ITEMS + ",\nok_items AS (SELECT * FROM items WHERE status = 'ok')"

LEDGER = """ledger AS (
  SELECT event_id AS seq, user_id AS id,
         CASE event_type WHEN 'signup' THEN 'discovered' WHEN 'view' THEN 'parsed' WHEN 'click' THEN 'briefed'
              WHEN 'purchase' THEN 'enriched' WHEN 'error' THEN 'revisit_pending' ELSE 'discovered' END AS status,
         ts AS observed_at, value AS score, event_type, props FROM events)"""

PAGE_LINKS = rf"""page_links AS (
  SELECT page_id, page_url, pos, href,
    CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href
         WHEN starts_with(href, '//') THEN {scheme('page_url')} || ':' || href
         WHEN starts_with(href, '/') THEN {scheme('page_url')} || '://' || {authority('page_url')} || href
         WHEN starts_with(href, '#') THEN {scheme('page_url')} || '://' || {authority('page_url')} || ({path('page_url')}) || href
         ELSE {scheme('page_url')} || '://' || {authority('page_url')} || regexp_replace({path('page_url')}, '[^/]*$', '') || href END AS url
  FROM (SELECT page_id, url AS page_url, unnest(hrefs) AS href, unnest(range(1, len(hrefs) + 1)) AS pos
        FROM (SELECT *, regexp_extract_all(html, '<a\b[^>]*?\shref\s*=\s*["'']([^"'']*)["'']', 1, 'is') AS hrefs FROM pages)))"""

NAMES = f"""names AS (
  SELECT id, url, title, source_name, unnest(found) AS name, unnest(range(1, len(found) + 1)) AS pos
  FROM (SELECT *, list_concat({entities('title')}, {entities('summary')}) AS found FROM ok_items))"""


def with_(ctes, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select
