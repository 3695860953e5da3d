"""Text expressions. Each function maps a string Column to a Column.

Regular expressions keep ECMAScript meaning: ``\\b`` is an ASCII word
boundary and ``\\s`` covers the Unicode spaces; ``js_pattern`` rewrites a
pattern so that the JVM regex engine agrees.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from newsloom import rules

# one table look-up tells all characters below 256; a range test keeps most others from the list of single ones
_SPACE_CHARS = r" \t\n\x0b\f\r\x{00a0}[\x{1680}-\x{feff}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]]"
SPACE = f"[{_SPACE_CHARS}]"
NON_SPACE = f"[^{_SPACE_CHARS}]"
_W = "[A-Za-z0-9_]"
BOUNDARY = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"
# the end mark is looked up behind the first space, which most places lack
SENTENCE_GAP = rf"{SPACE}(?<=[.!?]{SPACE}){SPACE}*"
# white space that is not one blank alone, which may stay
_UNEVEN = rf"{SPACE}(?:(?<! ){SPACE}*|{SPACE}+)"
URL_TOKEN = rf"https?://{NON_SPACE}+"


def _before_choice(choice: str) -> str:
    """A word boundary in front of a choice of words."""
    first = "".join(sorted({w[:1] for w in choice.split("|")}))
    return f"(?=[{first}])(?<!{_W})" if re.fullmatch(r"\w+", first, re.ASCII) and "" not in choice.split("|") else BOUNDARY


def js_pattern(pattern: str) -> str:
    """Rewrite ``\\b``, ``\\s`` and ``\\S`` to their ECMAScript meaning."""
    marked = pattern.replace(r"[\s-]", "\0").replace(r"\S", "\1").replace(r"\s", "\2")
    # beside a word character one look is enough; the character is looked at first
    marked = re.sub(r"\\b(?=([A-Za-z0-9_])(?![?*{]))", lambda m: f"(?={m.group(1)})(?<!{_W})", marked)
    marked = re.sub(r"\\b(?=(\[a-z0-9\])\+)", lambda m: f"(?={m.group(1)})(?<!{_W})", marked)
    marked = re.sub(r"\\b(?=\((?:\?:)?([A-Za-z0-9_ |-]+)\))", lambda m: _before_choice(m.group(1)), marked)
    marked = re.sub(r"(?<!\\)([A-Za-z0-9_])\\b", rf"\1(?!{_W})", marked)
    marked = marked.replace(r"\b", BOUNDARY)
    return marked.replace("\0", f"[{_SPACE_CHARS}-]").replace("\1", NON_SPACE).replace("\2", SPACE)


def _opening_literal(pattern: str) -> str | None:
    """Lower-case literal that every match of a pattern starts with."""
    if "|" in pattern:
        return None
    body = pattern.removeprefix("^").removeprefix(r"\b")
    run = re.match(r"[A-Za-z0-9 :-]*", body).group()
    if body[len(run):len(run) + 1] in ("?", "*", "{"):
        run = run[:-1]
    return run.lower() if len(run) >= 3 else None


def _opening_literals(pattern: str) -> list[str | None]:
    """Opening literals of a pattern, one for each of its choices if it is a choice of plain words."""
    choice = re.fullmatch(r"\\b\(([A-Za-z0-9 |:-]+)\)\\b", pattern)
    return [_opening_literal(x) for x in choice.group(1).split("|")] if choice else [_opening_literal(pattern)]


def any_match(c: Column, patterns: Sequence[str], low: Column | None = None) -> Column:
    """True when the text matches one of the patterns, ignoring case; ``low``
    is the lower-cased text, where a column holds it.

    Where every pattern opens with a literal, texts without any of the
    literals are told apart by substring tests alone.
    """
    hit = c.rlike("(?i)" + "|".join(f"(?:{js_pattern(p)})" for p in patterns))
    literals = list(dict.fromkeys(x for p in patterns for x in _opening_literals(p)))
    return hit if None in literals else contains_any(c, literals, low) & hit


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def collapse(c: Column) -> Column:
    """Runs of white space to one blank, ends trimmed, null to empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), _UNEVEN, " "))


def sentences(c: Column) -> Column:
    return F.filter(F.split(collapse(c), SENTENCE_GAP), lambda s: s != "")


def summarize(c: Column, limit: int = 3) -> Column:
    """First sentences longer than 40 characters, else the first 500
    characters, else a placeholder."""
    def told(body: Column) -> Column:
        picked = F.slice(F.filter(F.split(body, SENTENCE_GAP), lambda s: F.length(s) > 40), 1, limit)
        rest = let(picked, lambda p: F.when(F.size(p) > 0, F.array_join(p, " ")).otherwise(F.substring(body, 1, 500)))
        return F.when(body == "", F.lit(rules.NO_TEXT_PLACEHOLDER)).otherwise(rest)

    return let(collapse(c), told)


def non_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def slug(c: Column, cap: int | None = 80, drop_quotes: bool = True, fallback: str | None = None) -> Column:
    text = F.trim(F.lower(c))
    if drop_quotes:
        text = F.regexp_replace(text, "['\"]", "")
    text = F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    if cap is not None:
        text = F.substring(text, 1, cap)
    if fallback is not None:
        text = F.coalesce(non_empty(text), F.lit(fallback))
    return text


def topic_slug(c: Column) -> Column:
    return slug(c, drop_quotes=False, fallback="topic")


def strip_html(c: Column) -> Column:
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<script.*?</script>", " ")
    text = F.regexp_replace(text, r"(?is)<style.*?</style>", " ")
    return collapse(F.regexp_replace(text, r"<[^>]+>", " "))


def decode_basic_entities(c: Column) -> Column:
    """Three entities, ampersand first (so ``&amp;quot;`` decodes twice)."""
    text = F.replace(c, F.lit("&amp;"), F.lit("&"))
    text = F.replace(text, F.lit("&quot;"), F.lit('"'))
    return F.replace(text, F.lit("&#39;"), F.lit("'"))


def decode_entities(c: Column) -> Column:
    """Entities met in page text, ampersand last."""
    pairs = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
             ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
    for name, char in pairs:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def ellipsis(c: Column, limit: int) -> Column:
    cut = lambda body: F.concat(F.rtrim(F.substring(body, 1, limit - 3)), F.lit("..."))
    return let(collapse(c), lambda body: F.when(F.length(body) > limit, cut(body)).otherwise(body))


def strip_noise(c: Column) -> Column:
    """Drop "The post ... appeared first on ..." boilerplate."""
    # the word boundary is looked up behind the literal, which most places lack
    pattern = rf"(?is)The post(?<!{_W}The post){SPACE}+.+?{SPACE}+appeared first on{SPACE}+[^.?!]+[.?!]?"
    return collapse(F.regexp_replace(F.coalesce(c, F.lit("")), pattern, " "))


def clean_title(c: Column) -> Column:
    text = F.regexp_replace(strip_noise(c), js_pattern(r"(?i)^rt\s+"), "")
    return collapse(F.regexp_replace(text, rf"(?i){SPACE}*{URL_TOKEN}", ""))


def source_headline(c: Column) -> Column:
    """Headline without its trailing " - Publisher"."""
    return collapse(F.regexp_replace(F.coalesce(c, F.lit("")), rf"-(?<={SPACE}-){SPACE}+[^-]+$", ""))


def spoken_fillers(c: Column) -> Column:
    text = strip_noise(c)
    for pattern in (r"(?i)^So,\s*", r"(?i)^Okay,\s*", r"(?i)^Now,\s*now\s*", r"(?i)\bbeautiful\b\.?", r"(?i)\bhere\b"):
        text = F.regexp_replace(text, js_pattern(pattern), "")
    return collapse(text)


def content_words(c: Column, stop: Sequence[str] = tuple(rules.STOP_WORDS)) -> Column:
    text = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("&"), F.lit(" and "))
    return F.filter(F.split(text, "[^a-z0-9]+"), lambda w: (F.length(w) > 2) & ~w.isin(*stop))


def search_tokens(c: Column) -> Column:
    """Runs of at least three token characters. They are taken out rather than split at the rest: a negated class
    of ranges and single characters is some twenty times as dear for the JVM."""
    text = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), URL_TOKEN, " ")
    return F.regexp_extract_all(text, F.lit(r"[a-z0-9+#.\-]{3,}"), F.lit(0))


def relevance_keywords(c: Column) -> Column:
    text = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), URL_TOKEN, " ")
    # a run of letters, digits and hyphens without its outer hyphens
    terms = F.regexp_extract_all(text, F.lit("[a-z0-9][a-z0-9-]{2,}[a-z0-9]"), F.lit(0))
    return F.filter(F.array_distinct(terms), lambda w: ~w.isin(*rules.RELEVANCE_STOP_WORDS))


def grounding_terms(c: Column) -> Column:
    """Distinct content words over 3 characters among the first 120."""
    words = F.filter(content_words(c), lambda w: (F.length(w) > 3) & ~w.isin(*rules.GENERIC_GROUNDING_WORDS))
    return F.array_distinct(F.slice(words, 1, 120))


def alnum_key(c: Column, limit: int) -> Column:
    """Lower-cased alphanumeric words, cut to ``limit`` characters.

    The words of a text's beginning are the beginning of its words, so the
    rest is read only where the beginning gives too few characters.
    """
    plain = lambda x: F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))
    cut = lambda x: let(plain(F.substring(x, 1, 4 * limit)), lambda k: F.when(F.length(k) >= limit, k).otherwise(plain(x)))
    return F.substring(let(F.coalesce(c, F.lit("")), cut), 1, limit)


def fingerprint(c: Column) -> Column:
    return alnum_key(c, 180)


def block_key(c: Column) -> Column:
    text = F.lower(F.coalesce(c, F.lit("")))
    text = F.regexp_replace(text, r"\]\((https?://[^)]+)\)", "]")
    return alnum_key(F.regexp_replace(text, URL_TOKEN, " "), 240)


def content_key(c: Column) -> Column:
    """First 42 words over 2 characters; empty below 8 words.

    A beginning cuts off no word but its last, so the rest of a text is read
    only where its beginning has no more than 42 such words.
    """
    def words(x: Column) -> Column:
        text = F.regexp_replace(F.lower(collapse(x)), URL_TOKEN, " ")
        text = F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))
        return F.filter(F.split(text, " +"), lambda w: F.length(w) > 2)

    found = let(c, lambda x: let(words(F.substring(x, 1, 1000)), lambda w: F.when(F.size(w) > 42, w).otherwise(words(x))))
    return let(found, lambda w: F.when(F.size(w) < 8, F.lit("")).otherwise(F.array_join(F.slice(w, 1, 42), " ")))


def reader_text(c: Column) -> Column:
    """Internal ids and jargon rewritten for readers; rules apply in order."""
    steps = [
        (rf"(?i){URL_TOKEN}", " "),
        (r"(?i)\b(?:claim|topic|community|source-doc):[a-z0-9_.:-]+", " "),
        (r"(?i)\bknowledge graph\b", "source corpus"),
        (r"(?i)\bgraph\b", "source corpus"),
        (r"(?i)\bnode\b", "source"),
        (r"(?i)\bneighborhood\b", "topic area"),
        (r"(?i)\btraversal\b", "research"),
        (r"([a-z])([A-Z])", "$1 $2"),
        (r"\.([A-Z])", ". $1"),
        (r"\bOpen AI\b", "OpenAI"),
        (r"\bGit Hub\b", "GitHub"),
        (r"\bDeep Mind\b", "DeepMind"),
        (r"\bx AI\b", "xAI"),
    ]
    text = F.coalesce(c, F.lit(""))
    for pattern, replacement in steps:
        text = F.regexp_replace(text, js_pattern(pattern), replacement)
    return collapse(text)


def development_text(c: Column) -> Column:
    text = collapse(F.regexp_replace(reader_text(c), rf"{SPACE}+[-|]{SPACE}+[^-|]{{2,40}}$", ""))
    head = F.substring(text, 1, 1)
    rest = F.substring(text, 2, 2**30)
    return F.when(head.rlike("^[a-z]"), F.concat(F.upper(head), rest)).otherwise(text)


def excerpt(html: Column) -> Column:
    return let(reader_text(strip_html(html)), lambda body: F.when(F.length(body) < 120, F.lit("")).otherwise(ellipsis(body, 800)))


def _acronym_map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def title_case(c: Column) -> Column:
    """Upper-case every word start; a whole-string acronym wins."""
    pieces = F.split(c, rf"(?={BOUNDARY}[a-z])")
    cased = F.array_join(
        F.transform(pieces, lambda w: F.when(w.rlike("^[a-z]"), F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2**30))).otherwise(w)),
        "",
    )
    return F.coalesce(F.element_at(_acronym_map(rules.TITLE_ACRONYMS), F.lower(c)), cased)


def topic_title(c: Column) -> Column:
    """Upper-case the first letter of every blank-separated word."""
    first = rf"^(.*?){BOUNDARY}([a-z])(.*)$"

    def cased(w: Column) -> Column:
        up = F.concat(F.regexp_extract(w, first, 1), F.upper(F.regexp_extract(w, first, 2)), F.regexp_extract(w, first, 3))
        return F.when(w.rlike(first), up).otherwise(w)

    words = F.split(collapse(F.regexp_replace(c, "[-_]+", " ")), " ")
    acronyms = _acronym_map(rules.TOPIC_ACRONYMS)
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.element_at(acronyms, F.lower(w)), cased(w))), " ")


def word_count(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(f"{NON_SPACE}+")).cast("bigint")


def at_most_words(c: Column, n: Column) -> Column:
    """Whether a collapsed text has at most ``n`` (1 or more) words; a long text is read as far as that."""
    return F.call_function("substring_index", c, F.lit(" "), n.cast("int")) == c


def collapsed_count(c: Column) -> Column:
    """Words of a collapsed text: its blanks and one more."""
    return F.when(c == "", F.lit(0)).otherwise(F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1).cast("bigint")


def term_pattern(term: str) -> str:
    """Whole-word pattern for a literal term; blanks match blanks or hyphens."""
    special = set(".*+?^${}()|[]\\")
    body = "".join(f"\\{ch}" if ch in special else ch for ch in term.strip())
    return js_pattern(rf"(?i)\b{body.replace(' ', r'[\s-]+')}\b")


def contains_term(c: Column, term: str) -> Column:
    # a plain substring test first: most texts lack most terms, and the
    # pattern is far dearer than the search for its first word
    text = F.coalesce(c, F.lit(""))
    return F.contains(F.lower(text), F.lit(term.strip().lower().split(" ")[0])) & text.rlike(term_pattern(term))


def term_hits(c: Column, terms: Sequence[str]) -> Column:
    """Number of distinct terms that occur as whole words."""
    unique = list(dict.fromkeys(t.lower() for t in terms))
    return sum((contains_term(c, t).cast("bigint") for t in unique), F.lit(0).cast("bigint"))


def known_entities(c: Column, dictionary: Sequence[tuple[str, str]] = tuple(rules.KNOWN_ENTITIES)) -> Column:
    """Labels whose needle occurs in the lower-cased text, dictionary order."""
    pairs = F.array(*[F.struct(F.lit(n).alias("needle"), F.lit(lab).alias("label")) for n, lab in dictionary])
    return let(F.lower(c), lambda low: F.transform(F.filter(pairs, lambda e: F.contains(low, e.needle)), lambda e: e.label))


def entity_candidates(c: Column) -> Column:
    """Runs of one to four capitalised words, in text order with repeats."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), URL_TOKEN, " ")
    # the labels are looked for as plain text first, and by their first character: most texts have none
    label = rf"(?=[ACP#]){BOUNDARY}(?:Article URL|Comments URL|Points|# Comments):"
    has = lambda t: F.contains(t, F.lit(" URL:")) | F.contains(t, F.lit("Points:")) | F.contains(t, F.lit("# Comments:"))
    text = let(text, lambda t: F.when(has(t), F.regexp_replace(t, label, " ")).otherwise(t))
    run = rf"(?=[A-Z])(?<!{_W})((?:[A-Z][A-Za-z0-9+.\-]*(?:{SPACE}+[A-Z][A-Za-z0-9+.\-]*){{0,3}})){BOUNDARY}"
    return F.filter(
        F.regexp_extract_all(text, F.lit(run), F.lit(1)),
        lambda m: (F.length(m) > 2) & ~m.isin(*rules.STOP_ENTITIES),
    )


def usable_evidence(value: Column, title: Column) -> Column:
    """Text that is no placeholder, no title echo and has five words."""
    return let(strip_noise(value), lambda text: (
        (text != "")
        & ~any_match(text, [rules.UNUSABLE_TEXT_PATTERN])
        & ~title_only(text, title)
        & (collapsed_count(text) >= 5)
    ))


def with_usable(df: DataFrame, value: str, title: str, out: str, stripped: bool = False) -> DataFrame:
    """Adds ``out``: ``usable_evidence`` of two columns, step by step, so
    that the cleaned texts are computed once per row. ``stripped`` tells that
    the values come from ``strip_noise``: they are cleaned again only where
    that may have laid bare more of it."""
    text = strip_noise(F.col(value))
    if stripped:
        text = F.when(contains_any(F.col(value), ["the post"]), text).otherwise(F.col(value))
    steps = df.withColumns({"_t": text, "_h": source_headline(F.col(title))})
    # around a dash of a cleaned text there can only be blanks
    echo = F.when(F.contains("_t", F.lit(" - ")), source_headline(F.col("_t"))).otherwise(F.col("_t"))
    steps = steps.withColumns({"_e": echo, "_few": at_most_words(F.col("_t"), F.lit(4)), "_low": F.lower("_t")})
    echo, head = F.col("_e"), F.col("_h")
    steps = steps.withColumns({"_short": at_most_words(echo, collapsed_count(head) + 4), "_same": fingerprint(echo) == fingerprint(head)})
    a, b = F.array_distinct(content_words(echo)), F.array_distinct(content_words(head))
    smaller = F.least(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), smaller)
    # a branch, not an "and": the word sets of long texts would be built all the same, as a common part of two terms
    echoed = (echo != "") & (head != "") & (F.col("_same") | F.when(F.col("_short"), (smaller > 0) & (shared >= 0.8)).otherwise(False))
    ok = (F.col("_t") != "") & ~F.col("_few") & ~any_match(F.col("_t"), [rules.UNUSABLE_TEXT_PATTERN], F.col("_low")) & ~echoed
    return steps.withColumn(out, ok).drop("_t", "_h", "_e", "_few", "_low", "_short", "_same")


def title_only(text: Column, title: Column) -> Column:
    def alike(a: Column, b: Column) -> Column:
        smaller = F.least(F.size(a), F.size(b))
        return (smaller > 0) & (F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), smaller) >= 0.8)

    def echoes(head: Column, echo: Column) -> Column:
        words = lambda c: F.array_distinct(content_words(c))
        overlap = let(words(echo), lambda a: let(words(head), lambda b: alike(a, b)))
        # the length test is a branch: long texts never reach the word sets
        short = collapsed_count(echo) <= collapsed_count(head) + 4
        return (echo != "") & (head != "") & ((fingerprint(echo) == fingerprint(head)) | F.when(short, overlap).otherwise(False))

    return let(source_headline(title), lambda head: let(source_headline(text), lambda echo: echoes(head, echo)))


def low_signal(title: Column, haystack: Column) -> Column:
    return any_match(title, [rules.LOW_SIGNAL_PATTERN]) & ~any_match(haystack, [rules.RESCUE_PATTERN])


def contains_any(c: Column, terms: Sequence[str], low: Column | None = None) -> Column:
    """Any term as a substring of the lower-cased text."""
    low = F.lower(c) if low is None else low
    out = F.lit(False)
    for term in terms:
        out = out | F.contains(low, F.lit(term))
    return out


def first_rule_tag(c: Column, table: Sequence[tuple[int, Sequence[str], str]], default: str) -> Column:
    """Tag of the first rule with a needle in the lower-cased text."""
    chain = None
    for _, needles, tag in sorted(table, key=lambda r: r[0]):
        hit = contains_any(c, needles)
        chain = F.when(hit, F.lit(tag)) if chain is None else chain.when(hit, F.lit(tag))
    return chain.otherwise(F.lit(default))


def useful_development(c: Column) -> Column:
    return (
        (F.length(c) >= 35)
        & ~any_match(c, rules.DEVELOPMENT_DENY)
        & any_match(c, [rules.DEVELOPMENT_ALLOW])
    )


def stable_hash(c: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(c, 256), 1, length)


def node_id(kind: str, c: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), slug(c))
