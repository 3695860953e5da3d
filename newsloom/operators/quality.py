"""Quality rules over tables of outputs, and their scores.

A rule is a boolean column; all rules of an output are evaluated in one
pass and stacked to (output_id, rule, passed). Outputs carry ``output_id,
kind, title, description, body, citations (array of title, url, source),
allowed_urls, relevance_text, summary, sections``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsloom import rules
from newsloom.functions import text as tx, urls as ux
from newsloom.operators.ledger import first_per_key


def rubric(spark: SparkSession) -> DataFrame:
    """Rule weights and required flags (eleven rows)."""
    return spark.createDataFrame(rules.RUBRIC, "rule string, weight double, required boolean")


def term_table(spark: SparkSession, tables: dict[str, Sequence[str]]) -> DataFrame:
    """Term lists as a small (list, term) table."""
    rows = [(name, term) for name, terms in tables.items() for term in terms]
    return spark.createDataFrame(rows, "list string, term string")


def reader_text() -> Column:
    return F.concat_ws("\n", tx.non_empty(F.col("title")), tx.non_empty(F.col("description")), tx.non_empty(F.col("body")))


def flatten_output(dek: Column, sections: Column, takeaways: Column) -> Column:
    """Reader-facing text of a brief: dek, headings with their paragraphs,
    takeaways; blanks dropped."""
    parts = F.concat(F.array(dek), F.flatten(F.transform(sections, lambda s: F.concat(F.array(s.heading), s.paragraphs))), takeaways)
    return F.array_join(F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != ""), "\n")


def stack(outputs: DataFrame, checks: dict[str, Column], key: str = "output_id") -> DataFrame:
    """(key, rule, passed) rows of the given rule columns."""
    cells = F.array(*[F.struct(F.lit(name).alias("rule"), F.coalesce(c, F.lit(False)).alias("passed")) for name, c in checks.items()])
    return outputs.select(key, F.explode(cells).alias("r")).select(key, "r.rule", "r.passed")


def output_checks(article_voice: dict = rules.VOICE_PROFILES["journalist"], wiki_voice: dict = rules.VOICE_PROFILES["wiki"]) -> dict[str, Column]:
    """The eleven rubric rules as columns over outputs."""
    article = F.col("kind") == "article"
    cites, text = F.col("citations"), F.col("reader_text")
    urls = F.transform(cites, lambda c: c.url)
    targets = ux.markdown_targets(F.coalesce("body", F.lit("")))
    section_urls = F.flatten(F.transform(F.col("sections"), lambda s: s.citation_urls))
    every_url = F.concat(F.filter(urls, lambda u: u.isNotNull()), targets, section_urls)
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    expected, present = tx.relevance_keywords(F.col("relevance_text")), tx.relevance_keywords(text)
    needed = F.greatest(F.lit(1), F.least(F.lit(3), F.ceil(F.size(expected) * 0.2)))
    hard = list(dict.fromkeys([*article_voice["prefer"], *rules.HARD_SCIENCE_TERMS]))
    plain = list(dict.fromkeys([*wiki_voice["prefer"], *rules.WIKI_REFERENCE_TERMS]))
    speculative = tx.any_match(text, [r"\b(applied opportunities|applied opportunitie|speculative|could|might|may|opportunity)\b"])  # plain words are looked for as such
    unlabelled = article & tx.any_match(text, ["Applied Opportunities"]) & ~tx.any_match(text, ["Speculative applied opportunity"])
    body = F.coalesce("body", text)
    covered = F.when(article, F.forall(targets, lambda u: ux.is_http_url(u) & F.array_contains(urls, u))).otherwise(
        F.forall(F.col("sections"), lambda s: F.size(s.citation_urls) > 0))
    return {
        "citation-coverage": (F.size(cites) > 0) & covered,
        "citation-richness": F.forall(cites, lambda c: ~blank(c.title) & ~blank(c.url) & ~blank(c.source)),
        "link-health": F.forall(every_url, ux.is_http_url),
        "grounding": (F.size("allowed_urls") == 0) | F.forall(every_url, lambda u: ~ux.is_http_url(u) | F.array_contains(F.col("allowed_urls"), u)),
        "relevance": (F.size(expected) == 0) | (F.size(F.array_intersect(expected, present)) >= needed),
        "speculation-boundary": ~speculative | (~unlabelled & ~tx.any_match(text, ["speculation as fact|will definitely|guaranteed to"])),
        "reader-facing-language": ~tx.any_match(text, rules.INTERNAL_LANGUAGE_PATTERNS),
        "tone-match": F.when(article, ~tx.any_match(text, rules.WIKI_LIKE_PATTERNS) & (tx.term_hits(text, hard) >= 2)).otherwise(
            ~tx.any_match(text, rules.ARTICLE_RHETORIC_PATTERNS)),
        "word-choice": F.when(article, (tx.term_hits(text, article_voice["avoid"]) == 0) & (tx.term_hits(text, hard) >= 2)).otherwise(
            (tx.term_hits(text, wiki_voice["avoid"]) == 0) & (tx.term_hits(text, plain) >= 1)),
        "detail-level": F.when(article, (tx.word_count(body) >= 90) & (F.regexp_count(body, F.lit(r"(?m)^##\s+")) >= 2)).otherwise(
            (tx.word_count(F.col("summary")) <= 45) & F.forall(F.col("sections"), lambda s: tx.word_count(s.body) <= 30)),
        "voice-adherence": ~tx.any_match(text, rules.HYPE_PATTERNS),
    }


def evaluate(outputs: DataFrame, **voices) -> DataFrame:
    return stack(outputs.withColumn("reader_text", reader_text()), output_checks(**voices))


def scored_outputs(outputs: DataFrame, key: str = "output_id", threshold: float = rules.MIN_SCORE, weights: Sequence = tuple(rules.RUBRIC), **voices) -> DataFrame:
    """Weighted score and verdict per output in one projection: outputs are
    one row each, so their rules need no explode and no shuffle."""
    checks = output_checks(**voices)
    marked = outputs.withColumn("reader_text", reader_text()).select(key, *[F.coalesce(checks[name], F.lit(False)).alias(f"_{i}") for i, (name, _, _) in enumerate(weights)])
    cell = lambda i: F.col(f"_{i}")
    won = sum((F.when(cell(i), F.lit(float(w))).otherwise(0.0) for i, (_, w, _) in enumerate(weights)), F.lit(0.0))
    count = lambda flags: sum((c.cast("bigint") for c in flags), F.lit(0).cast("bigint"))
    whole = float(sum(w for _, w, _ in weights))
    rows = marked.select(key, (won / F.lit(whole) if whole else F.lit(1.0)).alias("_share"),
                         count(~cell(i) for i, (_, _, required) in enumerate(weights) if required).alias("required_failures"), count(~cell(i) for i in range(len(weights))).alias("failures"))
    passed = (F.round("_share", 9) >= threshold) & (F.col("required_failures") == 0)
    return rows.select(key, F.round("_share", 4).alias("score"), F.when(passed, "pass").otherwise("fail").alias("verdict"), "required_failures", "failures")


def live_links(links: DataFrame, probes: DataFrame, key: str) -> DataFrame:
    """Links whose probe (``url, http_status``) is missing or failed."""
    return links.join(probes, "url", "left").filter(~F.coalesce(F.col("http_status").between(200, 299), F.lit(False))).select(key, "url", "http_status")


def outside_links(links: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Distinct http links outside the allowed set of their owner; owners
    without an allowed set pass."""
    web = links.filter(F.col("url").rlike("^https?://")).select(key, "url").distinct()
    return web.join(allowed.select(key).distinct(), key, "left_semi").join(allowed, [key, "url"], "left_anti")


def score(rule_rows: DataFrame, weights: DataFrame, key: str = "output_id", threshold: float = rules.MIN_SCORE) -> DataFrame:
    """Weighted score and verdict per output; ``weights`` is the eleven-row
    rubric, broadcast."""
    joined = rule_rows.join(F.broadcast(weights), "rule")
    total = joined.groupBy(key).agg(
        F.sum(F.when(F.col("passed"), F.col("weight")).otherwise(0.0)).alias("_won"), F.sum("weight").alias("_all"),
        F.count_if(F.col("required") & ~F.col("passed")).alias("required_failures"), F.count_if(~F.col("passed")).alias("failures"))
    value = F.round(F.when(F.col("_all") == 0, 1.0).otherwise(F.col("_won") / F.col("_all")), 4)
    passed = (F.round(F.col("_won") / F.col("_all"), 9) >= threshold) & (F.col("required_failures") == 0)
    return total.select(key, value.alias("score"), F.when(passed, "pass").otherwise("fail").alias("verdict"), "required_failures", "failures")


FINDINGS = ("assertions", "feedback", "required_fixes")


def combine_reports(reports: DataFrame, key: str = "output_id", threshold: float = rules.MIN_SCORE) -> DataFrame:
    """Mean of clamped evaluator scores, merged counts and merged findings.
    ``reports`` has ``score, required_failures``; a null score counts as 0.
    Findings are the array columns of FINDINGS that it has, put one after
    another by its ``position``."""
    clamped = F.least(F.greatest(F.coalesce(F.nanvl("score", F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return reports.groupBy(key).agg(
        F.round(F.avg(clamped), 4).alias("score"), F.count("*").alias("n_reports"), F.sum("required_failures").alias("required_failures"),
        *[F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("position", F.col(c).alias("found"))).cast(f"array<struct<position:int,found:array<string>>>")), lambda r: F.coalesce(r.found, F.array().cast("array<string>")))).alias(c)
          for c in FINDINGS if c in reports.columns]
    ).withColumn("verdict", F.when(F.col("score") >= threshold, "pass").otherwise("fail"))


def skipped_report(outputs: DataFrame, key: str = "output_id") -> DataFrame:
    """Report of outputs whose evaluation is switched off."""
    return outputs.select(key, F.lit(1.0).alias("score"), F.lit("pass").alias("verdict"), F.lit(0).alias("required_failures"))


Evaluator = Callable[[DataFrame], DataFrame]


def run_evaluators(outputs: DataFrame, evaluators: dict[str, Evaluator]) -> DataFrame:
    """Mean over custom evaluators, each from outputs to ``output_id,
    score, required_failures`` and any of FINDINGS, arrays of strings."""
    merged = None
    for position, (name, fn) in enumerate(evaluators.items()):
        report = fn(outputs)
        part = report.select("output_id", F.col("score").cast("double").alias("score"), F.col("required_failures").cast("bigint").alias("required_failures"), *[c for c in FINDINGS if c in report.columns]).withColumns(
            {"evaluator": F.lit(name), "position": F.lit(position)})
        merged = part if merged is None else merged.unionByName(part, allowMissingColumns=True)
    return combine_reports(merged)


def best_attempts(attempts: DataFrame, key: str, threshold: float = rules.MIN_SCORE) -> DataFrame:
    """First passing attempt per output, else the highest score, earliest
    on ties. ``attempts`` has ``attempt, score, verdict, required_failures``."""
    passed = (F.col("score") >= threshold) & (F.col("verdict") != "fail") & (F.col("required_failures") == 0)
    graded = attempts.withColumn("passed", passed)
    order = [F.desc("passed"), F.when(F.col("passed"), F.col("attempt")), F.desc("score"), "attempt"]
    best = first_per_key(graded, [key], order)
    return best.withColumn("eval_status", F.when(F.col("passed"), "passed").otherwise("best_effort"))


def with_brief_parts(briefs: DataFrame) -> DataFrame:
    """What several brief rules read, computed once per row."""
    return briefs.withColumns({
        "_joined": F.array_join("paragraphs", " "), "_title_words": F.array_distinct(tx.content_words(F.col("title"))),
        "_source_marks": F.transform(F.col("source_titles"), tx.fingerprint),
        "_wanted": tx.grounding_terms(F.col("source_evidence")), "_used": tx.grounding_terms(F.col("text"))})


def brief_results(briefs: DataFrame, terms: Sequence[str] = tuple(rules.BRIEF_DETAIL_TERMS), key: str = "output_id") -> DataFrame:
    """(key, rule, passed) of the nine brief rules."""
    return stack(with_brief_parts(briefs), brief_checks(terms), key)


def brief_checks(terms: Sequence[str] = tuple(rules.BRIEF_DETAIL_TERMS)) -> dict[str, Column]:
    """The nine brief rules as columns over briefs with ``title,
    paragraphs, headings, source_titles`` (arrays), ``text,
    source_evidence``, after ``with_brief_parts``."""
    paragraphs, joined = F.col("paragraphs"), F.col("_joined")
    title_words, source_marks = F.col("_title_words"), F.col("_source_marks")

    def echo(p: Column) -> Column:
        words = tx.content_words(p)
        shared = F.size(F.filter(words, lambda w: F.array_contains(title_words, w)))
        floor = F.greatest(F.lit(1), F.least(F.size(words), F.greatest(F.lit(1), F.size(title_words))))
        return (
            (F.size(words) < 18) | ((F.size(words) < 40) & (shared / floor >= 0.75))
            | F.array_contains(source_marks, tx.fingerprint(F.regexp_replace(p, r"^[^:]{3,80}:\s*", "")))
        )

    copied = F.exists(F.transform(F.col("source_titles"), tx.source_headline), lambda h: (F.length(h) > 28) & F.contains(F.lower(joined), F.lower(h)))
    wanted, used = F.col("_wanted"), F.col("_used")
    minimum = F.least(F.lit(4), F.greatest(F.lit(2), F.ceil(F.size(wanted) * 0.2)))
    return {
        "word-count": tx.word_count(joined) >= 120, "section-count": F.size("headings") >= 2,
        "no-title-echo": ~F.exists(paragraphs, echo),
        "no-template-heading": ~F.exists(F.col("headings"), lambda h: h.rlike("(?i)" + rules.TEMPLATE_HEADING_PATTERN)),
        "detail-terms": tx.term_hits(joined, terms) >= 2, "no-copied-headline": ~copied,
        "no-meta-language": ~tx.any_match(F.col("text"), rules.META_PATTERNS),
        "usable-evidence": F.size(wanted) > 0, "grounded": (F.size(wanted) == 0) | (F.size(F.array_intersect(wanted, used)) >= minimum),
    }


def brief_verdict(rule_rows: DataFrame, rubric_scores: DataFrame, key: str = "output_id", threshold: float = rules.MIN_SCORE) -> DataFrame:
    """min(mean of all rules, rubric score); a pass needs every brief rule
    and a passing rubric. ``rubric_scores`` has ``score, verdict,
    failures``; eleven rubric rules join the brief rules in the mean."""
    own = rule_rows.groupBy(key).agg(F.count("*").alias("_n"), F.count_if("passed").alias("_p"))
    n_rubric = len(rules.RUBRIC)
    both = own.join(rubric_scores, key)
    mean = (F.col("_p") + n_rubric - F.col("failures")) / (F.col("_n") + n_rubric)
    ok = (mean >= threshold) & (F.col("verdict") != "fail") & (F.col("_p") == F.col("_n"))
    return both.select(key, F.round(F.least(mean, F.col("score")), 4).alias("score"), F.when(ok, "pass").otherwise("fail").alias("verdict"))


def publish_quota(candidates: DataFrame, limit: int, group: str = "day", order: Sequence = ("rank",)) -> DataFrame:
    """Passing candidates in rank order until the quota of their day."""
    from newsloom.operators.ledger import top_per_key

    return top_per_key(candidates.filter(F.col("passed")), [group], list(order), limit, "place")


def publish_guard(days: DataFrame, allow_empty: bool = False) -> DataFrame:
    """Days that must not be published: ``day, problem``. ``days`` has
    ``source_items, n_rows``."""
    if allow_empty:
        return days.limit(0).select("day", F.lit("").alias("problem"))
    problem = F.when(F.coalesce("source_items", F.lit(0)) <= 0, "no source items").when(F.coalesce("n_rows", F.lit(0)) <= 0, "no rows")
    return days.select("day", problem.alias("problem")).filter(F.col("problem").isNotNull())


def navigation_problems(stubs: DataFrame) -> DataFrame:
    """(day, slug, problem) of stubs with ``day, slug, title, href``."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    expected = F.concat(F.lit("/daily/"), F.col("day").cast("string"), F.lit("/"), "slug", F.lit("/"))
    single = F.when(blank("slug"), "missing slug").when(blank("title"), "missing title").when(F.coalesce("href", F.lit("")) != expected, "unexpected href")
    rowwise = stubs.select("day", "slug", single.alias("problem")).filter(F.col("problem").isNotNull())
    repeated = stubs.filter(~blank("slug")).groupBy("day", "slug").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("day", "slug", F.lit("duplicate slug").alias("problem"))
    return rowwise.unionByName(repeated)


FORBIDDEN_FIELDS = ("transcript", "transcriptText")


def artifact_problems(artifacts: DataFrame, index_days: DataFrame, expected: str, fields: Sequence[str] = FORBIDDEN_FIELDS) -> DataFrame:
    """(artifact_id, problem) of artifacts with ``day, payload`` (JSON
    text): wrong day, a forbidden field at any depth, day not indexed."""
    field = "|".join(fields)
    wrong = artifacts.filter(F.coalesce("day", F.lit("")) != expected).select("artifact_id", F.lit("unexpected day").alias("problem"))
    raw = artifacts.filter(F.col("payload").rlike(rf'"(?:{field})"\s*:')).select("artifact_id", F.lit("forbidden field").alias("problem"))
    missing = artifacts.join(index_days.select("day").distinct(), "day", "left_anti").select("artifact_id", F.lit("day not indexed").alias("problem"))
    return wrong.unionByName(raw).unionByName(missing)


def content_shape() -> dict[str, Column]:
    """Minimum lengths and counts of brief content with ``dek, sections
    (heading, paragraphs, citations), takeaways``."""
    s = F.col("sections")
    return {
        "dek-length": F.length("dek") >= 48, "section-count": F.size(s) >= 2,
        "heading-length": F.forall(s, lambda x: F.length(x.heading) >= 8),
        "paragraphs": F.forall(s, lambda x: (F.size(x.paragraphs) >= 1) & F.forall(x.paragraphs, lambda p: F.length(p) >= 70)),
        "section-citations": F.forall(s, lambda x: (F.size(x.citations) >= 1) & F.forall(x.citations, ux.is_url)),
        "takeaways": (F.size("takeaways") >= 2) & F.forall(F.col("takeaways"), lambda p: F.length(p) >= 45),
    }


def page_shape() -> dict[str, Column]:
    """Topic page constraints: non-empty texts, a citation, reader language."""
    filled = lambda c: F.length(F.coalesce(c, F.lit(""))) > 0
    text = F.concat_ws(" ", "title", "dek", "summary")
    return {
        "texts": filled(F.col("slug")) & filled(F.col("title")) & filled(F.col("dek")) & filled(F.col("summary")),
        "citations": F.size("citations") >= 1, "reader-language": ~tx.any_match(text, rules.INTERNAL_LANGUAGE_PATTERNS),
    }


def opportunity_shape(o: Column) -> Column:
    """Label, confidence range and texts of one applied opportunity."""
    return (o.speculation_label == "Speculative applied opportunity") & o.confidence.between(0, 1) & o.title.isNotNull()


def restrict_citations(cited: Column, sources: Column) -> Column:
    """Cited URLs among the sources, else the first source."""
    kept = F.filter(cited, lambda u: F.array_contains(sources, u))
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(sources, 1, 1))
