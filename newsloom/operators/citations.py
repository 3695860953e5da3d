"""Citation previews and social post parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.functions import text as tx, urls as ux

_RETWEET_TITLE = tx.js_pattern(r"(?i)^RT\s+([^:]+):\s*(.*)$")
_RETWEET_TEXT = tx.js_pattern(r"^[Rr][Tt]\s+`?(@?[A-Za-z0-9_.\-]{2,40}?)(?:`?:\s*|`?\s+|(?<=[a-z])(?=[A-Z]))(.+)$")


def post_text(c: Column) -> Column:
    """Post text with glued punctuation, mentions and tags set apart."""
    text = tx.collapse(c)
    for pattern, replacement in (
        (r"([!?])(\.)", "$1 $2"), (r"([a-z0-9)]\.)([A-Z@#])", "$1 $2"), (r"([!?])([A-Za-z@#])", "$1 $2"),
        (r"([a-z0-9)])(@|#)", "$1 $2"), (r"\s+([.!?,:;])", "$1"),
    ):
        text = F.regexp_replace(text, tx.js_pattern(pattern), replacement)
    return F.trim(text)


def with_post_parts(df: DataFrame, title: str = "title", summary: str = "summary") -> DataFrame:
    """Adds ``post_kind, original_author, post_text, quoted_url,
    quoted_title``."""
    head = tx.collapse(F.col(title))
    raw = F.coalesce(tx.non_empty(tx.collapse(F.col(summary))), head)
    # computed columns are materialised step by step so that no pattern is
    # evaluated twice
    df = df.withColumns({"_head": head, "_raw": raw}).withColumn("_clean", post_text(F.col("_raw")))
    author = F.coalesce(
        tx.non_empty(F.regexp_extract("_head", _RETWEET_TITLE, 1)),
        F.when(~F.col("_head").rlike(_RETWEET_TITLE), tx.non_empty(F.regexp_extract("_clean", _RETWEET_TEXT, 1))),
    )
    author = F.regexp_replace(F.regexp_replace(tx.collapse(author), "^`|`$", ""), "^@", "")
    retweet = F.col("_head").rlike(_RETWEET_TITLE) | F.col("_clean").rlike(_RETWEET_TEXT)
    df = df.withColumn("original_author", F.when(retweet, author))
    parts = F.transform(
        F.filter(F.split(F.col("original_author"), tx.SPACE + "+"), lambda p: p != ""),
        lambda p: F.regexp_replace(p, r"([.*+?^${}()|\[\]\\])", r"\\$1"),
    )
    prefix = F.concat(F.lit(r"(?i)^RT\s+`?@?"), F.array_join(parts, r"\s*"), F.lit(r"`?:?\s*"))
    df = df.withColumn(
        "_main", F.when(F.col("original_author").isNotNull(), post_text(F.regexp_replace(F.col("_raw"), prefix, F.lit("")))).otherwise(F.col("_clean"))
    )
    found = F.regexp_replace(F.regexp_extract("_main", rf"(?i){tx.URL_TOKEN}", 0), r"[),.;]+$", "")
    label_cut = F.regexp_extract(found, r"^(https?://.*?)(?=[A-Z][A-Za-z0-9 ._\-]{1,80}:)", 1)
    df = df.withColumn("_token", F.coalesce(tx.non_empty(label_cut), tx.non_empty(found)))
    token = F.col("_token")
    post = F.concat(ux.scheme(token), F.lit("://"), ux.authority(token), ux.path(token))
    quoted = F.when(ux.is_post_url(token), post).otherwise(F.regexp_replace(token, "[?&]$", ""))
    main = F.when(token.isNotNull(), F.expr("substring_index(_main, _token, 1)")).otherwise(F.col("_main"))
    tail = F.when(token.isNotNull(), F.expr("substring_index(substring(_main, locate(_token, _main) + length(_token)), _token, 1)")).otherwise(F.lit(""))
    text = F.regexp_replace(post_text(F.coalesce(tx.non_empty(main), F.col("_main"))), tx.js_pattern(r"(?i)\bRead more(?: here)?\s*:?\s*$"), "")
    named = F.regexp_replace(post_text(tail), tx.js_pattern(r"^(?::|[\s-])+"), "")
    named = F.when(named.rlike(r"^[?&]?[A-Za-z0-9_]+="), F.lit("")).otherwise(named)
    df = df.withColumns({
        "quoted_url": quoted,
        "quoted_title": F.nullif(tx.ellipsis(named, 180), F.lit("")),
        "post_text": tx.ellipsis(text, 280),
    })
    kind = F.when(tx.non_empty(F.col("original_author")).isNotNull(), "retweet").when(F.col("quoted_url").isNotNull(), "quote").otherwise("post")
    return df.withColumn("post_kind", kind).drop("_head", "_raw", "_clean", "_main", "_token")


def previews(citations: DataFrame) -> DataFrame:
    """Link-card columns of citations (``title, url, source_name,
    summary``). Adds the post parts for social links only."""
    url = F.coalesce("url", F.lit(""))
    kind = F.when(ux.is_post_url(url), "tweet").when(ux.is_video_url(url), "video").otherwise("source")
    shaped = citations.withColumns({
        "kind": kind, "_title": F.coalesce(tx.non_empty(tx.collapse(F.col("title"))), url), "_summary": tx.collapse(F.col("summary")),
    })
    parted = with_post_parts(shaped, "_title", "_summary")
    social = F.col("kind") == "tweet"
    for name in ("post_kind", "original_author", "post_text", "quoted_url", "quoted_title"):
        parted = parted.withColumn(name, F.when(social, F.col(name)))
    label = (
        F.when(social & (F.col("post_kind") == "retweet"), "Retweet").when(social & (F.col("post_kind") == "quote"), "Quote")
        .when(social, "X post").when(F.col("kind") == "video", "Video").otherwise("Source")
    )
    title = F.when(
        F.col("post_kind") == "retweet",
        F.concat("original_author", F.lit(": "), F.coalesce(tx.non_empty(F.col("post_text")), F.regexp_replace(post_text(F.col("_title")), tx.js_pattern(r"(?i)^RT\s+"), ""))),
    ).otherwise(F.col("_title"))
    snippet = F.coalesce(tx.non_empty(F.col("post_text")), tx.non_empty(F.col("_summary")), F.when(social, F.col("_title")), F.lit(""))
    video = ux.video_id_of(url)
    return parted.withColumns({
        "label": label, "preview_title": tx.ellipsis(title, 140), "host": ux.host_label(url),
        "source": F.coalesce(tx.non_empty(tx.collapse(F.col("source_name"))), ux.host_label(url)),
        "snippet": tx.ellipsis(snippet, 220),
        "thumbnail_url": F.concat(F.lit("https://i.ytimg.com/vi/"), video, F.lit("/hqdefault.jpg")),
    }).drop("_title", "_summary")


def preview_contract(stubs: DataFrame) -> DataFrame:
    """Failures of the social preview rules, one row per (stub, rule).

    ``stubs`` has ``stub_id, text, source_text, expects_social, n_social,
    n_retweets, retweet_label, original_author, quoted_url, body_words,
    n_sections``.
    """
    from newsloom import rules

    text, usable = F.col("text"), F.trim("source_text") != ""
    shared = F.size(F.array_intersect(tx.grounding_terms(F.col("source_text")), tx.grounding_terms(text)))
    retweeted = F.col("n_retweets") > 0
    checks = {
        "raw-repost-marker": text.rlike(tx.js_pattern(r"\bRT\b")),
        "flattened-quoted-link": text.rlike(tx.js_pattern(r"(?i)Read more here:\s*https?://")),
        "instruction-language": tx.any_match(text, rules.META_PATTERNS),
        "missing-social-preview": F.col("expects_social") & (F.col("n_social") == 0),
        "missing-repost-preview": F.col("expects_social") & ~retweeted,
        "repost-label": retweeted & (F.col("retweet_label") != "Retweet"),
        "repost-author": retweeted & F.col("original_author").isNull(),
        "quoted-link": retweeted & F.col("quoted_url").isNull(),
        "body-length": usable & (F.col("body_words") < 120),
        "section-count": usable & (F.col("n_sections") < 2),
        "headline-echo": usable & text.rlike(r"(?m)^[A-Z][^\n:]{3,90}:\s*[A-Z][^\n]+$"),
        "detail-terms": usable & (tx.term_hits(text, rules.BRIEF_DETAIL_TERMS) == 0),
        "source-terms": usable & (shared < 2),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).alias("failed")) for n, c in checks.items()])
    return stubs.select("stub_id", F.explode(rows).alias("r")).filter("r.failed").select("stub_id", "r.rule")
