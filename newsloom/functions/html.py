"""Expressions over one page's HTML text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newsloom.functions import text as tx

DROPPED_BLOCKS = ["script", "style", "nav", "footer", "noscript"]
# start or end tags that close an open paragraph
_CLOSERS = (
    "article|aside|blockquote|body|div|footer|form|h[1-6]|header|hr|html|main|nav|ol|p|pre|section|table|ul"
)


def drop_blocks(html: Column, names: list[str] = DROPPED_BLOCKS) -> Column:
    for name in names:
        html = F.regexp_replace(html, rf"(?is)<{name}\b.*?(?:</{name}\s*>|$)", " ")
    return F.regexp_replace(html, r"(?s)<!--.*?-->", " ")


def visible_text(html: Column) -> Column:
    """Text of a fragment: tags out, entities decoded, tags out again."""
    return tx.strip_html(tx.decode_entities(F.regexp_replace(html, r"<[^>]+>", " ")))


def paragraphs(html: Column, min_length: int = 24) -> Column:
    """Paragraph texts in page order; unclosed paragraphs end at the next
    block tag."""
    raw = F.regexp_extract_all(
        drop_blocks(html),
        F.lit(rf"(?is)<p(?:\s[^>]*)?>(.*?)(?=</?(?:{_CLOSERS})[\s>/]|$)"),
        F.lit(1),
    )
    return F.filter(F.transform(raw, visible_text), lambda t: F.length(t) >= min_length)


def body_text(html: Column) -> Column:
    """Text of main, else article, else body, else the whole page."""
    clean = drop_blocks(html)

    def inside(tag: str) -> Column:
        return tx.non_empty(visible_text(F.regexp_extract(clean, rf"(?is)<{tag}\b[^>]*>(.*?)(?:</{tag}\s*>|$)", 1)))

    return F.coalesce(inside("main"), inside("article"), inside("body"), visible_text(clean))


def text_spans(html: Column, limit: int | None = None) -> Column:
    """Paragraphs (the first ``limit``), else the whole body text when long
    enough."""
    spans = paragraphs(html)
    whole = F.filter(F.array(body_text(html)), lambda t: F.length(t) >= 24)
    found = F.when(F.size(spans) > 0, spans).otherwise(whole)
    return found if limit is None else F.slice(found, 1, limit)


def meta_content(html: Column, attribute: str, name: str) -> Column:
    """Content of a meta tag in either attribute order, null when absent."""
    key = rf'{attribute}\s*=\s*["\']{name}["\']'
    a = F.regexp_extract(html, rf'(?is)<meta\b[^>]*?{key}[^>]*?content\s*=\s*["\']([^"\']*)["\']', 1)
    b = F.regexp_extract(html, rf'(?is)<meta\b[^>]*?content\s*=\s*["\']([^"\']*)["\'][^>]*?{key}', 1)
    return tx.decode_entities(F.coalesce(tx.non_empty(a), tx.non_empty(b)))


def page_title(html: Column) -> Column:
    title = visible_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.coalesce(meta_content(html, "property", "og:title"), tx.non_empty(title))


def attribute_values(html: Column, tag: str, attribute: str) -> Column:
    return F.regexp_extract_all(
        html, F.lit(rf'(?is)<{tag}\b[^>]*?\s{attribute}\s*=\s*["\']([^"\']*)["\']'), F.lit(1)
    )


def anchors(html: Column) -> Column:
    """(href, inner HTML) of every anchor in page order."""
    blocks = F.regexp_extract_all(html, F.lit(r'(?is)<a\b[^>]*?\shref\s*=\s*["\'][^"\']*["\'][^>]*>.*?</a\s*>'), F.lit(0))
    return F.transform(
        blocks,
        lambda b: F.struct(
            F.regexp_extract(b, r'(?is)^<a\b[^>]*?\shref\s*=\s*["\']([^"\']*)["\']', 1).alias("href"),
            F.regexp_extract(b, r"(?is)^<a\b[^>]*>(.*)</a\s*>$", 1).alias("inner"),
        ),
    )


def element_text(fragment: Column, tags: list[str]) -> Column:
    """Text of the first non-empty element among ``tags``, in tag order."""
    texts = [
        tx.non_empty(visible_text(F.regexp_extract(fragment, rf"(?is)<{t}\b[^>]*>(.*?)</{t}\s*>", 1))) for t in tags
    ]
    return F.coalesce(*texts, F.lit(""))


def classed_text(fragment: Column, needle: str) -> Column:
    """Text of the first element whose class holds ``needle``."""
    inner = F.regexp_extract(fragment, rf'(?is)<(\w+)\b[^>]*?class\s*=\s*["\'][^"\']*{needle}[^"\']*["\'][^>]*>(.*?)</\1\s*>', 2)
    return visible_text(inner)


def json_ld_url(html: Column) -> Column:
    """URL of the first WebPage entry in the page's JSON-LD, else null."""
    block = F.regexp_extract(html, r'(?is)<script[^>]*type\s*=\s*["\']application/ld\+json["\'][^>]*>(.*?)</script>', 1)
    schema = "struct<`@graph`: array<struct<`@type`: string, url: string>>>"
    graph = F.from_json(block, schema).getField("@graph")
    pages = F.filter(graph, lambda e: e.getField("@type") == "WebPage")
    return F.get(pages, F.lit(0)).getField("url")
