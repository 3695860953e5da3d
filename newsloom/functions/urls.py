"""URL expressions built from one component pattern.

``try_parse_url`` rejects unescaped non-ASCII paths that browsers accept,
so components come from a regular expression.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newsloom.functions.text import collapse

_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#\s]+)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(url: Column, index: int) -> Column:
    return F.regexp_extract(F.trim(url), _URL, index)


def is_url(url: Column) -> Column:
    return F.coalesce(F.trim(url).rlike(_URL), F.lit(False))


def is_http_url(url: Column) -> Column:
    return is_url(url) & F.lower(_part(url, 1)).isin("http", "https")


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def authority(url: Column) -> Column:
    """Lower-case host with its port, default ports dropped."""
    host = F.lower(F.regexp_replace(_part(url, 2), "^.*@", ""))
    return (
        F.when(scheme(url) == "https", F.regexp_replace(host, ":443$", ""))
        .when(scheme(url) == "http", F.regexp_replace(host, ":80$", ""))
        .otherwise(host)
    )


def hostname(url: Column) -> Column:
    return F.regexp_replace(authority(url), r":\d+$", "")


def bare_host(url: Column) -> Column:
    return F.regexp_replace(hostname(url), r"^www\.", "")


def path(url: Column) -> Column:
    """Path with non-ASCII characters percent-encoded, at least "/"."""
    raw = _part(url, 3)
    encoded = F.array_join(
        F.transform(F.split(raw, ""), lambda ch: F.when(ch.rlike(r"[^\x21-\x7e]"), F.replace(F.url_encode(ch), F.lit("+"), F.lit("%20"))).otherwise(ch)),
        "",
    )
    return F.when(raw == "", F.lit("/")).when(raw.rlike(r"[^\x21-\x7e]"), encoded).otherwise(raw)


def query_params(url: Column) -> Column:
    """Array of (key, pos, pair) in key order, equal keys in source order."""
    pairs = F.filter(F.split(_part(url, 4), "&"), lambda p: p != "")
    keyed = F.transform(
        pairs,
        lambda p, i: F.struct(
            F.substring_index(p, "=", 1).alias("key"),
            i.alias("pos"),
            F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))).alias("pair"),
        ),
    )
    return F.array_sort(keyed)


def query_param(url: Column, name: str) -> Column:
    """First value of a parameter, null when missing or empty."""
    pairs = F.filter(F.split(_part(url, 4), "&"), lambda p: F.startswith(p, F.lit(f"{name}=")))
    return F.nullif(F.regexp_replace(F.get(pairs, F.lit(0)), "^[^=]*=", ""), F.lit(""))


def _search(params: Column) -> Column:
    joined = F.array_join(F.transform(params, lambda p: p.pair), "&")
    return F.when(F.size(params) > 0, F.concat(F.lit("?"), joined)).otherwise(F.lit(""))


def canonical_uri(url: Column) -> Column:
    """No fragment, lower scheme and host, default port dropped, parameters
    in key order; null for text that is no URL."""
    out = F.concat(scheme(url), F.lit("://"), authority(url), path(url), _search(query_params(url)))
    return F.when(is_url(url), out)


TRACKING_PARAM = r"(?i)^(utm_.*|fbclid|gclid|oc)$"


def canonical_key(url: Column) -> Column:
    """Key for one resource across schemes, www, tracking and aliases."""
    host = bare_host(url)
    stem = F.regexp_replace(path(url), "/+$", "")
    status = r"(?i)/([^/]+)/status/(\d+)"
    params = F.filter(query_params(url), lambda p: ~p.key.rlike(TRACKING_PARAM))
    video = video_id_of(url)
    post = host.isin("x.com", "twitter.com") & stem.rlike(r"(?i)/status/\d+")
    named_post = F.concat(
        F.lit("x.com/"), F.lower(F.regexp_extract(stem, status, 1)), F.lit("/status/"), F.regexp_extract(stem, status, 2)
    )
    return (
        F.when(~is_url(url), F.lower(collapse(url)))
        .when(post & stem.rlike(status), named_post)
        .when(post, F.concat(host, F.lower(stem)))
        .when(video.isNotNull(), F.concat(F.lit("youtube.com/watch?v="), video))
        .otherwise(F.concat(host, F.lower(stem), _search(params)))
    )


def is_youtube_host(host: Column) -> Column:
    return (host == "youtube.com") | F.endswith(host, F.lit(".youtube.com"))


def video_id_of(url: Column) -> Column:
    """Video id of a watch, short, embed or youtu.be URL, else null."""
    host = hostname(url)
    parts = F.filter(F.split(path(url), "/"), lambda p: p != "")
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return (
        F.when(~is_url(url), F.lit(None).cast("string"))
        .when((host == "youtu.be") & (first == "shorts"), second)
        .when((host == "youtu.be") & (F.size(parts) == 1), first)
        .when(is_youtube_host(host) & first.isin("shorts", "embed"), second)
        .when(is_youtube_host(host), query_param(url, "v"))
    )


def video_id_from_input(value: Column) -> Column:
    """Video id from a bare 11-character id or one of the URL forms."""
    text = F.trim(value)
    bare = F.when(text.rlike(r"^[A-Za-z0-9_-]{11}$"), text)
    short = F.when(hostname(text) == "youtu.be", F.nullif(F.regexp_extract(path(text), "^/+([^/]+)", 1), F.lit("")))
    embed = F.nullif(F.regexp_extract(path(text), r"/(?:embed|shorts)/([A-Za-z0-9_-]{11})", 1), F.lit(""))
    return F.coalesce(bare, F.when(is_url(text), F.coalesce(short, query_param(text, "v"), embed)))


def is_post_url(url: Column) -> Column:
    return (
        is_url(url)
        & hostname(url).isin("x.com", "www.x.com", "twitter.com", "www.twitter.com")
        & path(url).rlike(r"(?i)/status/\d+")
    )


def is_video_url(url: Column) -> Column:
    known_host = hostname(url).isin("youtube.com", "www.youtube.com", "youtu.be", "m.youtube.com")
    return is_url(url) & (path(url).rlike(r"(?i)\.(mp4|webm|mov)$") | (known_host & video_id_of(url).isNotNull()))


def source_type(url: Column) -> Column:
    host = hostname(url)
    return (
        F.when(host.rlike(r"youtube\.com|youtu\.be"), F.lit("youtube"))
        .when(host.rlike(r"x\.com|twitter\.com"), F.lit("x"))
        .when(path(url).rlike(r"(?i)rss|feed|xml"), F.lit("rss"))
        .otherwise(F.lit("web"))
    )


def host_label(url: Column) -> Column:
    return F.when(is_url(url), bare_host(url)).otherwise(F.lit("Source"))


def resolve(href: Column, page_url: Column) -> Column:
    """Absolute form of a link found on a page."""
    origin = F.concat(scheme(page_url), F.lit("://"), authority(page_url))
    folder = F.regexp_replace(path(page_url), "[^/]*$", "")
    bare_page = F.concat(origin, path(page_url))
    return (
        F.when(is_url(href), href)
        .when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme(page_url), F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(origin, href))
        .when(F.startswith(href, F.lit("#")), F.concat(bare_page, href))
        .otherwise(F.concat(origin, folder, href))
    )


def profile_link(link: Column, handle: Column, mirror: str = "nitter.net", target: str = "x.com") -> Column:
    """Profile URL for a missing link; mirror hosts rewritten."""
    missing = F.coalesce(link, F.lit("")) == ""
    mirrored = F.contains(hostname(link), F.lit(mirror))
    rewritten = F.concat(
        scheme(link), F.lit(f"://{target}"), path(link),
        F.regexp_replace(F.trim(link), r"^[^?#]*", ""),
    )
    return (
        F.when(missing & handle.isNotNull(), F.concat(F.lit(f"https://{target}/"), handle))
        .when(missing, F.lit(""))
        .when(is_url(link) & mirrored, rewritten)
        .otherwise(link)
    )


def handle_name(handle: Column) -> Column:
    return F.regexp_replace(F.trim(handle), "^@", "")


def markdown_targets(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"\]\(([^)]+)\)"), F.lit(1)), lambda t: F.trim(t))
