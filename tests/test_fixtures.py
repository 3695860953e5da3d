"""Exact semantics on small hand-written inputs."""

import json

import pytest
from pyspark.sql import functions as F

from newsloom import rules
from newsloom.functions import dates as dx, html as hx, text as tx, urls as ux
from newsloom.operators import citations as ct, dedup as dd, graph as gr, knowledge as kn, ledger as lg, pages as pg, quality as ql, retry as rt, transcripts as tr
from newsloom.sources import catalogue, feeds, graphs, rss, snapshots
from newsloom.streaming.stateful import backoff_minutes


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("url, key", [
    ("https://www.Example.com/Path/?utm_source=x&b=2&a=1", "example.com/path?a=1&b=2"),
    ("https://twitter.com/User/status/123?s=20", "x.com/user/status/123"),
    ("https://youtu.be/abcdefghijk", "youtube.com/watch?v=abcdefghijk"),
    ("https://m.youtube.com/shorts/abcdefghijk", "youtube.com/watch?v=abcdefghijk"),
    ("Not a  URL", "not a url"),
])
def test_canonical_key(spark, url, key):
    assert value(spark, ux.canonical_key(F.lit(url))) == key


def test_canonical_uri(spark):
    assert value(spark, ux.canonical_uri(F.lit("HTTPS://Example.COM:443/für?b=2&a=1#frag"))) == "https://example.com/f%C3%BCr?a=1&b=2"
    assert value(spark, ux.canonical_uri(F.lit("nonsense"))) is None


@pytest.mark.parametrize("raw, want", [
    ("dQw4w9WgXcQ", "dQw4w9WgXcQ"), ("https://youtu.be/dQw4w9WgXcQ?t=3", "dQw4w9WgXcQ"),
    ("https://www.youtube.com/watch?v=dQw4w9WgXcQ", "dQw4w9WgXcQ"), ("https://www.youtube.com/embed/dQw4w9WgXcQ", "dQw4w9WgXcQ"), ("plain text", None),
])
def test_video_id(spark, raw, want):
    assert value(spark, ux.video_id_from_input(F.lit(raw))) == want


def test_url_classes(spark):
    assert value(spark, ux.is_post_url(F.lit("https://x.com/a/status/1"))) is True
    assert value(spark, ux.is_post_url(F.lit("https://x.com/a"))) is False
    assert value(spark, ux.is_video_url(F.lit("https://cdn.example/a.MP4"))) is True
    assert value(spark, ux.profile_link(F.lit("https://nitter.net/openai/status/1#m"), F.lit("openai"))) == "https://x.com/openai/status/1#m"


def test_slug_and_titles(spark):
    assert value(spark, tx.slug(F.lit("  It's A \"Test\" -- Case! "))) == "its-a-test-case"
    assert value(spark, tx.topic_slug(F.lit("!!!"))) == "topic"
    assert value(spark, tx.title_case(F.lit("long-running agents"))) == "Long-Running Agents"
    assert value(spark, tx.title_case(F.lit("LLM"))) == "LLM"
    assert value(spark, tx.topic_title(F.lit("openai_coding-agents xai"))) == "OpenAI Coding Agents xAI"


def test_summary(spark):
    first, second = "This first sentence is certainly longer than forty characters.", "Another sentence that also passes the forty character limit!"
    assert value(spark, tx.summarize(F.lit(f"{first} Short. {second}"), 3)) == f"{first} {second}"
    assert value(spark, tx.summarize(F.lit("Short."), 3)) == "Short."
    assert value(spark, tx.summarize(F.lit("  "), 3)) == rules.NO_TEXT_PLACEHOLDER


def test_noise_and_reader_text(spark):
    assert value(spark, tx.strip_noise(F.lit("Lead. The post A big story appeared first on Example Site. Tail"))) == "Lead. Tail"
    assert value(spark, tx.source_headline(F.lit("Headline here - Publisher"))) == "Headline here"
    assert value(spark, tx.reader_text(F.lit("See topic:ai in the knowledge graph node at https://a.b/c GitHub"))) == "See in the source corpus source at GitHub"


def test_terms_match_whole_words(spark):
    assert value(spark, tx.contains_term(F.lit("a trade-off here"), "trade-off")) is True
    assert value(spark, tx.contains_term(F.lit("failure-mode analysis"), "failure mode")) is True
    assert value(spark, tx.contains_term(F.lit("nodes"), "node")) is False


def test_usable_evidence(spark):
    title = F.lit("New model ships today")
    assert value(spark, tx.usable_evidence(F.lit("Transcript unavailable for this video right now"), title)) is False
    assert value(spark, tx.usable_evidence(F.lit("New model ships today - Publisher"), title)) is False
    assert value(spark, tx.usable_evidence(F.lit("The vendor described five concrete changes"), title)) is True
    assert value(spark, tx.low_signal(F.lit("RSVP for the meetup"), F.lit("rsvp for the meetup"))) is True


def test_dates(spark):
    ok = ["2024-03-05T10:00:00.000Z", "Wed, 20 May 2026 12:00:00 GMT", "Mar 5, 2024"]
    got = [value(spark, dx.iso(dx.parse_lenient(F.lit(d)))) for d in ok]
    assert got == ["2024-03-05T10:00:00.000Z", "2026-05-20T12:00:00.000Z", "2024-03-05T00:00:00.000Z"]
    assert value(spark, dx.parse_lenient(F.lit("soon"))) is None
    assert str(value(spark, dx.local_day(F.lit("2026-05-21 03:00:00").cast("timestamp_ntz")))) == "2026-05-20"
    assert [backoff_minutes(n) for n in (1, 2, 5, 20)] == [5, 10, 80, 1440]


ITEMS = "id string, title string, summary string, url string, source_name string, kind string, tags array<string>, status string, day date"


def items(spark):
    rows = [
        ("source-1", "OpenAI and Microsoft ship agents", "OpenAI released a system. Microsoft added support. It works.", "https://a.example/1", "A", "rss", ["ai", "agents"], "ok", None),
        ("source-2", "Platform note", "The platform grew.", "https://a.example/2", "B", "rss", ["ai", "platforms"], "ok", None),
        ("source-3", "Failed", "Nothing Here", "https://a.example/3", "B", "rss", ["ai"], "error", None),
    ]
    return spark.createDataFrame(rows, ITEMS)


def test_knowledge(spark):
    ok = items(spark).filter("status = 'ok'")
    assert {r.name: r.n_evidence for r in kn.topics(kn.topic_evidence(ok)).collect()} == {"ai": 2, "agents": 1, "platforms": 1}
    found = {r.name: (r.mentions, r.n_evidence) for r in kn.entities(kn.entity_evidence(ok)).collect()}
    assert found["OpenAI"] == (2, 1) and "The" not in found
    assert ("Microsoft", "OpenAI") in {(r.left, r.right) for r in kn.co_mentions(kn.co_mention_evidence(ok)).collect()}
    assert kn.claims(ok, 2).groupBy("evidence_id").count().agg(F.max("count")).first()[0] == 2


def test_weekly_snapshot_ledger(spark, tmp_path):
    item = lambda link, day, **k: {"title": link, "link": link, "publishedAt": f"{day}T10:00:00.000Z", **k}
    youtube = {"sources": [{"id": "yt", "title": "Channel", "status": "ok", "items": [
        item("https://v.example/1", "2026-05-19", summary="plain", transcriptSummary="Transcript summary wins over the plain text here."), item("https://v.example/old", "2026-04-01")]}]}
    news = {"source": {"id": "gn", "topic": "AI", "items": [item("https://v.example/1", "2026-05-18"), item("https://n.example/2", "2026-05-20")]}}
    broken = {"aiResearch": {"id": "m", "title": "M", "status": "error", "items": [item("https://m.example/3", "2026-05-20")]}}
    for name, data in {"youtube": youtube, "googleNews": news, "metaResearch": broken}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(data, indent=1))
    found = snapshots.snapshot_items(snapshots.snapshot_sources(snapshots.read_snapshots(spark, str(tmp_path))))
    dated = found.filter(dx.within_days(dx.parse_lenient(F.col("published_at")).cast("timestamp_ntz"), "2026-05-13", "2026-05-20"))
    kept = lg.first_per_key(dated, ["url"], ["family_rank", "source_pos", "item_pos"])
    assert {(r.url, r.family) for r in kept.collect()} == {("https://v.example/1", "youtube"), ("https://n.example/2", "googleNews")}
    ledger = lg.summary_items(kept.filter("family = 'youtube'").withColumn("day", F.lit(None).cast("date")), "youtube").first()
    assert ledger.summary.startswith("Transcript summary wins") and ledger.source_name == "Channel" and ledger.tags == ["ai", "youtube"]


def test_catalogue(spark, tmp_path):
    config = {"youtube": {"dev": ["@GitHub"]}, "googleNewsTopics": ["AI agents"], "anthropicNews": {}, "vercelAnnouncements": {"limit": 7, "feeds": [{"id": "v", "title": "V", "url": "u", "rssUrl": "r"}]},
              "githubOrganizations": [{"id": "vercel-labs"}], "twitterProfiles": {"handles": ["@OpenAI"]}}
    path = tmp_path / "c.json"
    path.write_text(json.dumps(config, indent=1))
    rows = {r.id: r for r in catalogue.expand(catalogue.read_catalogue(spark, str(path)), "2026-01-01").collect()}
    assert set(rows) == {"youtube-dev-github", "google-news-ai-agents", "anthropic-news", "v", "github-vercel-labs", "twitter-openai"}
    assert rows["google-news-ai-agents"].feed_url.endswith("q=AI+agents&hl=en-US&gl=US&ceid=US%3Aen")
    assert rows["v"].item_limit == 7 and rows["anthropic-news"].item_limit == 10


def test_profile_rss(spark):
    xml = """<rss><channel><item><title>OpenAI: New model shipped</title><link>https://nitter.net/openai/status/123</link>
      <guid>https://nitter.net/openai/status/123</guid><pubDate>Wed, 20 May 2026 12:00:00 GMT</pubDate>
      <description><![CDATA[<p>New model shipped</p>]]></description></item></channel></rss>"""
    raw = rss.items_of_xml(spark.createDataFrame([(xml,)], "xml string"), "xml", 5)
    row = rss.profile_items(raw, F.lit("openai"), F.lit("@openai")).first()
    assert (row.link, row.published_at, row.summary, row.author) == ("https://x.com/openai/status/123", "2026-05-20T12:00:00.000Z", "New model shipped", "@openai")


def test_index_cards(spark):
    html = """<a href="/research/a"><h3>Short</h3></a><a href="/research/a"><h3>Longer title</h3><time>May 1, 2026</time><p>Body text</p></a>
      <a href="/research/b"><h3>Newer</h3><time>May 9, 2026</time></a><a href="/research/team/x"><h3>Team</h3></a><a href="/research"><h3>Index</h3></a>"""
    pages = spark.createDataFrame([(1, "https://site.example/research", html)], "page_id bigint, url string, html string")
    rows = feeds.index_cards(pages, "/research/", "/research", "/research/team/", 10).orderBy("rank").collect()
    assert [(r.title, r.link) for r in rows] == [("Newer", "https://site.example/research/b"), ("Longer title", "https://site.example/research/a")]


def test_page_row_and_metadata(spark):
    html = ('<meta property="og:title" content="Research | AI at Meta"><meta content="Desc" name="description"><script type="application/ld+json">'
            '{"@graph":[{"@type":"Org","url":"no"},{"@type":"WebPage","url":"https://w.example/page"}]}</script>')
    page = spark.createDataFrame([(1, "https://u.example/", html, None, None)], "page_id bigint, url string, html string, source_title string, source_url string")
    row = feeds.page_row(page, "https://default.example/").first()
    assert (row.title, row.summary, row.link) == ("Research", "Desc", "https://w.example/page")


def test_text_spans(spark):
    html = "<nav><p>navigation text that is long enough</p></nav><script>var t='</p>';</script><article><p>First paragraph long enough to keep<p>Second &amp; also long enough to keep</article>"
    spans = value(spark, hx.text_spans(F.lit(html)))
    assert spans == ["First paragraph long enough to keep", "Second & also long enough to keep"]
    assert value(spark, hx.text_spans(F.lit("<main>Only loose text of sufficient length</main>"))) == ["Only loose text of sufficient length"]


def test_page_media(spark):
    html = '<meta property="og:image" content="/card.png"><img src="a.png"><img src="https://o.example/b.png">'
    pages = spark.createDataFrame([(1, "https://s.example/dir/page", html)], "page_id bigint, url string, html string")
    assert [r.uri for r in pg.media(pages, "image", "img", "src", 8).orderBy("media_no").collect()] == [
        "https://s.example/card.png", "https://s.example/dir/a.png", "https://o.example/b.png"]


@pytest.mark.parametrize("title, summary, kind, author, text, quoted", [
    ("RT elvis: Very good paper", "RT elvisVery good paper", "retweet", "elvis", "Very good paper", None),
    ("Post", "RT @amanun: siloed notes https://x.com/a/status/1?s=20", "retweet", "amanun", "siloed notes", "https://x.com/a/status/1"),
    ("Post", "Look at this https://blog.example/post.", "quote", None, "Look at this", "https://blog.example/post"),
    ("Post", "Nothing special", "post", None, "Nothing special", None),
])
def test_social_posts(spark, title, summary, kind, author, text, quoted):
    row = ct.with_post_parts(spark.createDataFrame([(title, summary)], "title string, summary string")).first()
    assert (row.post_kind, row.original_author, row.post_text, row.quoted_url) == (kind, author, text, quoted)


def test_preview(spark):
    row = ct.previews(spark.createDataFrame([("A video", "https://www.youtube.com/watch?v=dQw4w9WgXcQ", None, "s")], "title string, url string, source_name string, summary string")).first()
    assert (row.kind, row.label, row.host, row.thumbnail_url) == ("video", "Video", "youtube.com", "https://i.ytimg.com/vi/dQw4w9WgXcQ/hqdefault.jpg")


def test_markdown_dedup(spark):
    body = "# Title\n\nSame text here\n\nsame TEXT here!\n\n- one\n- two\n- One\n\n# Title"
    row = dd.unique_blocks(spark.createDataFrame([(body,)], "b string"), "b", "out").first()
    assert row.out == "# Title\n\nSame text here\n\n- one\n- two\n\n# Title"


def test_transcripts_span_turns(spark):
    turns = spark.createDataFrame([(1, 0, "This sentence starts in one turn and"), (1, 1, "ends in the next one. Short."), (1, 2, "THIS sentence starts in one turn and ends in the next one.")], "conv_id bigint, turn bigint, text string")
    found = tr.sentences(turns)
    assert [r.sentence for r in found.orderBy("sentence_no").collect()] == [
        "This sentence starts in one turn and ends in the next one.", "Short.", "THIS sentence starts in one turn and ends in the next one."]
    assert tr.highlights(found).first().transcript_summary == "This sentence starts in one turn and ends in the next one."


def test_failures_and_resolution(spark):
    codes = [value(spark, rt.reason_code(F.lit(m))) for m in ("HTTP 404 while fetching u", "HTTP 502", "HTTP 418 teapot", "aborted", "Empty response body.", "odd")]
    assert codes == ["http_404", "http_5xx", "parse_empty_text", "timeout", "empty_body", "parse_empty_text"]
    queue = spark.createDataFrame([(1, "invalid_uri"), (2, "http_403"), (3, "parse_empty_text"), (4, "x_bridge_unavailable"), (5, "http_404")], "id bigint, reason_code string")
    probes = spark.createDataFrame([(2, 200, 10), (3, 200, 100), (5, 404, 0)], "id bigint, http_status int, content_length bigint")
    got = {r.id: r.resolver_status for r in rt.resolve(queue, probes).collect()}
    assert got == {1: "manual_required", 2: "resolved", 3: "still_blocked", 4: "still_blocked", 5: "manual_required"}


def test_graph_scan_of_missing_file_is_empty(spark, tmp_path):
    nodes, edges = graphs.split_graph(graphs.read_graph_document(spark, str(tmp_path / "none.jsonld")))
    assert nodes.count() == 0 and edges.count() == 0
    path = tmp_path / "kg.jsonld"
    path.write_text(json.dumps({"@graph": [{"@id": "topic:ai", "@type": "Topic", "name": "AI"}, {"@id": "e", "@type": "mentions", "from": "d", "to": "topic:ai"}, {"name": "no id"}]}))
    nodes, edges = graphs.split_graph(graphs.read_graph_document(spark, str(path)))
    assert [r.id for r in nodes.collect()] == ["topic:ai"] and edges.first().dst == "topic:ai"
    assert value(spark, gr.navigable(F.lit("YouTube"))) is False


def test_hyped_article_fails(spark):
    row = (1, "article", "Agents", "d", "## A\n\nA revolutionary graph [x](https://bad.example)", [("t", "https://a.example", "s")], ["https://a.example"], "agents", "s", [])
    schema = ("output_id bigint, kind string, title string, description string, body string, citations array<struct<title:string,url:string,source:string>>, "
              "allowed_urls array<string>, relevance_text string, summary string, sections array<struct<body:string,citation_urls:array<string>>>")
    rows = ql.evaluate(spark.createDataFrame([row], schema))
    failed = {r.rule for r in rows.filter("not passed").collect()}
    assert {"citation-coverage", "grounding", "reader-facing-language", "voice-adherence", "tone-match", "detail-level"} <= failed
    assert "citation-richness" not in failed and "relevance" not in failed
    assert ql.score(rows, ql.rubric(spark)).first().verdict == "fail"
    assert round(sum(w for _, w, _ in rules.RUBRIC), 9) == 1.0


def test_publish_guard_and_opportunity(spark):
    days = spark.createDataFrame([("a", 0, 0), ("b", 2, 0), ("c", 2, 1)], "day string, source_items int, n_rows int")
    assert {(r.day, r.problem) for r in ql.publish_guard(days).collect()} == {("a", "no source items"), ("b", "no rows")}
    assert ql.publish_guard(days, allow_empty=True).count() == 0
    good = F.struct(F.lit("t").alias("title"), F.lit("Speculative applied opportunity").alias("speculation_label"), F.lit(0.5).alias("confidence"))
    assert value(spark, ql.opportunity_shape(good)) is True
