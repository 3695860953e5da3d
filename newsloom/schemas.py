"""Explicit schemas; nothing is inferred at read time."""

TABLES = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "benchmark": "item_id bigint, text string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
}

CITATION = "struct<title: string, url: string, source: string>"

FEED_ITEM = """struct<
  title: string, link: string, url: string, id: string, publishedAt: string, updatedAt: string, submittedAt: string,
  author: string, summary: string, description: string, source: string, category: string,
  authors: array<string>, keywords: array<string>, categories: array<string>,
  upvotes: bigint, comments: bigint, stars: bigint, forks: bigint, openIssues: bigint,
  language: string, thumbnail: string, projectPage: string, githubRepo: string,
  transcriptSummary: string,
  transcript: struct<videoId: string, status: string, text: string, languageCode: string, reason: string>
>"""

FEED_SOURCE = f"""struct<
  id: string, category: string, title: string, topic: string, handle: string, status: string, fetchedAt: string,
  error: string, sourceUrl: string, rssUrl: string, items: array<{FEED_ITEM}>
>"""

SNAPSHOT = f"generatedAt string, sources array<{FEED_SOURCE}>, source {FEED_SOURCE}, aiResearch {FEED_SOURCE}"

RAW_FEED_ITEM = """struct<
  title: string, link: string, id: string, guid: string, isoDate: string, pubDate: string, creator: string,
  author: string, contentSnippet: string, summary: string, categories: array<string>
>"""

PAPER_ITEM = """struct<
  id: string, title: string, publishedAt: string, summary: string, numComments: bigint, thumbnail: string,
  paper: struct<id: string, title: string, authors: array<struct<name: string, hidden: boolean>>,
    publishedAt: string, submittedOnDailyAt: string, summary: string, ai_summary: string, upvotes: bigint,
    ai_keywords: array<string>, projectPage: string, githubRepo: string>
>"""

REPOSITORY = """struct<
  id: bigint, full_name: string, name: string, html_url: string, description: string, stargazers_count: bigint,
  forks_count: bigint, open_issues_count: bigint, language: string, pushed_at: string, updated_at: string,
  owner: struct<login: string>
>"""

RSS_ITEM = """
  title string, link string, guid string, pubDate string, creator string, author string,
  description string, category array<string>
"""

CATALOGUE = """
  youtube map<string, array<string>>, googleNewsTopics array<string>,
  huggingFaceDailyPapers struct<date: string, limit: int>,
  googleResearchBlog struct<url: string, rssUrl: string, limit: int>,
  anthropicResearch struct<url: string, limit: int>, anthropicNews struct<url: string, limit: int>,
  metaAiResearch struct<url: string, limit: int>,
  vercelAnnouncements struct<limit: int, feeds: array<struct<id: string, title: string, url: string, rssUrl: string, limit: int>>>,
  githubOrganizations array<struct<id: string, organization: string, url: string, limit: int>>,
  metaResearchFeeds array<struct<id: string, title: string, url: string, rssUrl: string, limit: int>>,
  publicationFeeds array<struct<id: string, title: string, url: string, rssUrl: string, limit: int>>,
  xaiResearchFeeds struct<limit: int, queries: array<struct<id: string, title: string, url: string, query: string, limit: int>>>,
  twitterProfiles struct<provider: string, rssBaseUrl: string, limit: int, timeoutMs: int, handles: array<string>>
"""

INGEST_SOURCES = """
  rss array<struct<id: string, name: string, url: string, limit: int, topicTags: array<string>, disabled: boolean>>,
  web array<struct<id: string, name: string, url: string, limit: int, topicTags: array<string>, disabled: boolean>>,
  youtube array<struct<id: string, name: string, url: string, limit: int, topicTags: array<string>, disabled: boolean>>
"""

LEDGER_RECORD = """
  seq bigint, id string, type string, status string, reasonCode string, reasonDetail string, attemptCount int,
  canonicalUri string, contentHash string, observedAt string, nextCheckAfter string
"""

GRAPH_ENTRY = f"""struct<
  `@id`: string, `@type`: string, id: string, type: string, `from`: string, `to`: string, name: string, title: string,
  text: string, summary: string, description: string, canonicalUri: string, url: string, sourceName: string,
  sourceKind: string, sourceDocId: string, publishedAt: string, observedAt: string, validFrom: string,
  validUntil: string, eventDate: string, ingestedAt: string, mentions: bigint, citations: array<{CITATION}>
>"""

GRAPH_DOCUMENT = f"`@graph` array<{GRAPH_ENTRY}>"
