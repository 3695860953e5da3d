"""Word lists, patterns and thresholds that decide results.

Everything in this module is data. The values are fixed because results
must equal those of the system whose behaviour is matched; callers may
pass their own lists to every operator that uses one.
"""

# --- fixed values: title/keyword stop words --------------------------------
STOP_WORDS = [
    "about", "after", "again", "against", "also", "amid", "and", "announce",
    "announced", "announces", "announcement", "arrive", "arrives", "from",
    "into", "latest", "launch", "launched", "launches", "new", "news",
    "release", "released", "releases", "report", "says", "the", "their",
    "this", "update", "updates", "with", "for",
]

# --- fixed values: relevance keyword stop words -----------------------------
RELEVANCE_STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "because", "by", "for", "from",
    "has", "have", "how", "in", "into", "is", "it", "of", "on", "or", "that",
    "the", "this", "to", "what", "when", "where", "who", "why", "with",
]

# --- fixed values: names that are never entities ----------------------------
STOP_ENTITIES = [
    "The", "This", "That", "First", "Second", "Third", "Fourth", "Source",
    "Example", "Developers", "Article URL", "Comments URL", "Comments",
    "Points",
]

# --- fixed values: known entity dictionary (needle, label) ------------------
KNOWN_ENTITIES = [
    ("openai", "OpenAI"), ("anthropic", "Anthropic"), ("claude", "Claude"),
    ("google deepmind", "Google DeepMind"), ("google", "Google"),
    ("github", "GitHub"), ("microsoft", "Microsoft"), ("vercel", "Vercel"),
    ("hugging face", "Hugging Face"), ("langchain", "LangChain"),
    ("llamaindex", "LlamaIndex"), ("cloudflare", "Cloudflare"),
    ("cursor", "Cursor"), ("xai", "xAI"), ("meta", "Meta"),
    ("nvidia", "NVIDIA"), ("ollama", "Ollama"), ("perplexity", "Perplexity"),
    ("lovable", "Lovable"),
]

# --- fixed values: topical relevance terms ----------------------------------
RELEVANCE_TERMS = [
    "agent", "agents", "ai", "anthropic", "api", "claude", "code", "coding",
    "copilot", "cursor", "developer", "developers", "grok", "inference",
    "langchain", "llama", "llm", "model", "models", "openai", "paper",
    "papers", "prompt", "research", "sdk", "workflow", "workflows",
]
LOW_SIGNAL_PATTERN = r"\b(fireside|rsvp|meet-?up|tech week|hosting an event|join us|streams live)\b"
RESCUE_PATTERN = r"(release|introduc|research|model|workflow|course|agent workflows|agents that)"

# --- fixed values: evidence and near-duplicate thresholds -------------------
NEAR_DUPLICATE_OVERLAP = 0.78
NEAR_DUPLICATE_MIN_WORDS = 5
UNUSABLE_TEXT_PATTERN = (
    r"\b(no usable text was extracted|no usable text|transcript unavailable"
    r"|source text unavailable|could not extract usable text)\b"
)
NO_TEXT_PLACEHOLDER = "No usable text was extracted from this source."
MIN_SCORE = 0.86

# --- fixed values: sentence ranking terms -----------------------------------
SIGNAL_TERMS = [
    "agent", "agents", "architecture", "benchmark", "coding", "consolidation",
    "context", "developer", "episodic", "inference", "limitation", "llm",
    "memory", "model", "recurrence", "recurrent", "research", "retrieval",
    "semantic", "threshold", "token", "vector",
]
TRANSCRIPT_PRIORITY_PATTERN = (
    r"\b(recurrent|recurrence|memory consolidation|long-running|llm agents?"
    r"|semantic memory|episodic memory|phase transition)\b"
)

# --- fixed values: concept phrase patterns (case-insensitive) ---------------
CONCEPT_PATTERNS = [
    r"\brecurren(?:t|ce)(?: based)? memory\b",
    r"\bmemory consolidation\b",
    r"\blong-running LLM agents?\b",
    r"\bsemantic (?:memory|store)\b",
    r"\bepisodic (?:memory|store)\b",
    r"\bphase transition thresholds?\b",
    r"\bComposer 2\.5\b",
    r"\bCursorBench\b",
    r"\bworkhorse coding models?\b",
    r"\blocal AI\b",
    r"\bopen weight models?\b",
    r"\btoken costs?\b",
    r"\bAMD (?:workstation|system|hardware)\b",
    r"\bOpen-MM-RL\b",
    r"\bverifiable rewards?\b",
    r"\bGRPO export\b",
    r"\bprogramming language for agents?\b",
    r"\bcloud agents?\b",
    r"\bagent skills?\b",
    r"\bsubconscious memory store\b",
    r"\bcontext windows?\b",
    r"\bvector (?:retrieval|search|embeddings?)\b",
    r"\bstatic thresholds?\b",
    r"\bdeveloper workflows?\b",
    r"\bagentic coding\b",
    r"\binference\b",
]
CONCEPT_HEAD_NOUNS = ["agents?", "models?", "memory", "research", "workflow", "coding", "sdk", "api"]

# --- fixed values: grounding term generics ----------------------------------
GENERIC_GROUNDING_WORDS = [
    "article", "cited", "citation", "daily", "evidence", "feed", "headline",
    "headlines", "market", "measurement", "metadata", "platform", "signal",
    "source", "sources", "story", "technical", "terms", "that",
]

# --- fixed values: theme rules, first match wins (priority, needles, tag) ---
# the topic of a whole article, by the first rule that matches
TOPIC_RULES = [
    (1, ["programming language for agents", "cloud agents", "agent skills"], "agent building blocks"),
    (2, ["composer 2.5", "cursorbench", "workhorse coding"], "coding cost"),
    (3, ["nanogpt-bench", "ai r&d", "autoresearch"], "research benchmark"),
    (4, ["local ai", "amd", "open weight", "token"], "local inference"),
    (5, ["open-mm-rl", "verifiable reward", "grpo"], "reward pipeline"),
    (6, ["omnivoice", "voice cloning", "speaker diarization"], "voice tools"),
    (7, ["media teams", "gemini", "editorial workflows"], "media agents"),
]
DEFAULT_TOPIC = "general"
# the theme of a section's heading, by the first rule that matches
HEADING_RULES = [
    (1, ["composer 2.5", "cursorbench", "workhorse coding"], "coding cost"),
    (2, ["local ai", "amd", "open weight", "token"], "local inference"),
    (3, ["open-mm-rl", "verifiable reward", "grpo"], "reward pipeline"),
    (4, ["programming language for agents", "cloud agents", "agent skills"], "agent building blocks"),
    (5, ["phase transition", "critical density", "critical mass"], "trigger point"),
    (6, ["limitation", "struggle", "brittle", "vector"], "limits"),
    (7, ["long-running", "context"], "extended context"),
    (8, ["consolidation", "semantic", "episodic"], "memory storage"),
]
DEFAULT_THEME = "technical claim"
INTENT_RULES = [
    (1, ["limitation", "struggle", "brittle"], "constraint"),
    (2, ["consolidation", "semantic", "episodic"], "memory organisation"),
    (3, ["long-running", "context"], "extended work"),
]
DEFAULT_INTENT = "development"

# --- fixed values: ban lists ------------------------------------------------
INTERNAL_LANGUAGE_PATTERNS = [
    r"\bclaim:[a-z0-9_.:-]+", r"\btopic:[a-z0-9_.:-]+",
    r"\bcommunity:[a-z0-9_.:-]+", r"\bknowledge graph\b", r"\bgraph\b",
    r"\bnode\b", r"\bneighborhood\b", r"\btraversal\b",
]
HYPE_PATTERNS = [
    r"\brevolutionary\b", r"\bgame[- ]changing\b", r"\bmind[- ]blowing\b",
    r"\bworld[- ]changing\b", r"\bunprecedented\b",
]
META_PATTERNS = [
    r"\bsource set\b", r"\bdaily feed\b", r"\bcited source signal\b",
    r"\bsource signal\b", r"\bif this source is accurate\b",
    r"\bthe article should\b", r"\bhard-science read\b",
    r"\bmeasurement input\b", r"\bmarket or platform noise\b",
    r"\bsparse metadata\b", r"\bheadline-only signal\b",
    r"\bweak syndicated metadata\b", r"\bchanges what builders measure\b",
    r"\btechnical lens for interpreting that detail\b",
    r"\bcheckable claim instead of a title-level summary\b",
    r"\bmore than a headline\b",
]
ARTICLE_RHETORIC_PATTERNS = [
    r"\bI argue\b", r"\bthis article argues\b", r"\btrial\b", r"\bverdict\b",
    r"\bphase transition\b", r"\bfirst-principles\b", r"\bmanifold\b",
    r"\blaboratory\b",
]
WIKI_LIKE_PATTERNS = [
    r"\btopic brief\b", r"\bwiki page\b", r"\bjust a list\b", r"\bpure encyclopedia\b",
]
TEMPLATE_HEADING_PATTERN = r"changes the practical tradeoff|is the central move|^openai cheap could derail"

# --- fixed values: preferred vocabulary -------------------------------------
HARD_SCIENCE_TERMS = [
    "evidence", "mechanism", "constraint", "benchmark", "architecture",
    "causal", "measurement", "trade-off", "hypothesis", "failure mode",
    "uncertainty",
]
WIKI_REFERENCE_TERMS = ["definition", "source", "evidence", "context", "relationship", "development"]
BRIEF_DETAIL_TERMS = [
    "evidence", "mechanism", "constraint", "measurement", "trade-off",
    "benchmark", "architecture",
]

# --- fixed values: voice profiles -------------------------------------------
VOICE_PROFILES = {
    "journalist": {
        "tone": "journalistic-hard-science", "detail": "analytical",
        "prefer": ["evidence", "mechanism", "constraint", "benchmark", "architecture",
                   "causal", "measurement", "trade-off", "hypothesis"],
        "avoid": ["topic brief", "wiki page", "just a list", "node", "community", "graph traversal",
                  "Uncited claims", "Breathless superlatives", "Generic market commentary",
                  "Pure encyclopedia tone", "Speculation as fact"],
    },
    "wiki": {
        "tone": "reference", "detail": "concise",
        "prefer": ["definition", "source", "evidence", "context", "relationship", "development"],
        "avoid": ["I argue", "trial", "verdict", "phase transition", "first-principles",
                  "manifold", "laboratory", "Uncited claims", "Breathless superlatives",
                  "First-person analysis", "Overly academic jargon", "Long article-style narrative arcs"],
    },
}

# --- fixed values: rubric (rule, weight, required) --------------------------
RUBRIC = [
    ("citation-coverage", 0.14, True), ("citation-richness", 0.09, True),
    ("link-health", 0.09, True), ("grounding", 0.14, True),
    ("relevance", 0.10, True), ("speculation-boundary", 0.07, True),
    ("reader-facing-language", 0.07, True), ("tone-match", 0.10, True),
    ("word-choice", 0.08, True), ("detail-level", 0.08, True),
    ("voice-adherence", 0.04, False),
]

# --- fixed values: topics that are feed families, squashed ------------------
NON_NAVIGABLE_TOPICS = [
    "googlenews", "twitter", "twitterfeeds", "youtube", "githuborganizations",
    "publicationfeeds", "publications", "vercelannouncements", "announcements",
]
SEED_TYPES = [
    "SourceDocument", "TextSpan", "TranscriptSegment", "ImageAsset", "VideoAsset",
    "Claim", "Entity", "Event", "Topic", "Brief", "EnrichedDocument",
    "AggregateBrief", "Article", "AppliedOpportunity",
]

# --- fixed values: development filters --------------------------------------
DEVELOPMENT_DENY = [
    r"^live:", r"lets anyone create and play ai games", r"^ai studio is the best way",
    r"^congrats to ",
    r"star trek|stock|shares|q1 results|dies at|famous investor|quietly fighting back",
    r"^\W+$",
]
DEVELOPMENT_ALLOW = (
    r"(ai|model|agent|openai|anthropic|nvidia|google|microsoft|developer|coding|llm|language"
    r"|research|cloud|copilot|gemini|claude|grok|hugging|vercel|lovable|deepmind|infrastructure)"
)

# --- fixed values: feed families in ledger order (key, label) ---------------
FEED_FAMILIES = [
    ("youtube", "YouTube"), ("googleNews", "Google News"),
    ("huggingFacePapers", "Hugging Face Daily Papers"),
    ("googleResearch", "Google Research"),
    ("anthropicResearch", "Anthropic Research"),
    ("anthropicNews", "Anthropic News"), ("vercelAnnouncements", "Vercel"),
    ("githubOrganizations", "GitHub"), ("metaResearch", "Meta Research"),
    ("publicationFeeds", "Publication Feeds"), ("xaiResearch", "xAI Research"),
    ("twitterFeeds", "X/Twitter"),
]

# --- fixed values: acronyms for title case ----------------------------------
TITLE_ACRONYMS = {"ai": "AI", "api": "API", "sdk": "SDK", "llm": "LLM"}
TOPIC_ACRONYMS = {"ai": "AI", "xai": "xAI", "openai": "OpenAI", "github": "GitHub"}

# --- fixed values: document states and failure codes ------------------------
SOURCE_STATES = [
    "discovered", "fetched", "parsed", "revisit_pending", "blocked_manual",
    "briefed", "enriched", "aggregated", "article_published",
]
REASON_CODES = [
    "http_401", "http_403", "http_404", "http_429", "http_5xx", "timeout",
    "empty_body", "unsupported_content_type", "parse_empty_text",
    "rss_item_missing", "youtube_transcript_missing", "x_bridge_unavailable",
    "scraper_auth_missing", "invalid_uri", "llm_inference_failed",
    "inference_unavailable",
]
# state -> state it must come from
STATE_PRECONDITIONS = {"briefed": "parsed", "enriched": "briefed", "aggregated": "enriched",
                       "article_published": "aggregated"}

# --- fixed values: graph edge vocabulary (the vocabulary URI is our own) ---
GRAPH_VOCAB = "urn:newsloom:kg#"
EDGE_TERMS = [
    "cites", "derivedFrom", "mentions", "supportsClaim", "contradictsClaim",
    "coOccursWith", "updates", "sameAs", "hasModality", "hasTemporalScope",
    "suggestsOpportunity",
]
