"""Fixed values of the diagnosis rules: patterns, limits, texts, costs."""

from __future__ import annotations

# --------------------------------------------------------------------------
# Fixed values. They decide results and must stay exactly as they are.
# --------------------------------------------------------------------------

# Statement patterns (Java and Python regex agree on all of them).
WILDCARD_CLAUSE = r'"wildcard"\s*:\s*\{[^}]*"([^"]+)"\s*:\s*\{?[^}]*"value"\s*:\s*"([^"]+)"'
LEADING_WILDCARD = r"^[*?]"
BREAKER_TEXTS = ("CircuitBreakingException", "circuit_breaking_exception", "Data too large")
UNBOUNDED_TERMS = r'"terms"\s*:\s*\{(?:(?!"size").)*\}'
NESTED_TOKEN = r'"nested"'
SCRIPT_CLAUSE = r'"script"\s*:\s*\{'
FUZZY_CLAUSE = r'"fuzzy"\s*:\s*\{'
REGEXP_CLAUSE = r'"regexp"\s*:\s*\{'

# Limits; every comparison is strict (>), except the nested count (>=).
HIGH_CARDINALITY = 1_000
TRIGRAM_CARDINALITY = 10_000
TRIGRAM_TYPES = ("keyword", "text")
NESTED_MIN_COUNT = 2
CRITICAL_MS = 10_000
HIGH_MS = 5_000
MEDIUM_MS = 2_000
HIGH_FINDINGS = 3
MEDIUM_FINDINGS = 2
BREAKER_USED_PCT = 70
SEVERITIES = ("critical", "high", "medium", "low")  # in report order
UNKNOWN_TYPE = "unknown"

# Query defaults.
LOOKBACK_HOURS = 1
MIN_COUNT = 100
TOP_STATEMENTS = 5
TOP_K = 5
MAX_URLS = 2_000
CHUNK_SIZE = 500
CHUNK_OVERLAP = 50
MIN_CHUNK_CHARS = 50
DEFAULT_TITLE = "Untitled"
P95 = 0.95
APPROVAL_TIMEOUT_SECONDS = 300
WORKFLOW_TIMEOUT_SECONDS = 3_600
MAX_ROUNDS = 15
SLOWLOG_PATTERN = ".ds-elasticsearch.slowlog-*"
NODE_METRICS_PATTERN = "metrics-elasticsearch.node-*"
CATALOG_NAME = "index-metadata"
SITEMAP_NAMESPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"

# One row per finding code: text shown to the reader and the follow-up search.
# {value}, {field}, {type}, {cardinality}, {count} are filled in per finding.
LEADING, HIGH_CARD, TRIGRAM = "leading_wildcard", "high_cardinality_wildcard", "trigram_candidate"
BREAKER, UNBOUNDED, NESTING = "circuit_breaker", "unbounded_terms", "deep_nesting"
SCRIPT, REGEXP, FUZZY = "script_query", "regexp_query", "fuzzy_query"

MESSAGES = {
    LEADING: "Leading wildcard '{value}' on field '{field}' (type={type}) "
    "prevents index use and causes full shard scan.",
    HIGH_CARD: "Wildcard query on high-cardinality field '{field}' "
    "(~{cardinality} unique values, type={type}). "
    "Consider switching to 'wildcard' field type or n-gram tokenizer.",
    TRIGRAM: "Field '{field}' is type '{type}' with {cardinality} unique values. "
    "A dedicated 'wildcard' field type would store a trigram index for faster matching.",
    BREAKER: "CircuitBreakerException detected. The JVM heap is exhausted during this query. "
    "The 'indices.breaker.total.limit' setting may need adjustment, or the query "
    "is fetching too much data into memory.",
    UNBOUNDED: "Terms aggregation detected without an explicit 'size' limit. "
    "This can cause excessive heap usage and trigger circuit breakers.",
    NESTING: "Query contains {count} nested clauses. Deep nesting triggers "
    "child document joins on each shard, causing significant latency.",
    SCRIPT: "Script query detected. Script queries execute per document and bypass "
    "all index structures. Consider pre-computing the scripted value as a "
    "stored field or runtime field with caching.",
    REGEXP: "Regexp query detected. Regexp queries can match millions of terms in the "
    "inverted index. Consider switching to a dedicated 'wildcard' field type "
    "or indexing a pre-normalized keyword for filtering.",
    # Ours: the optional fuzzy detector has no text of its own elsewhere.
    FUZZY: "Fuzzy query detected.",
}

SEARCH_HINTS = {
    LEADING: "Optimizing leading wildcard queries in Elasticsearch field type {type}",
    HIGH_CARD: "Optimizing wildcard queries in Elastic n-grams wildcard field type",
    TRIGRAM: "Elasticsearch wildcard field type trigram optimization",
    BREAKER: "Elasticsearch indices.breaker.total.limit CircuitBreakerException configuration",
    UNBOUNDED: "Elasticsearch terms aggregation size limit performance best practices",
    NESTING: "Elasticsearch nested query performance alternatives flattened object",
    SCRIPT: "Elasticsearch script query performance runtime field stored field alternative",
    REGEXP: "Elasticsearch regexp query performance wildcard field type alternative",
    FUZZY: "Fuzzy query performance",
}

# A finding text with this word makes the statement critical.
BREAKER_MARK = "CircuitBreakerException"

EMPTY_REPORT = (
    "Diagnosis complete. No performance anti-patterns detected in the sampled queries."
)
REPORT_HEAD = "Diagnosis results (ordered by severity):"
REPORT_STATEMENT_CHARS = 200
REPORT_SUMMARY_CHARS = 500

# Monthly cost rule per proposed action.
NODE_MONTHLY_RATE = 200.0
FREE_ACTIONS = ("reindex", "query_rewrite", "mapping_change")
SCALING_ACTIONS = ("scale_node", "new_node")
DAYS_PER_MONTH = 30
REASON_FREE = (
    "Proposed action '%s' costs $%.2f/mo. Scaling a node costs $%.2f/mo. "
    "Estimated monthly savings by optimizing instead of scaling: $%.2f. "
    "Proceeding with the optimization."
)
REASON_SCALING = (
    "Scaling costs $%.2f/mo. "
    "Query and mapping optimizations should be exhausted first before scaling."
)
REASON_OTHER = "No cost constraint identified for action '%s'."

# Whitespace as Python's str.strip() and \s see it (Unicode White_Space plus
# the four ASCII separators): a run of it in Java regex, and its characters.
WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
