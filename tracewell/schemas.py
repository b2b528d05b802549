"""Schemas of the tables the operators read and write."""

from __future__ import annotations

SLOWLOG = (
    "ts TIMESTAMP, index_name STRING, statement STRING, duration_ns BIGINT, message STRING"
)
NODE_METRICS = (
    "ts TIMESTAMP, node STRING, cpu_pct DOUBLE, mem_used_pct DOUBLE, disk_read_kb DOUBLE, "
    "disk_write_kb DOUBLE, breaker_used_bytes DOUBLE, breaker_limit_bytes DOUBLE"
)
FIELD_CATALOG = (
    "index_name STRING, field_name STRING, field_type STRING, settings MAP<STRING,STRING>, "
    "aliases ARRAY<STRING>, shard_count INT, replica_count INT, doc_count BIGINT, "
    "store_size_bytes BIGINT, refreshed_at TIMESTAMP"
)
MAPPING_DOCS = "index_name STRING, mapping STRING"
INDEX_SETTINGS = "index_name STRING, settings MAP<STRING,STRING>"
INDEX_STATS = "index_name STRING, doc_count BIGINT, store_size_bytes BIGINT"
INDEX_ALIASES = "index_name STRING, aliases ARRAY<STRING>"
FINDING_ITEM = "STRUCT<code: STRING, field: STRING, message: STRING, hint: STRING>"
FINDING = (
    "index_name STRING, statement STRING, avg_duration DOUBLE, count BIGINT, "
    f"anti_patterns ARRAY<{FINDING_ITEM}>, affected_fields ARRAY<STRING>, "
    "field_types MAP<STRING,STRING>, severity STRING, recommended_searches ARRAY<STRING>, "
    "raw_exception STRING"
)
SITEMAP = "sitemap_seq INT, url_seq INT, loc STRING"
PAGE = "url STRING, status INT, html STRING"
DOC_CHUNK = (
    "chunk_id STRING, url STRING, title STRING, chunk_idx INT, text STRING, "
    "embedding ARRAY<FLOAT>"
)
LATENCY_RUN = "query STRING, variant STRING, iteration INT, elapsed_ms DOUBLE"
COST_LINE = "usage_date DATE, provider STRING, amount DOUBLE, currency STRING"
CHANGE_REQUEST = (
    "approval_id STRING, ts TIMESTAMP, action STRING, target STRING, payload STRING, "
    "reason STRING"
)
DECISION = "approval_id STRING, decision_ts TIMESTAMP, decision STRING"
WORKFLOW_STEP_EVENT = "workflow_id STRING, step STRING, status STRING, event_ts TIMESTAMP"
