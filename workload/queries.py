"""Every registered query: (spark, sf_dir) -> DataFrame over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import rules
from tracewell.functions import statements as st
from tracewell.functions import text as tx
from tracewell.functions import vectors as vec
from tracewell.operators import (
    catalog,
    cost,
    diagnosis,
    field_sketches,
    knowledge,
    latency,
    ledger,
    report,
    rewrite,
    search,
    snapshots,
    telemetry,
)
from tracewell.operators.cardinality import field_cardinality
from tracewell.operators.sizes import broadcast_if_small
from tracewell.plans.cycle import field_facts, rewrite_table
from tracewell.plans.cycle import statement_findings as findings_plan
from tracewell.session import work_path
from tracewell.sources import docs, logs, metric_files
from tracewell.streaming import approvals, live, open_windows
from workload import views

LOOKBACK = 720
LATE = "10 minutes"


def r4(*names: str) -> list:
    return [F.round(F.col(name), 4).alias(name) for name in names]


# --- telemetry -------------------------------------------------------------


def slowest_statements(spark, sf):
    out = telemetry.slowest_statements(views.slowlog(spark, sf), 336, views.AS_OF)
    return out.select("statement", "count", *r4("avg_duration"))


def slowest_by_index(spark, sf):
    log = views.slowlog_by_user(spark, sf)
    out = telemetry.slowest_statements(
        log, LOOKBACK, views.AS_OF, min_count=0, top_n=25, by=("index_name", "statement")
    )
    return out.select("index_name", "statement", "count", *r4("avg_duration"))


def node_metrics(spark, sf):
    # 1,000 days up to a fixed day
    out = telemetry.node_metrics(views.node_metrics(spark, sf), 24_000, "1999-01-01")
    return out.select("node", *r4("avg_cpu", "avg_mem_used", "avg_disk_io_read", "avg_disk_io_write"))


def breaker_hot_nodes(spark, sf):
    out = telemetry.breaker_hot_nodes(views.node_metrics(spark, sf))
    return out.select("node", *r4("avg_used", "avg_limit", "used_pct"))


def metric_documents(spark, sf):
    """Metric files of four shapes, month by month: what was read of each node, and what was rejected."""
    path = work_path(spark, "metric-files")
    views.metric_files(spark, sf, path)
    month = F.regexp_extract("file", r"month=([0-9-]+)/", 1).alias("month")
    rows = metric_files.read_metric_files(spark, path).withColumn("month", month)
    out = rows.groupBy("month", "node").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.col("reject") == metric_files.UNREADABLE).alias("unreadable"),
        F.count_if(F.col("reject") == metric_files.NO_TIME).alias("no_time"),
        F.count_if(F.col("reject") == metric_files.NO_NODE).alias("no_node"),
        F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"),
        F.sum("cpu_pct").alias("sum_cpu"),
        # values have four decimals: a sum of them is no tie, whereas a mean may be one
        F.round(F.sum("disk_write_kb"), 4).alias("sum_write"),
        F.sum("breaker_used_bytes").alias("sum_used"),
    )
    return out


def source_coverage(spark, sf):
    tables = {
        "slowlog": views.slowlog(spark, sf),
        "node_metrics": views.node_metrics(spark, sf),
        "catalog": views.catalog_history(spark, sf).withColumn("ts", F.col("refreshed_at")),
    }
    out = logs.source_coverage(["slowlog", "node_metrics", "catalog", "audit"], tables)
    stamp = "yyyy-MM-dd HH:mm:ss"
    return out.select(
        "source",
        "present",
        "row_count",
        F.date_format("earliest_ts", stamp).alias("earliest_ts"),
        F.date_format("latest_ts", stamp).alias("latest_ts"),
    )


# --- cardinality and catalogue ---------------------------------------------


def _cardinality(spark, sf, exact=True):
    return field_cardinality(
        views.searched_tables(spark, sf), views.SEARCHED_FIELDS, exact=exact
    )


def _facts(spark, sf) -> diagnosis.Facts:
    return field_facts(views.field_catalog(spark), _cardinality(spark, sf))


def field_cardinality_exact(spark, sf):
    return _cardinality(spark, sf)


def field_cardinality_approx(spark, sf):
    """Is the sketch within 5 % of the exact count?"""
    keys = ["index_name", "field_name"]
    exact = _cardinality(spark, sf).withColumnRenamed("cardinality", "exact")
    both = _cardinality(spark, sf, exact=False).join(exact, keys)
    off = F.abs(F.col("cardinality") - F.col("exact"))
    return both.select(*keys, "exact", (off <= F.col("exact") * 0.05).alias("within_5_percent"))


def catalog_like(spark, sf):
    out = catalog.catalog_like(views.catalog_history(spark, sf), "idx_1*")
    return out.select(
        "index_name", "field_name", "field_type", F.col("settings.shards").alias("shards")
    )


def catalog_latest(spark, sf):
    out = catalog.latest(views.catalog_history(spark, sf))
    return out.select(
        "index_name", "field_name", "field_type", F.col("settings.shards").alias("shards")
    )


def catalog_snapshots(spark, sf):
    """The history in three snapshots, the last first and the middle one twice; its newest state."""
    history, base = views.catalog_history(spark, sf), work_path(spark, "catalog")
    on = F.to_date("refreshed_at")
    cuts = [F.lit(c).cast("date") for c in views.SNAPSHOT_CUTS]
    parts = [on >= cuts[1], on < cuts[0], *[(on >= cuts[0]) & (on < cuts[1])] * 2]
    for part in parts:
        snapshots.append_snapshot(history.where(part), base)
    out = snapshots.newest(spark, base)
    return out.select(
        "index_name", "field_name", "field_type", F.col("settings.shards").alias("shards"),
        F.col("refreshed_on").cast("string").alias("refreshed_on"),
    )


def catalog_flatten(spark, sf):
    return catalog.flatten_mappings(catalog.skip_system(views.mapping_docs(spark, sf)))


def _enriched(spark, sf):
    return catalog.build_catalog(
        views.mapping_docs(spark, sf),
        views.index_settings(spark, sf),
        views.index_stats(spark, sf),
        views.index_aliases(spark, sf),
        F.lit(views.AS_OF),
        levels=8,  # in one pass; a shallower expression is planned faster
    )


def catalog_enriched(spark, sf):
    out = _enriched(spark, sf).withColumn("aliases", F.array_join(F.array_sort("aliases"), ","))
    return out.drop("settings", "refreshed_at")


def catalog_summary(spark, sf):
    out = catalog.catalog_summary(_enriched(spark, sf))
    return out.select("indices_indexed", "fields_indexed")


# --- diagnosis -------------------------------------------------------------


def wildcard_clauses(spark, sf):
    out = diagnosis.wildcard_clauses(views.statements(spark, sf))
    return out.select("index_name", "statement", "field", "value", "is_leading")


def wildcard_findings(spark, sf):
    out = diagnosis.wildcard_findings(views.statements(spark, sf), _facts(spark, sf).rows)
    return out.select(
        "index_name", "statement", "field", "field_type", "cardinality", "code", "message"
    )


def _texts(spark, sf, test, *extra) -> DataFrame:
    text = F.col("statement")
    return views.statements(spark, sf).where(test(text)).select("index_name", "statement", *extra)


def breaker_text(spark, sf):
    return _texts(spark, sf, st.has_breaker_text)


def unbounded_terms(spark, sf):
    return _texts(spark, sf, st.has_unbounded_terms)


def nested_clauses(spark, sf):
    count = st.nested_count(F.col("statement")).cast("bigint").alias("nested_count")
    return _texts(spark, sf, st.has_deep_nesting, count)


def script_clauses(spark, sf):
    return _texts(spark, sf, st.has_script)


def regexp_clauses(spark, sf):
    return _texts(spark, sf, st.has_regexp)


def fuzzy_clauses(spark, sf):
    return _texts(spark, sf, st.has_fuzzy)


def findings(spark, sf, log=views.slowlog, min_count=rules.MIN_COUNT) -> DataFrame:
    return findings_plan(
        log(spark, sf),
        views.field_catalog(spark),
        _cardinality(spark, sf),
        LOOKBACK,
        views.AS_OF,
        min_count,
    )


def _flat(found: DataFrame) -> DataFrame:
    """Arrays and maps as text, so that any engine can compare them."""
    pairs = F.transform(
        F.array_sort(F.map_entries("field_types")),
        lambda e: F.concat(e["key"], F.lit("="), e["value"]),
    )
    return found.select(
        "index_name",
        "statement",
        F.round("avg_duration", 4).alias("avg_duration"),
        "count",
        F.array_join("anti_patterns.code", ",").alias("codes"),
        F.array_join("affected_fields", ",").alias("affected_fields"),
        F.array_join(pairs, ",").alias("field_types"),
        "severity",
        F.array_join("recommended_searches", "|").alias("recommended_searches"),
    )


def statement_findings(spark, sf):
    return _flat(diagnosis.order_findings(findings(spark, sf)))


def statement_findings_by_user(spark, sf):
    return _flat(findings(spark, sf, views.slowlog_by_user, 0))


def severity_summary(spark, sf):
    return diagnosis.severity_summary(findings(spark, sf, views.slowlog_by_user, 0))


def recommended_searches(spark, sf):
    return diagnosis.recommended_searches(findings(spark, sf, views.slowlog_by_user, 0))


def finding_report(spark, sf):
    return report.finding_report(findings(spark, sf))


# --- pages, chunks, vectors ------------------------------------------------


def _pages(spark, sf) -> DataFrame:
    return views.page(views.table(spark, sf, "pages"))


def page_text(spark, sf):
    pages = views.table(spark, sf, "pages")
    return pages.select("page_id", tx.strip_html(F.col("html")).alias("text"))


def page_title(spark, sf):
    pages = views.table(spark, sf, "pages")
    return pages.select("page_id", tx.extract_title(F.col("html")).alias("title"))


def page_chunks(spark, sf):
    texts = knowledge.page_texts(_pages(spark, sf))
    return knowledge.chunk_texts(texts).withColumn("chunk_idx", F.col("chunk_idx").cast("bigint"))


def doc_chunks(spark, sf):
    texts = views.table(spark, sf, "documents")
    out = knowledge.chunk_texts(texts, keys=["doc_id"])
    return out.withColumn("chunk_idx", F.col("chunk_idx").cast("bigint"))


def url_discovery(spark, sf):
    out = knowledge.discover_urls(views.sitemap(spark, sf), views.PREFIXES)
    return out.select("url", F.col("sitemap_seq").cast("bigint").alias("sitemap_seq"), "url_seq")


def sitemap_urls(spark, sf):
    """Sitemap files to addresses in order: index, children, prefix, first of each."""
    path = work_path(spark, "sitemaps")
    views.sitemap_files(spark, sf, path)
    locations = docs.read_sitemap_tree(spark, f"{path}/index", f"{path}/children")
    return docs.ordered_urls(knowledge.discover_urls(locations, views.PREFIXES)).withColumn(
        "url_seq", F.col("url_seq").cast("bigint")
    )


def kb_summary(spark, sf):
    urls = knowledge.discover_urls(views.sitemap(spark, sf), views.PREFIXES, max_urls=None)
    known = broadcast_if_small(urls.select("url"))
    pages = _pages(spark, sf).join(known, "url", "left_semi")
    chunks = knowledge.chunk_texts(knowledge.page_texts(pages))
    return knowledge.knowledge_base_summary(urls, chunks)


def vector_normalize(spark, sf):
    """Length of each vector before (in 1e-4) and after scaling it to 3 and back to 1."""
    rows = views.table(spark, sf, "embeddings")
    tripled = F.transform("embedding", lambda x: x.cast("double") * 3)
    return rows.select(
        "vec_id",
        F.round(vec.vector_norm(tripled), 4).alias("norm_before"),
        F.round(vec.vector_norm(vec.normalize(tripled)), 4).alias("norm_after"),
    )


def _centroids(spark, sf) -> DataFrame:
    """Mean vector per label: a few queries that rest on every row."""
    places = views.table(spark, sf, "embeddings").select(
        "label", F.posexplode("embedding").alias("place", "x")
    )
    means = places.groupBy("label", "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "x")))["x"]
    return means.groupBy(F.col("label").alias("query_id")).agg(ordered.alias("embedding"))


def vector_topk(spark, sf):
    corpus = views.table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id")
    hits = search.vector_topk(corpus, _centroids(spark, sf))
    return hits.select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", *r4("score"))


def vector_topk_tiled(spark, sf):
    """The same result by the way taken when the queries are too many to broadcast."""
    corpus = views.table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id")
    hits = search.vector_topk(corpus, _centroids(spark, sf), max_query_bytes=1)
    return hits.select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", *r4("score"))


def knowledge_search(spark, sf):
    """Text search: chunks of all pages, one question per benchmark item."""
    embedder = vec.hashed_tokens()
    chunks = knowledge.chunk_texts(knowledge.page_texts(_pages(spark, sf)))
    kb_path = work_path(spark, "kb")
    docs.write_knowledge_base(knowledge.embed_chunks(chunks, embedder), kb_path)
    questions = views.table(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id")
    hits = search.search(docs.read_knowledge_base(spark, kb_path), questions, embedder)
    return hits.withColumn("score", F.round("score", 4))


# --- comparison, cost, ledger, rewrite -------------------------------------


def latency_stats(spark, sf):
    out = latency.latency_stats(views.latency_run(spark, sf))
    return out.select("query", "variant", "min_ms", "max_ms", "p95_ms", "iterations", *r4("avg_ms"))


def latency_compare(spark, sf):
    out = latency.latency_compare(views.latency_run(spark, sf))
    return out.select(
        "query", "improvement_pct", "improvement_confirmed", *r4("baseline_avg_ms", "optimized_avg_ms")
    )


def cost_mtd_projection(spark, sf):
    out = cost.month_to_date(views.cost_line(spark, sf), views.COST_AS_OF)
    return out.select(
        "provider",
        "currency",
        F.round("month_to_date_cost", 2).alias("month_to_date_cost"),
        F.round("projected_monthly_cost", 6).alias("projected_monthly_cost"),
    )


def _requests(spark, sf) -> DataFrame:
    return ledger.change_requests(views.change_of(views.table(spark, sf, "orders")))


def _decisions(spark, sf) -> DataFrame:
    return views.decision_of(views.table(spark, sf, "orders"))


def cost_decisions(spark, sf):
    out = cost.cost_decisions(_requests(spark, sf).select("action", "payload"))
    return out


def approval_ids(spark, sf):
    return _requests(spark, sf).select("approval_id", "action", "target", "payload")


def pending_approvals(spark, sf):
    out = ledger.pending_approvals(_requests(spark, sf), _decisions(spark, sf))
    return out.select("approval_id", "action", "target", "payload")


def approval_resolved(spark, sf):
    out = ledger.resolve_approvals(_requests(spark, sf), _decisions(spark, sf))
    return out.select("approval_id", "payload", "outcome")


def action_tally(spark, sf):
    resolved = ledger.resolve_approvals(_requests(spark, sf), _decisions(spark, sf))
    return ledger.action_tally(
        resolved.select(F.col("action").alias("tool"), F.col("outcome").alias("result_status"))
    )


def workflow_status(spark, sf):
    return ledger.workflow_status(views.workflow_step_event(spark, sf))


def conversation_outcome(spark, sf):
    return ledger.cycle_outcome(views.table(spark, sf, "conversations"), max_rounds=3)


def table_rewrite(spark, sf):
    out = rewrite.rewrite(
        views.table(spark, sf, "orders"),
        {"o_orderkey": "string", "o_custkey": "int", "o_orderdate": "date"},
        F.col("o_orderstatus") != "P",
        {"o_orderpriority": "priority"},
    )
    return out.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


def table_rewrite_swapped(spark, sf):
    """Two copies of the orders one after the other, read by the name that points at the second."""
    orders, run = views.table(spark, sf, "orders"), uuid.uuid4().hex
    alias = f"orders_now_{run}"
    types = {"o_orderkey": "string", "o_custkey": "int", "o_orderdate": "date"}
    open_orders = F.col("o_orderstatus") != "P"
    for step, where in enumerate((open_orders, F.col("o_orderstatus") != "F")):
        rewrite_table(
            orders, f"orders_{step}_{run}", alias, types, where, ("o_orderstatus",),
            {"o_orderpriority": "priority"}, work_path(spark, "orders-copy"),
        )
    out = spark.table(alias)
    return out.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


def template_match(spark, sf):
    part = views.table(spark, sf, "part")
    names = part.select(
        F.concat_ws(
            "-", F.lit("logs"), F.lower("p_type"), F.lower("p_brand"), F.col("p_partkey").cast("string")
        ).alias("name")
    )
    kinds = part.select(
        F.concat(F.lit("t-"), F.lower("p_type")).alias("template_name"),
        F.array(F.concat(F.lit("logs-"), F.lower("p_type"), F.lit("-*"))).alias("patterns"),
        F.lit(10).alias("priority"),
    )
    brands = part.select(
        F.concat(F.lit("b-"), F.lower("p_brand")).alias("template_name"),
        F.array(
            F.concat(F.lit("logs-s*-"), F.lower("p_brand"), F.lit("-1?")),
            F.concat(F.lit("*-"), F.lower("p_brand"), F.lit("-?7")),
        ).alias("patterns"),
        F.lit(20).alias("priority"),
    )
    templates = kinds.unionByName(brands).distinct()
    out = rewrite.match_templates(names, templates)
    return out.select("name", "template_name", "pattern")


# --- streams ---------------------------------------------------------------


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    schema = views.table(spark, sf, name).schema
    return live.read_files(spark, f"{sf}/{name}.parquet*", schema)  # file or folder


def _landed(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    path = work_path(spark, name)
    live.run_to_files(stream, path, work_path(spark, f"{name}-progress"))
    return spark.read.schema(stream.schema).parquet(path)


def _landed_with_open(spark: SparkSession, stream: DataFrame, name: str, still_open) -> DataFrame:
    """What a windowed stream gave, and its open windows as they stand."""
    path, progress = work_path(spark, name), work_path(spark, f"{name}-progress")
    live.run_to_files(stream, path, progress)
    given = spark.read.schema(stream.schema).parquet(path)
    return open_windows.with_open(given, still_open(stream, progress))


def _log_stream(spark, sf) -> DataFrame:
    return live.event_time(views.slowlog_of(_stream(spark, sf, "events")))


def _stamp(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def _all_statements(stream: DataFrame, progress: str) -> DataFrame:
    return open_windows.open_statements(stream, progress, min_count=0)


def stream_hourly_slow(spark, sf):
    stream = live.slow_statements(_log_stream(spark, sf), "1 hour", min_count=0, delay=LATE)
    out = _landed_with_open(spark, stream, "hourly", _all_statements)
    return out.select(_stamp("window_start"), "statement", "count", *r4("avg_duration"), "final")


def stream_sliding_slow(spark, sf):
    stream = live.slow_statements(
        _log_stream(spark, sf), "1 hour", "10 minutes", min_count=0, delay=LATE
    )
    out = _landed_with_open(spark, stream, "sliding", _all_statements)
    return out.select(_stamp("window_start"), "statement", "count", *r4("avg_duration"), "final")


def stream_top_per_day(spark, sf):
    stream = live.slow_statements(_log_stream(spark, sf), "1 day", min_count=0, delay=LATE)
    path, progress = work_path(spark, "top"), work_path(spark, "top-progress")
    live.run_top_per_window(stream, path, progress)
    still_open = open_windows.top_per_window(_all_statements(stream, progress))
    given = spark.read.schema(still_open.schema).parquet(path).drop("batch")
    out = open_windows.with_open(given, still_open)
    return out.select(
        _stamp("window_start"), F.col("rank").cast("bigint").alias("rank"), "statement", "count", "final"
    )


def stream_breaker_alert(spark, sf):
    metrics = live.event_time(views.node_metrics_of(_stream(spark, sf, "lineitem")))
    stream = live.breaker_alerts(metrics, "1 day", delay=LATE)
    out = _landed_with_open(spark, stream, "breaker", open_windows.open_breaker_alerts)
    return out.select(_stamp("window_start"), "node", *r4("avg_used", "avg_limit", "used_pct"), "final")


def stream_findings(spark, sf):
    stream = live.live_findings(_log_stream(spark, sf), _facts(spark, sf))
    out = _landed(spark, stream.select("user_id", "statement", "code", "field", "message"), "live")
    return out.withColumn("field", F.coalesce("field", F.lit("")))


def stream_findings_fresh(spark, sf):
    """Findings of the log with facts that are measured at each batch, from sketches by day."""
    path, tables = work_path(spark, "sketches"), views.searched_tables(spark, sf)
    for name, fields in views.SEARCHED_FIELDS.items():
        day = F.expr(views.SKETCH_DAYS.get(name, "NULL"))
        field_sketches.write_sketches(field_sketches.day_sketches(tables[name], name, fields, day), path)

    def facts() -> diagnosis.Facts:
        known = field_sketches.estimated_cardinality(spark, path)
        return field_facts(views.field_catalog(spark), field_sketches.settled_cardinality(known, tables))

    out = work_path(spark, "fresh")
    live.run_live_findings(_log_stream(spark, sf), facts, out, work_path(spark, "fresh-progress"))
    found = spark.read.parquet(out)
    return found.select("user_id", "statement", "code", F.coalesce("field", F.lit("")).alias("field"))


def stream_approvals(spark, sf):
    requests = ledger.change_requests(views.change_of(_stream(spark, sf, "orders")))
    decisions = views.decision_of(_stream(spark, sf, "orders"))
    out = _landed(spark, live.expiring_approvals(requests, decisions, delay=LATE), "approvals")
    return out.select("approval_id", "payload", "outcome")


def stream_approval_outcomes(spark, sf):
    requests = ledger.change_requests(views.change_of(_stream(spark, sf, "orders")))
    decisions = views.decision_of(_stream(spark, sf, "orders"))
    done = _landed(spark, approvals.approval_outcomes(requests, decisions, delay=LATE), "outcomes")
    orders = views.table(spark, sf, "orders")
    asked, said = ledger.change_requests(views.change_of(orders)), views.decision_of(orders)
    last = max(filter(None, (asked.agg(F.max("ts")).first()[0], said.agg(F.max("decision_ts")).first()[0])), default=None)
    return approvals.with_open_requests(done, asked, said, F.lit(last).cast("timestamp")).select("approval_id", "payload", "outcome")


def stream_bursts(spark, sf):
    stream = live.statement_bursts(_log_stream(spark, sf), delay=LATE)
    out = _landed_with_open(spark, stream, "bursts", open_windows.open_bursts)
    return out.select(_stamp("burst_start"), "statement", "count", *r4("avg_duration"), "final")


def stream_knowledge_base(spark, sf):
    path = work_path(spark, "live-kb")
    live.run_knowledge_base(
        views.page(_stream(spark, sf, "pages")),
        path,
        work_path(spark, "live-kb-progress"),
        vec.hashed_tokens(),
    )
    out = live.read_incremental_knowledge_base(spark, path)
    return out.select("url", "title", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), "text")


NAMES = [
    "slowest_statements", "slowest_by_index", "node_metrics", "breaker_hot_nodes",
    "metric_documents", "source_coverage", "field_cardinality_exact", "field_cardinality_approx", "catalog_like",
    "catalog_latest", "catalog_snapshots", "catalog_flatten", "catalog_enriched", "catalog_summary",
    "wildcard_clauses", "wildcard_findings", "breaker_text", "unbounded_terms",
    "nested_clauses", "script_clauses", "regexp_clauses", "fuzzy_clauses",
    "statement_findings", "statement_findings_by_user", "severity_summary",
    "recommended_searches", "finding_report", "page_text", "page_title", "page_chunks",
    "doc_chunks", "url_discovery", "sitemap_urls", "kb_summary", "vector_normalize", "vector_topk",
    "vector_topk_tiled", "knowledge_search", "latency_stats", "latency_compare",
    "cost_mtd_projection", "cost_decisions", "approval_ids", "pending_approvals",
    "approval_resolved", "action_tally", "workflow_status", "conversation_outcome",
    "table_rewrite", "table_rewrite_swapped", "template_match", "stream_hourly_slow", "stream_sliding_slow",
    "stream_top_per_day", "stream_breaker_alert", "stream_findings", "stream_findings_fresh", "stream_approvals",
    "stream_approval_outcomes", "stream_bursts", "stream_knowledge_base",
]

QUERIES = {name: globals()[name] for name in NAMES}
