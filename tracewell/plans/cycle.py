"""The three whole jobs: one diagnosis cycle, the catalogue, the knowledge base."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from tracewell import rules
from tracewell.functions.vectors import EmbedderFactory
from tracewell.operators import catalog as cat
from tracewell.operators import diagnosis, knowledge, rewrite, telemetry
from tracewell.operators.cardinality import field_cardinality, referenced_fields
from tracewell.operators.sizes import broadcast_if_small, landed
from tracewell.sources.docs import read_knowledge_base, write_knowledge_base


@dataclass
class Cycle:
    """Lazy results of one cycle."""

    slowest: DataFrame
    nodes: DataFrame
    hot_nodes: DataFrame
    findings: DataFrame
    summary: DataFrame
    searches: DataFrame


def statement_findings(
    slowlog: DataFrame,
    catalog: DataFrame,
    cardinality: DataFrame,
    hours: float | None = rules.LOOKBACK_HOURS,
    as_of=None,
    min_count: int = rules.MIN_COUNT,
    top_n: int | None = None,
) -> DataFrame:
    """Log to graded findings, over all statements or the top ``top_n``.

    Starts jobs for the field facts; the log itself is one lazy plan.
    """
    stats = telemetry.slowest_statements(
        slowlog, hours, as_of, min_count, top_n, by=diagnosis.KEYS
    )
    return diagnosis.diagnose(stats, field_facts(catalog, cardinality))


def field_facts(catalog: DataFrame, cardinality: DataFrame) -> diagnosis.Facts:
    """Measured facts from a catalogue with any number of versions. Starts jobs."""
    kept = catalog.select("index_name", "field_name", "field_type", "refreshed_at")
    return diagnosis.measure_facts(cat.latest(kept), cardinality)


def run_cycle(
    slowlog: DataFrame,
    metrics: DataFrame,
    catalog: DataFrame,
    tables: Mapping[str, DataFrame],
    hours: float | None = rules.LOOKBACK_HOURS,
    as_of=None,
    min_count: int = rules.MIN_COUNT,
    top_n: int | None = None,
) -> Cycle:
    """Everything one look at the system gives, over all statements or the top ``top_n``.

    Starts jobs to aggregate the log once (one row per statement, written to the
    shared folder), to find which columns of ``tables`` are searched, and to
    count the values of those.
    """
    stats = landed(
        telemetry.slowest_statements(slowlog, hours, as_of, min_count, top_n, by=diagnosis.KEYS),
        "statement-stats",
    )
    wanted = referenced_fields(diagnosis.wildcard_clauses(stats), tables)
    spark = slowlog.sparkSession
    if wanted:
        cardinality = field_cardinality(tables, wanted)
    else:
        cardinality = spark.createDataFrame(
            [], "index_name string, field_name string, cardinality bigint"
        )
    findings = diagnosis.diagnose(stats, field_facts(catalog, cardinality))
    return Cycle(
        slowest=stats,
        nodes=telemetry.node_metrics(metrics, hours, as_of),
        hot_nodes=telemetry.breaker_hot_nodes(metrics),
        findings=diagnosis.order_findings(findings),
        summary=diagnosis.severity_summary(findings),
        searches=diagnosis.recommended_searches(findings),
    )


def refresh_catalog(
    mapping_docs: DataFrame,
    settings: DataFrame,
    stats: DataFrame,
    aliases: DataFrame,
    table: str,
    append: bool = False,
) -> DataFrame:
    """Build and write the catalogue; returns its summary. Starts a job."""
    spark = mapping_docs.sparkSession
    cat.write_catalog(cat.build_catalog(mapping_docs, settings, stats, aliases), table, append)
    return cat.catalog_summary(spark.table(table))


def build_knowledge_base(
    sitemap: DataFrame,
    pages: DataFrame,
    prefixes: Iterable[str],
    path: str,
    factory: EmbedderFactory,
    max_urls: int | None = None,
    size: int = rules.CHUNK_SIZE,
    overlap: int = rules.CHUNK_OVERLAP,
) -> DataFrame:
    """Sitemap to written chunks and vectors; returns the summary. Starts a job."""
    urls = knowledge.discover_urls(sitemap, prefixes, max_urls)
    return index_pages(urls, pages, path, factory, size, overlap)


def index_pages(
    urls: DataFrame,
    pages: DataFrame,
    path: str,
    factory: EmbedderFactory,
    size: int = rules.CHUNK_SIZE,
    overlap: int = rules.CHUNK_OVERLAP,
) -> DataFrame:
    """Index the fetched pages of a list of addresses; returns the summary. Starts a job."""
    wanted = pages.join(broadcast_if_small(urls.select("url").distinct()), "url", "left_semi")
    chunks = knowledge.chunk_texts(knowledge.page_texts(wanted), size=size, overlap=overlap)
    written = write_knowledge_base(knowledge.embed_chunks(chunks, factory), path)
    indexed = read_knowledge_base(pages.sparkSession, path) if written else chunks.limit(0)
    return knowledge.knowledge_base_summary(urls, indexed)


def rewrite_table(
    source: DataFrame,
    target: str,
    alias: str,
    types: Mapping[str, str],
    where: Column | str | None = None,
    partition_by: tuple[str, ...] = (),
    renames: Mapping[str, str] | None = None,
    path: str | None = None,
) -> int:
    """Copy into new types, prove the copy, then point the alias at it; returns the rows written.

    A failing step raises, and the alias stays where it was. A copy that is not
    what its source gives is dropped (``CopyMismatch``); files under a ``path``
    of one's own stay for a look at them.
    """
    spark = source.sparkSession
    rows = rewrite.rewrite(source, types, where, renames)
    rewrite.write_rewritten(rows, target, partition_by, path)
    try:
        written = rewrite.prove_copy(rows, target)
    except rewrite.CopyMismatch:
        spark.sql(f"DROP TABLE {target}")
        raise
    rewrite.swap_alias(spark, alias, target)
    return written
