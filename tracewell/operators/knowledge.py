"""Pages to searchable text chunks."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell import rules
from tracewell.functions import text as tx
from tracewell.functions.vectors import EmbedderFactory, embed
from tracewell.operators.ranking import first_rows
from tracewell.sources.docs import fetched_pages


def with_prefix(sitemap: DataFrame, prefixes: Iterable[str]) -> DataFrame:
    """Addresses that begin with one of a few prefixes."""
    tests = [F.col("loc").startswith(prefix) for prefix in prefixes]
    return sitemap.where(reduce(lambda a, b: a | b, tests, F.lit(False)))


def discover_urls(
    sitemap: DataFrame,
    prefixes: Iterable[str],
    max_urls: int | None = None,
    cap_first: bool = True,
) -> DataFrame:
    """Distinct page addresses in sitemap order: (url, sitemap_seq, url_seq).

    The cap counts addresses before duplicates are removed, so the result can
    be shorter than the cap; ``cap_first=False`` removes duplicates first.
    ``max_urls=None`` sets no cap.
    """
    order = ["sitemap_seq", "url_seq"]
    rows = with_prefix(sitemap, prefixes).select("loc", *order)
    if max_urls is not None and cap_first:
        rows = first_rows(rows, *order, max_urls)
    urls = (
        rows.groupBy(F.col("loc").alias("url"))
        .agg(F.min(F.struct(*order)).alias("first"))
        .select("url", "first.*")
    )
    if max_urls is not None and not cap_first:
        urls = first_rows(urls, *order, max_urls)
    return urls


def page_texts(pages: DataFrame, default_title: str = rules.DEFAULT_TITLE) -> DataFrame:
    """(url, title, text) of the pages that arrived; the HTML stays behind."""
    html = F.col("html")
    return fetched_pages(pages).select(
        "url",
        tx.extract_title(html, default_title).alias("title"),
        tx.strip_html(html).alias("text"),
    )


def chunk_texts(
    texts: DataFrame,
    keys: Iterable[str] = ("url", "title"),
    size: int = rules.CHUNK_SIZE,
    overlap: int = rules.CHUNK_OVERLAP,
) -> DataFrame:
    """One row per chunk of ``text``: the keys, ``chunk_idx`` and ``text``.

    ``chunk_idx`` is the place in the whole text, counted before short chunks
    are dropped.
    """
    keys = list(keys)
    pieces = F.posexplode(tx.split_chunks(F.col("text"), size, overlap)).alias("chunk_idx", "text")
    chunks = texts.select(*keys, pieces)
    return chunks.where(tx.is_long_chunk(F.col("text")))


def embed_chunks(
    chunks: DataFrame, factory: EmbedderFactory, partitions: int | None = None
) -> DataFrame:
    """Add ``chunk_id`` and ``embedding``.

    One long page can give many chunks, so they are dealt out evenly before the
    model runs: into ``partitions``, or else into parts of the advisory size.
    """
    chunks = chunks.repartition(partitions) if partitions else chunks.hint("rebalance")
    chunk_id = F.sha2(F.concat_ws("#", "url", F.col("chunk_idx").cast("string")), 256)
    return chunks.select(
        chunk_id.alias("chunk_id"),
        "url",
        "title",
        "chunk_idx",
        "text",
        embed(F.col("text"), factory).alias("embedding"),
    )


def knowledge_base_summary(urls: DataFrame, chunks: DataFrame) -> DataFrame:
    """(url_count, chunk_count, status); addresses that failed to load count too."""
    counted = urls.select(F.lit(1).alias("u"), F.lit(0).alias("c")).unionAll(
        chunks.select(F.lit(0).alias("u"), F.lit(1).alias("c"))
    )
    totals = counted.agg(
        F.count_if(F.col("u") == 1).alias("url_count"),
        F.count_if(F.col("c") == 1).alias("chunk_count"),
    )
    status = F.when(F.col("url_count") == 0, "no_urls_discovered").otherwise("indexed")
    return totals.withColumn("status", status)
