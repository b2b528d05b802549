"""Readers and writers of the document knowledge base."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import schemas
from tracewell.functions.text import strip_whitespace
from tracewell.operators.ranking import numbered_rows
from tracewell.operators.sizes import landed


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """One URL per line; blank lines are dropped."""
    lines = spark.read.text(path).select(strip_whitespace(F.col("value")).alias("url"))
    return lines.where(F.col("url") != "")


def sitemap_locations(sitemaps: DataFrame) -> DataFrame:
    """Page addresses of fetched sitemap files.

    ``sitemaps`` has (sitemap_seq, xml), one row per child sitemap. A sitemap
    that is no XML, and an entry without an address, gives no row.
    """
    entries = F.from_xml("xml", "url array<struct<loc:string>>")["url"]
    return (
        sitemaps.select("sitemap_seq", F.posexplode(entries).alias("url_seq", "entry"))
        .select("sitemap_seq", "url_seq", strip_whitespace(F.col("entry.loc")).alias("loc"))
        .where(F.col("loc") != "")
    )


def child_sitemaps(index: DataFrame) -> DataFrame:
    """Child sitemap addresses of fetched sitemap index files: (sitemap_seq, loc)."""
    entries = F.from_xml("xml", "sitemap array<struct<loc:string>>")["sitemap"]
    return (
        index.select(F.posexplode(entries).alias("sitemap_seq", "entry"))
        .select("sitemap_seq", strip_whitespace(F.col("entry.loc")).alias("loc"))
        .where(F.col("loc") != "")
    )


def read_sitemap_files(spark: SparkSession, path: str) -> DataFrame:
    """Child sitemap files as (path, loc) rows, read in parallel by the XML source."""
    rows = (
        spark.read.format("xml")
        .option("rowTag", "url")
        .schema("loc string")
        .load(path)
        .select(F.col("_metadata.file_path").alias("path"), F.trim("loc").alias("loc"))
    )
    return rows.where(F.col("loc") != "")


#: The name a fetched sitemap is kept under: the last part of its address, as a file or a folder of one part.
_KEPT_AS = r"(?:^|/)(?:[^/=]+=)?([^/]+?\.xml)(?:\.gz)?(?:/part-[^/]*)?$"


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, xml) of the sitemap files under a path; a file holds 50,000 addresses at most."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    kept = F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), _KEPT_AS, 1))
    return files.select(kept.alias("name"), F.col("value").alias("xml"))


def read_sitemap_tree(spark: SparkSession, index: str, children: str) -> DataFrame:
    """Page addresses of a sitemap index and its fetched child sitemaps, in their order.

    Gives (sitemap_seq, url_seq, loc): the place of the child in the index and of
    the address in the child, both from 0. ``index`` is the index file, or a folder
    of them, read in order of name; ``children`` is a folder where each child is
    kept under the last part of its address. A child that is missing or no XML, an
    entry without an address, and a file that no index names give no row; a child
    that is named twice has its first place. Starts jobs.
    """
    entries = F.from_xml("xml", "sitemap array<struct<loc:string>>")["sitemap"]
    named = _whole_files(spark, index).select("name", F.posexplode(entries).alias("place", "entry"))
    named = named.select("name", "place", strip_whitespace(F.col("entry.loc")).alias("loc")).where("loc <> ''")
    last = F.regexp_extract("loc", r"([^/?#]+?)(?:\.gz)?(?:[?#].*)?$", 1)
    order = numbered_rows(named.select("name", "place", last.alias("child")), "name", "place", name="seq")
    order = order.groupBy("child").agg((F.min("seq") - 1).alias("sitemap_seq"))
    # the parser stops at the end of the root, so what is cut off or goes on after it is told here
    ended = F.col("xml").rlike(r"</(\w+:)?urlset\s*>\s*(<!--[^>]*-->\s*)*$")
    files = _whole_files(spark, children).where(ended).withColumnRenamed("name", "child")
    return sitemap_locations(files.join(order, "child").select("sitemap_seq", "xml"))


def ordered_urls(urls: DataFrame) -> DataFrame:
    """Addresses of ``discover_urls`` with ``position``, from 1, in sitemap order. Starts jobs."""
    return numbered_rows(urls, "sitemap_seq", "url_seq")


def fetched_pages(pages: DataFrame) -> DataFrame:
    """Pages that arrived: a 2xx status and a body."""
    return pages.where(F.col("status").between(200, 299) & F.col("html").isNotNull())


def write_knowledge_base(chunks: DataFrame, path: str) -> bool:
    """Full rebuild: chunk text and vector side by side in one Parquet table.

    Starts jobs. Chunks are embedded once, into a folder of their own, and moved
    over the table from there; no chunks leave the table as it is and return False.
    """
    fresh = landed(chunks, "knowledge-base")
    if fresh.isEmpty():
        return False
    fresh.write.mode("overwrite").parquet(path)
    return True


def read_knowledge_base(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(schemas.DOC_CHUNK).parquet(path)
    except AnalysisException as error:
        raise FileNotFoundError(
            f"no knowledge base at {path}; build it with write_knowledge_base first"
        ) from error
