"""A training-data pipeline: five stages over ``documents``, each written before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import decontaminate, exact_dedup, mixing, quality, shingle_join
from tracewell.operators.sizes import dropped, landed


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the co-trained classifier rejects."""
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).where("quality_keep").select(*docs.columns)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each text."""
    return exact_dedup.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each component of similar documents.

    Documents without doc_id go by a hash of their text, after those with one (below 2^62).
    """
    by_text = F.expr("(xxhash64(coalesce(text, '')) & 2305843009213693951L) | 4611686018427387904L")
    key = F.coalesce(F.col("doc_id").cast("long"), by_text)
    found = shingle_join.similar_components(docs.select(key.alias("doc_id"), "text"))
    drop = landed(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__drop")).distinct(), "drop")
    return docs.join(drop, key == drop["__drop"], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.decontaminated(docs, _table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: how many words of each document, repeats counted, it takes."""
    return mixing.mixture(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_jaccard_join", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: No SQL trains a classifier or embeds windows; tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each on what the one before has kept."""
    docs = _table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = landed(stage(spark, docs, sf_dir), name)
        if before is not None:
            dropped(before)
        before = docs
    return docs
