"""Registered queries of this subpackage: (spark, sf_dir) -> DataFrame over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.llm import (
    decontaminate,
    exact_dedup,
    filter_audit,
    html_text,
    licenses,
    merkle,
    mixing,
    pii,
    quality,
    shingle_join,
    suffix_dedup,
    token_files,
    warc,
)
from tracewell.session import work_path


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark, sf):
    return shingle_join.similar_components(table(spark, sf, "documents"))


def op2_exact_dedup(spark, sf):
    return exact_dedup.exact_duplicates(table(spark, sf, "documents")).drop("doc_hash", "raw_hash")


def op3_html_extraction(spark, sf):
    return html_text.extract_text(table(spark, sf, "pages"))


def op4_warc_revisits(spark, sf):
    path = work_path(spark, "warc")
    warc.write_archives(table(spark, sf, "pages"), path)
    return warc.resolve_revisits(warc.read_archives(spark, path))


def op5_suffix_array_dedup(spark, sf):
    return suffix_dedup.repeated_passages(table(spark, sf, "documents")).drop("kept")


def op6_quality_classifier(spark, sf):
    docs = table(spark, sf, "documents")
    model = quality.train(docs, table(spark, sf, "labels"))
    scores = [F.round(f"quality_{x}", 6).alias(x) for x in ("text_score", "meta_score", "score")]
    return quality.scored(docs, model).select("doc_id", *scores, F.col("quality_keep").alias("keep"))


def op7_source_mixing(spark, sf):
    return mixing.mixture(table(spark, sf, "documents")).drop("source")


def op8_license_scan(spark, sf):
    return licenses.license_matches(table(spark, sf, "documents"))


def op9_benchmark_decontamination(spark, sf):
    return decontaminate.benchmark_matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op10_personal_data(spark, sf):
    found = pii.personal_data(table(spark, sf, "documents"))

    def joined(spans, kind=None):
        name = (lambda s: s["kind"]) if kind is None else (lambda s: F.lit(kind))
        return F.transform(
            spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))
        )

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = joined(F.col("spans"))
    everything = F.concat(base, joined(F.col("disclosed"), "term"))
    return found.select(
        "doc_id",
        *map(count, pii.KINDS),
        F.sha2(F.concat_ws(",", base), 256).alias("base_sha256"),
        F.concat_ws(",", everything).alias("spans"),
        F.size("disclosed").cast("long").alias("n_term"),
    )


def op11_filter_audit(spark, sf):
    return filter_audit.filter_interactions(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op12_merkle_manifest(spark, sf):
    struck = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    claimed = F.when(struck, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle.manifest(table(spark, sf, "documents"), claimed)

    def hexed(x):
        return F.lower(F.hex(x))

    proof = F.sha2(hexed(merkle.proof_bytes(F.col("path"))), 256)
    found = found.withColumn("folded_root", merkle.folded(F.col("claimed_leaf"), F.col("path")))
    return found.select(
        "doc_id",
        *(hexed(x).alias(x) for x in ("leaf", "subroot", "root")),
        proof.alias("proof_sha256"),
        hexed("folded_root").alias("folded_root"),
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_token_files(spark, sf):
    import public_tokenizers

    path = work_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.ids_crc32(token_files.read_documents(spark, path))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_exact_dedup,
        op3_html_extraction,
        op4_warc_revisits,
        op5_suffix_array_dedup,
        op6_quality_classifier,
        op7_source_mixing,
        op8_license_scan,
        op9_benchmark_decontamination,
        op10_personal_data,
        op11_filter_audit,
        op12_merkle_manifest,
        op13_token_files,
    )
}
