"""The pipeline's stages, and every registered query with SQL against it."""

import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check
import corpus_pipeline
from tracewell.llm import decontaminate, exact_dedup, quality, shingle_join
from tracewell.llm.queries import QUERIES
from tracewell.llm.sql import ORACLE
from tracewell.operators.sizes import landed, small_batches


def test_names():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(ORACLE) < set(QUERIES) < set(entry.queries())
    assert "pipeline" in entry.queries() and [len(s) for s in corpus_pipeline.STAGES] == [2] * 5


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_sql(spark, sf, name):
    ok, note = check.compare(spark, check.connect(sf), name, sf)
    assert ok, note


def test_stages(spark, sf):
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, landed(stage(spark, docs, sf), name)
        kept[name] = docs
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        had = {r.doc_id: r.text for r in before.select("doc_id", F.col("text") if "text" in before.columns else F.lit(None).alias("text")).collect()}
        assert ids <= set(had)
        if name != "source_mixing":
            assert docs.columns == columns
        if name == "quality_classifier":
            clean = {r.doc_id for r in labels.collect()} & set(had)
            assert len(clean - ids) <= 0.01 * len(clean) and len(ids) < len(had)
        if name == "exact_dedup":
            best = {}
            for i, t in had.items():
                h = hashlib.sha256("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode()).digest()
                best[h] = max(best.get(h, i), i)
            assert ids == set(best.values())
        if name == "ngram_jaccard_join":
            found = shingle_join.similar_components(before).select("doc_id", "component_id").collect()
            assert ids == {r.doc_id for r in found if r.doc_id == r.component_id}
        if name == "source_mixing":
            assert ids == set(had)
    out = {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()}
    assert out == {r.doc_id for r in kept["source_mixing"].collect()}


def test_decisions_reach_documents_without_id(spark, sf):
    text = " ".join(f"word{k}" for k in range(200))
    alone = " ".join(f"other{k}" for k in range(200))
    rows = [(5, text), (None, text + " more"), (None, alone), (None, alone + " more"), (None, "short"), (6, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()]
    # of near copies without doc_id one is kept
    assert sum(t in (alone, alone + " more") for _, t in left) == 1
    rest = [(i, t or "") for i, t in left if not (t or "").startswith("other")]
    assert sorted(rest, key=str) == sorted([(5, text), (None, "short"), (6, ""), (None, "")], key=str)

    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(None, f"before {item} after"), (None, "clean"), (1, f"again {item}"), (2, "clean too"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {tuple(r) for r in corpus_pipeline.decontamination(spark, docs, sf).collect()}
    assert left == {(None, "clean"), (2, "clean too"), (None, None)}


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = landed(stage(spark, docs, sf), name)
        assert docs.count() == 0


def test_a_stage_keeps_clashing_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"kept": F.lit(1), "n": F.lit("x"), "keep": F.lit(True)})
    model = quality.KEEP_ALL
    assert quality.scored(docs, model).columns[: len(docs.columns)] == docs.columns
    for name, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, sf).columns == docs.columns, name


def test_texts_reach_workers_in_small_batches(spark, sf, monkeypatch):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(setting)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    rows = spark.range(0, 4000, 1, 1).select(F.expr("repeat('some words ', 300)").alias("text"))
    with small_batches(spark):
        got = rows.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in got) == 4000 and max(r.size for r in got) < 3 << 20
    with pytest.raises(ZeroDivisionError), small_batches(spark):
        1 / 0
    assert spark.conf.get(setting) == was

    used = {}

    def spy(frame, name):
        used[name] = spark.conf.get(setting)
        return landed(frame, name)

    for module in (quality, exact_dedup, shingle_join, decontaminate):
        monkeypatch.setattr(module, "landed", spy)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        stage(spark, docs, sf)
        assert spark.conf.get(setting) == was
    assert {used[name] for name in ("features", "heads", "block-ranks", "shingle-sets", "listed", "leaks")} == {"2m"}
