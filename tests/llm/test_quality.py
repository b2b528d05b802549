"""The co-trained classifier: held-out accuracy, odd rows, bounds."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tracewell.llm import quality as q
from tracewell.llm.words import WordSlices


def test_logistic_fit():
    r = np.random.default_rng(1)
    x = r.normal(size=(4000, 2))
    y = (r.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))).astype(float)
    assert np.abs(q.fit_logistic(x, y, ridge=1e-3) - [2, -1, 0.5]).max() < 0.2


def test_text_features():
    texts = ["", None, "AB cd!! cd!!", "|", "é é é", "a" * 3_000_000]
    f = q.text_features(pa.array(texts), WordSlices())
    assert f.shape == (6, len(q.TEXT_FEATURES)) and np.isfinite(f).all() and (f[0] == f[1]).all()
    assert abs(f[2, 0] - 2 / 12) < 1e-9 and abs(f[2, 4] - 4 / 12) < 1e-9 and abs(f[2, 11] - 1 / 3) < 1e-9



def test_learns_from_few_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    few = labels.where("doc_id % 5 <> 0")
    model = q.train(docs, few, rounds=2, per_round=50)
    rest = q.scored(docs, model).join(labels.where("doc_id % 5 = 0"), "doc_id")
    right = rest.select(F.avg((F.col("quality_keep") == (F.col("quality") == 1)).cast("double"))).first()[0]
    clean = rest.where("quality = 1").select(F.avg(F.col("quality_keep").cast("double"))).first()[0]
    assert right > 0.97 and clean > 0.99
    assert all(0 <= r.quality_score <= 1 for r in rest.collect())


def test_without_labels_everything_stays(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for none in (labels.limit(0), labels.where("quality = 1")):
        model = q.train(docs, none)
        assert q.scored(docs, model).where("not quality_keep").isEmpty()


def test_odd_rows(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = q.train(docs, labels, rounds=1)
    rows = [(None, None, None, None, None), (1, "", "en", "src0", 0), (1, "", "en", "src0", 0), (2, "x " * 400_000, "zz", "new", -5)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    odd = odd.withColumns({"text_view": F.lit("x"), "good": F.lit(1)})
    out = q.scored(odd, model)
    assert out.columns[: len(odd.columns)] == odd.columns and out.count() == 4
    assert out.where("quality_score is null or quality_keep is null").isEmpty()
    assert q.scored(odd.limit(0), model).collect() == []
    assert q.train(docs.limit(0), labels) == q.KEEP_ALL


def test_a_task_holds_a_bounded_part_of_its_texts():
    docs = pa.RecordBatch.from_arrays([pa.array([f"some words {k} " * 100 for k in range(3000)])], ["text"])
    tracemalloc.start()
    rows = sum(out.num_rows for out in q._with_features("view")(iter([docs])))
    most = tracemalloc.get_traced_memory()[1] >> 20
    tracemalloc.stop()
    print(most)
    assert rows == 3000 and most < 45, most
