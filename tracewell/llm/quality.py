"""A quality classifier by co-training.

Two views describe a document: its text (shares of kinds of characters, word
lengths, repetition) and its metadata (source, language, length). A logistic
model per view learns from labelled documents. In each round every view scores
all unlabelled documents and hands its most confident ones, with the label it
gives them, to the other view's training set. At last both views are calibrated
on labelled documents held out, and the calibrated scores are combined into one
probability for every document.

Bounds: models are fitted on at most ``MAX_LABELLED`` labelled documents, chosen
by a digest of their id, and ``PER_ROUND`` pseudo-labels a class, view and round.
Scoring and the search for confident documents cover all rows.

Cases: null text is empty; null source, language and length are values of their
own; documents labelled more than once count as good only if all labels say so;
without labels of both classes everything is kept with probability 1. Repeated
rows get equal scores. ``scored`` keeps all columns and adds its own with a
``prefix``, to be chosen so that none is there already. An empty table gives an
empty result; a text of any length is read as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tracewell.llm.words import WordSlices
from tracewell.operators.sizes import landed, small_batches

MAX_LABELLED = 20_000
PER_ROUND = 500
ROUNDS = 3
CONFIDENT = 0.9
THRESHOLD = 0.2  # rejects what is clearly bad, in doubt a document stays
HASHED_SOURCES, HASHED_LANGS = 32, 8
SLICE = 1 << 18  # bytes of text that a task works on at once
TEXT_FEATURES = (
    "upper digit space ascii_punctuation shout pipe symbol non_ascii word_length words distinct repeated "
    "ends_in_mark lines upper_squared distinct_squared"
).split()
META_FEATURES = ["log_chars", "log_chars_squared", *(f"source_{i}" for i in range(HASHED_SOURCES)), *(f"lang_{i}" for i in range(HASHED_LANGS))]


def _members(chars: bytes) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[list(chars)] = 1
    return table


def text_features(column: pa.Array, cut: WordSlices) -> np.ndarray:
    """One row of TEXT_FEATURES per text."""
    kinds = [
        _members(bytes(range(65, 91))),
        _members(bytes(range(48, 58))),
        _members(b" \t\n\v\f\r"),
        _members(b".,;:'\"()-"),
        _members(b"!?"),
        _members(b"|"),
        _members(b"#$%&*@<>[]{}^_~=+/\\`"),
        _members(bytes(range(128, 192))),  # bytes that continue a character
    ]
    mark, line = _members(b".,;:!?|#$%&*"), _members(b"\n")
    out = []
    for s in cut.slices(column):
        f = np.zeros((s.n, len(TEXT_FEATURES)))
        size = np.maximum(np.diff(s.offsets), 1)

        def per_doc(values, at=s.offsets):
            total = np.concatenate(([0], np.cumsum(values)))
            return np.diff(total[at])

        for k, table in enumerate(kinds):
            f[:, k] = per_doc(table[s.data]) / size
        n = np.diff(s.word_of)
        some = np.maximum(n, 1)
        f[:, 8] = per_doc(s.end - s.start, s.word_of) / some / 10
        f[:, 9] = np.log1p(n) / 10
        # distinct words: sort by document and hash
        doc = np.repeat(np.arange(s.n), n)
        order = np.lexsort((s.hashes, doc))
        h, d = s.hashes[order], doc[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        f[:, 10] = np.bincount(d[first], minlength=s.n) / np.sqrt(some) / 20
        same = np.zeros(len(s.hashes), np.int64)
        same[1:] = (s.hashes[1:] == s.hashes[:-1]) & (doc[1:] == doc[:-1])
        f[:, 11] = np.bincount(doc, same, s.n) / some
        f[:, 12] = np.bincount(doc, mark[s.data[s.end - 1]], s.n) / some if len(doc) else 0
        f[:, 13] = per_doc(line[s.data]) / some
        f[:, 14] = f[:, 0] ** 2
        f[:, 15] = np.bincount(d[first], minlength=s.n) / some
        out.append(f)
    return np.concatenate(out) if out else np.zeros((0, len(TEXT_FEATURES)))


def _with_features(name: str):
    """Adds the text view of each row's ``text`` as an array column ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = WordSlices(most=SLICE)
        for batch in batches:
            f = text_features(batch.column(batch.schema.get_field_index("text")), cut)
            flat = pa.array(f.ravel(), pa.float64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1, dtype=np.int32) * f.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, name])

    return run


def _meta() -> list[Column]:
    """META_FEATURES of a row with source, lang and n_chars."""
    size = F.log1p(F.greatest(F.coalesce(F.col("n_chars"), F.lit(0)), F.lit(0)).cast("double")) / 10
    out = [size, size * size]
    for name, n in (("source", HASHED_SOURCES), ("lang", HASHED_LANGS)):
        bucket = F.pmod(F.xxhash64(F.coalesce(F.col(name).cast("string"), F.lit(""))), F.lit(n))
        out += [(bucket == i).cast("double") for i in range(n)]
    return out


@dataclass(frozen=True)
class Model:
    """Weights (the last one is the constant) of both views, and of their combination."""

    text: tuple[float, ...]
    meta: tuple[float, ...]
    combined: tuple[float, float, float]
    threshold: float = THRESHOLD

    @staticmethod
    def _dot(weights, column: str) -> Column:
        terms = (F.lit(float(w)) * F.col(column)[i] for i, w in enumerate(weights[:-1]))
        return reduce(add, terms, F.lit(float(weights[-1])))

    def scores(self, text: str, meta: str) -> tuple[Column, Column, Column]:
        """Log odds of the text view, of the metadata view, and combined."""
        a, b = self._dot(self.text, text), self._dot(self.meta, meta)
        wa, wb, c = self.combined
        return a, b, F.lit(wa) * a + F.lit(wb) * b + F.lit(c)


KEEP_ALL = Model((0.0,) * (len(TEXT_FEATURES) + 1), (0.0,) * (len(META_FEATURES) + 1), (0.0, 0.0, 50.0))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression by Newton's method, the constant last and not shrunk."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.ones(len(x)) if weight is None else weight
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + shrink * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(shrink)
        step = np.linalg.solve(curve, slope)
        step *= min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _logit(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def _pull(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_id, text view, meta view, good of a bounded number of rows."""
    table = rows.select("doc_id", "text_view", "meta_view", "good").toArrow()

    def matrix(name, width):
        return pc.list_flatten(table[name].combine_chunks()).to_numpy(zero_copy_only=False).reshape(-1, width)

    return (
        table["doc_id"].to_numpy(),
        matrix("text_view", len(TEXT_FEATURES)),
        matrix("meta_view", len(META_FEATURES)),
        table["good"].to_numpy().astype(float),
    )


def features(docs: DataFrame) -> DataFrame:
    """doc_id, text_view and meta_view of every row."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.array(*_meta()).alias("meta_view")
    )
    schema = "doc_id long, text string, meta_view array<double>, text_view array<double>"
    return rows.mapInArrow(_with_features("text_view"), schema).select("doc_id", "text_view", "meta_view")


def train(
    docs: DataFrame,
    labels: DataFrame,
    rounds: int = ROUNDS,
    per_round: int = PER_ROUND,
    max_labelled: int = MAX_LABELLED,
    threshold: float = THRESHOLD,
) -> Model:
    """Fit both views in turns on ``labels`` (doc_id, quality 0 or 1). Starts jobs."""
    marks = labels.where("quality is not null and doc_id is not null")
    marks = marks.groupBy("doc_id").agg(F.min("quality").cast("double").alias("good"))
    with small_batches(docs.sparkSession):
        seen = landed(features(docs), "features")
    order = F.xxhash64(F.lit("label"), F.col("doc_id"))
    labelled = seen.join(marks, "doc_id").orderBy(order, "doc_id").limit(max_labelled)
    ids, text, meta, good = _pull(labelled)
    if len(np.unique(good)) < 2:
        return KEEP_ALL
    held = np.arange(len(ids)) % 5 == 0  # the order is by digest, so every fifth is a fair sample
    if len(np.unique(good[held])) < 2 or len(np.unique(good[~held])) < 2:
        held = np.zeros(len(ids), bool)
    own = [(text[~held], good[~held]), (meta[~held], good[~held])]
    extra: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
    unlabelled = seen.join(marks.select("doc_id"), "doc_id", "left_anti")
    taken: list[int] = []
    for turn in range(rounds + 1):
        w = [
            fit_logistic(
                np.concatenate([x, *(e[0] for e in more)]),
                np.concatenate([y, *(e[1] for e in more)]),
                # pseudo-labels of all rounds together weigh no more than half the true ones
                np.concatenate([np.ones(len(y)), *(np.full(len(e[1]), min(1.0, len(y) / (2 * max(1, sum(len(z[1]) for z in more))))) for e in more)]),
            )
            for (x, y), more in zip(own, extra, strict=True)
        ]
        if turn == rounds:
            break
        model = Model(tuple(w[0]), tuple(w[1]), (1.0, 1.0, 0.0))
        scores = model.scores("text_view", "meta_view")[:2]
        sure = float(np.log(CONFIDENT / (1 - CONFIDENT)))
        fresh = unlabelled.where(~F.col("doc_id").isin(taken)) if taken else unlabelled
        for view, score in enumerate(scores):
            for label, by in ((1.0, score), (0.0, -score)):
                best = fresh.withColumn("by", by).where(F.col("by") >= sure)
                best = best.orderBy(F.desc("by"), "doc_id").limit(per_round).withColumn("good", F.lit(label))
                new_ids, new_text, new_meta, new_good = _pull(best)
                taken += new_ids.tolist()
                # what one view is sure of teaches the other
                extra[1 - view].append(((new_text, new_meta)[1 - view], new_good))
    # calibration and combination on labelled documents that no view has learnt from
    check = held if held.any() else np.ones(len(ids), bool)
    z = np.column_stack([_logit(w[0], text[check]), _logit(w[1], meta[check])])
    combined = fit_logistic(z, good[check], ridge=1e-3)
    combined[:2] = np.maximum(combined[:2], 0)
    return Model(tuple(w[0]), tuple(w[1]), tuple(map(float, combined)), threshold)


def scored(docs: DataFrame, model: Model, prefix: str = "quality_") -> DataFrame:
    """``docs`` with text_score, meta_score, score (probability) and keep, each with ``prefix``."""
    text, meta = f"__{prefix}text", f"__{prefix}meta"
    rows = docs.withColumn(meta, F.array(*_meta()))
    schema = StructType([*rows.schema.fields, StructField(text, ArrayType(DoubleType()))])
    rows = rows.mapInArrow(_with_features(text), schema)
    a, b, both = model.scores(text, meta)
    odds = float(np.log(model.threshold / (1 - model.threshold)))

    def chance(x):
        return 1 / (1 + F.exp(-x))

    return rows.select(
        *docs.columns,
        chance(a).alias(f"{prefix}text_score"),
        chance(b).alias(f"{prefix}meta_score"),
        chance(both).alias(f"{prefix}score"),
        (both >= odds).alias(f"{prefix}keep"),
    )
