"""Suffix sorting and the removal of repeated passages against brute force."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

from tracewell.llm import suffix_dedup as sd
from tracewell.llm.suffix_sort import permuted_prefixes, suffix_array


@pytest.mark.parametrize("symbols", [1, 2, 3, 12])
def test_suffix_array(symbols):
    r = random.Random(symbols)
    for _ in range(80):
        t = [r.randrange(1, 1 + symbols) for _ in range(r.randrange(0, 70))] + [0]
        want = sorted(range(len(t)), key=lambda i: t[i:])
        order = suffix_array(np.array(t))
        assert order.tolist() == want
        before, shared = permuted_prefixes(np.array(t), order, 1 + len(t) // 4)
        for a, b in zip(want[1:], want[:-1], strict=True):
            n = 1 + len(t) // 4
            assert before[a] == b
            assert shared[a] == (len(t) - max(a, b) >= n and t[a : a + n] == t[b : b + n])


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    places = {}
    for k, (_, t) in enumerate(texts):
        for p in range(len(t) - length + 1):
            places.setdefault(t[p : p + length], []).append((k, p))
    gone = [np.zeros(len(t), bool) for _, t in texts]
    for found in places.values():
        if len(found) > 1:
            for k, p in found:
                gone[k][p : p + length] = True
    out = []
    for (i, t), g in zip(texts, gone, strict=True):
        kept = bytes(b for b, x in zip(t, g, strict=True) if not x)
        runs = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
        out.append((i, len(t), int(g.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, length, gram):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = sd.repeated_passages(docs, length, gram)
    for r in out.where("kept is not null").collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
    return sorted(map(tuple, out.drop("kept").collect()), key=str)


def corpus(seed, n=40):
    r = random.Random(seed)

    def letters(k, of="abcdefgh é"):
        return "".join(r.choice(of) for _ in range(k))

    passages = [letters(r.randrange(30, 200)) for _ in range(6)]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(r.randrange(0, 5)):
            p = r.choice(passages)
            a = r.randrange(len(p))
            text += r.choice([letters(r.randrange(120)), p, p[a:], p[: a + 1], "ab" * r.randrange(60), "z" * r.randrange(90)])
        rows.append((i, text))
    return rows + [(900, None), (901, ""), (902, rows[0][1]), (903, rows[0][1]), (904, rows[3][1])]


@pytest.mark.parametrize(("seed", "length", "gram"), [(1, 40, 8), (2, 40, 8), (3, 64, 16)])
def test_equals_brute_force(spark, seed, length, gram):
    rows = corpus(seed)
    assert run(spark, rows, length, gram) == brute(rows, length)


def test_given_documents(spark, sf):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    assert run(spark, rows, sd.LENGTH, sd.GRAM) == brute(rows, sd.LENGTH)


def test_large_shards_are_salted_and_carried(spark, monkeypatch):
    monkeypatch.setattr(sd, "SALT_ROWS", 5)
    monkeypatch.setattr(sd, "BATCH", 900)
    r = random.Random(9)
    base = "".join(r.choice("abcdefghij") for _ in range(400))
    rows = []
    for i in range(60):
        text = list(base)
        for _ in range(i % 4):
            text[r.randrange(len(text))] = r.choice("XYZ")
        rows.append((i, "".join(text)))
    assert run(spark, rows, 40, 8) == brute(rows, 40)


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    text = "0123456789" * 8 + "abcdefgh" * 9
    rows = [(None, text), (None, text), (5, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"tid": F.lit("x"), "h": F.lit(1)})
    out = sorted(map(tuple, sd.repeated_passages(docs, 40, 8).drop("kept").collect()), key=str)
    assert out == brute(rows, 40)


def test_empty_table(spark):
    assert run(spark, [], 40, 8) == []
