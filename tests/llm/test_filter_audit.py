"""The filter audit against a plain loop, and its matrix against counts of words."""

import random
import re
from collections import Counter
from itertools import permutations

import duckdb
from pyspark.sql import functions as F

from tracewell.llm import filter_audit as fa

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def failed(rows):
    out = []
    for doc_id, text, lang in rows:
        text = text or ""
        words = WORD.findall(text)
        out.append(
            {
                "A": len(words) < 200,
                "B": 100 * len(set(words)) < 50 * len(words),
                "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
                "D": any(c in "#$%&*|" for c in text),
                "E": doc_id is not None
                and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows),
            }
        )
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    fails, out = failed(rows), {}
    for part in {lang or "" for *_, lang in rows}:
        mine = [(i, f) for (i, _, lang), f in zip(rows, fails, strict=True) if (lang or "") == part]
        worth = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [(i, f) for i, f in left if f[name]]
                left = [(i, f) for i, f in left if not f[name]]
                worth[name] += len(gone)
                out[part, "".join(order), step] = (
                    len(left),
                    len(gone),
                    sum(f[name] for _, f in mine) - len(gone),
                    sum(f[name] and sum(f.values()) == 1 for _, f in mine),
                    sum(i in good for i, _ in gone),
                    sum(i in toxic for i, _ in gone),
                )
        for key in [k for k in out if k[0] == part]:
            out[key] += (worth[key[1][key[2] - 1]],)
    return out


def run(spark, rows, labels, **more):
    docs = spark.createDataFrame(rows, DOCS).repartition(3).withColumns(more)
    names = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    found = fa.filter_interactions(docs, spark.createDataFrame(labels, LABELS))
    return {(r.part, r.filter_order, r.step): tuple(r[x] for x in names) for r in found.collect()}


def corpus():
    r = random.Random(3)
    rows, many = [], [f"w{i}é" for i in range(600)]
    for i in range(60):
        words = r.choices(many if r.random() < 0.6 else many[:20], k=r.choice([3, 150, 199, 200, 260, 900]))
        if r.random() < 0.3:
            words = [w.upper() for w in words]
        if r.random() < 0.2:
            words[r.randrange(len(words))] = r.choice(["a|b", "#", "50%", "R&D"])
        rows.append((i * 3 % 61, r.choice([" ", "\n", "\t ", "\x0b"]).join(words), r.choice(["en", "de", None, ""])))
    rows += [(100 + i, rows[i][1], "fr") for i in range(8)]  # copies in another part
    rows += [(200, None, "en"), (201, "", None), (None, rows[0][1], "en"), (None, None, None), (202, " \n", "en")]
    rows += [(203, "twice as a row", "en")] * 3 + [(204, "Twice as a row", "en")]
    rows.append((300, "word " * 300_000 + "END", "long"))
    labels = [(i, i % 2, i % 5 == 0) for i in range(0, 320, 2)] + [(3, 0, 0), (3, 1, None), (None, 1, 1), (9999, 1, 1)]
    return rows, [(i, q, int(t or 0)) for i, q, t in labels]


def test_equals_a_plain_loop(spark):
    rows, labels = corpus()
    clash = {x: F.lit("x") for x in ("part", "n", "failed", "words", "term_id", "digest", "quality")}
    assert run(spark, rows, labels, **clash) == brute(rows, labels)


def test_empty_tables(spark):
    assert run(spark, [], []) == {}
    out = run(spark, [(1, "a b", "en")], [])
    assert len(out) == 600 and out["en", "ABCDE", 1][:2] == (0, 1)


def test_matrix_counts_words(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40).repartition(4).cache()
    dictionary, shards = fa.document_term_shards(docs)
    words = {r.term_id: r.word for r in dictionary.collect()}
    assert sorted(words) == list(range(len(words))) and len(set(words.values())) == len(words)
    found = {}
    for s in shards.collect():
        for k, doc_id in enumerate(s.doc_id):
            cells = slice(s.indptr[k], s.indptr[k + 1])
            found[doc_id] = Counter(dict(zip((words[i] for i in s.indices[cells]), s.data[cells], strict=True)))
    assert found == {r.doc_id: Counter(WORD.findall(r.text or "")) for r in docs.collect()}


def test_query_on_given_tables(spark, sf):
    rows = duckdb.sql(f"SELECT doc_id, text, lang FROM '{sf}/documents.parquet'").fetchall()
    labels = duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{sf}/labels.parquet'").fetchall()
    assert run(spark, rows, labels) == brute(rows, labels)
