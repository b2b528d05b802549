"""Block naming: names decide by content; small blocks give many levels."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tracewell.llm import exact_dedup as ed


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    keep, size = {}, {}
    for i, t in rows:
        t = low(t)
        size[t] = size.get(t, 0) + 1
        if i is not None:
            keep[t] = max(keep.get(t, i), i)
    return sorted(
        ((i, keep.get(low(t)), size[low(t)], i == keep.get(low(t)), hashlib.sha256(low(t).encode()).hexdigest()) for i, t in rows),
        key=str,
    )


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


ROWS = [
    (1, "Same Text " * 9),
    (2, "same text " * 9),
    (3, "same text " * 8 + "same texts"),
    (4, None),
    (5, ""),
    (6, "é"),
    (7, "É"),
    (8, "x" * 640),
    (9, "X" * 640),
    (10, "x" * 641),
    (11, "x" * 1279),
    (12, "short"),
    (13, "short"),
    (13, "short"),
    (None, "short"),
    (None, "alone"),
]


@pytest.mark.parametrize("block", [16, 64, 4096])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ed, "BLOCK_BYTES", block)
    out = ed.exact_duplicates(frame(spark, ROWS)).drop("doc_hash", "raw_hash").collect()
    assert sorted(map(tuple, out), key=str) == brute(ROWS)


def test_hot_blocks_and_hash_collisions(spark, monkeypatch):
    rows = [(i, "hot text " * 30) for i in range(150)] + [(200 + i, f"text {i % 7}") for i in range(40)]
    monkeypatch.setattr(ed, "HOT_COUNT", 20)
    for digest in (ed._hash, lambda block: len(block) % 2):
        monkeypatch.setattr(ed, "_hash", digest)
        out = ed.exact_duplicates(frame(spark, rows)).drop("doc_hash", "raw_hash").collect()
        assert sorted(map(tuple, out), key=str) == brute(rows)


def test_deduplicated_keeps_columns_and_one_row(spark):
    docs = frame(spark, ROWS).withColumns({"kept": F.lit("mine"), "group_size": F.lit(2), "h": F.lit(0), "name": F.lit("n")})
    out = ed.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 2, 3, 5, 6, 7, 9, 10, 11, 13]
    assert {r.kept for r in out.collect()} == {"mine"}


def test_empty_table(spark):
    assert ed.exact_duplicates(frame(spark, [])).collect() == []
    assert ed.deduplicated(frame(spark, [])).collect() == []
