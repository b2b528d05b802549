"""Decontamination: exact edit distances, planted passages, brute force over the given tables."""

import random
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewell.llm import decontaminate as dc


def closest(pattern, text):
    """Least edits of pattern to any substring of text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def between(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_edit_match_is_exact():
    r = random.Random(2)
    for _ in range(400):
        a = bytes(r.choice(b"abc") for _ in range(r.randint(1, 70)))
        t = bytes(r.choice(b"abc") for _ in range(r.randint(0, 90)))
        edits, start, end = dc.edit_match(a, t, len(a))
        assert edits == closest(a, t) == between(a, t[start:end])
        if edits:
            assert dc.edit_match(a, t, edits - 1) is None


def test_cgk_keeps_equal_texts_equal_and_near_ones_near():
    texts, lengths = dc.padded([b"the quick brown fox", b"the quick brown fox", b"the quick browm fox", b"zzzzz zz zzzzzzzzzz"])
    out = dc.cgk(texts, lengths, 40, 1)
    assert (out[:, 0] == out[:, 1]).all()
    assert (out[:, 0] == out[:, 2]).mean() > (out[:, 0] == out[:, 3]).mean()


def words(r, k):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(k))


def edited(r, text, n):
    text = list(text)
    for _ in range(n):
        k = r.randrange(len(text))
        text[k] = r.choice(["", "xy", "q", " "])
    return "".join(text)


@pytest.fixture(scope="module")
def planted():
    r = random.Random(6)
    items = [(i, words(r, r.randint(12, 50))) for i in range(40)]
    rows, inside = [], {}
    for i, text in items:
        for share in (0.0, 0.02, 0.05):
            changed = edited(r, text.upper() if share == 0.0 else text, int(share * len(text)))
            inside[len(rows)] = i
            rows.append((len(rows), f"{words(r, r.randint(0, 60))}. {changed}\n{words(r, r.randint(0, 60))}"))
    rows += [(len(rows) + k, words(r, 120)) for k in range(60)]
    return items, rows, inside


def run(spark, items, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return dc.benchmark_matches(docs, bench, **more).collect()


def test_planted_passages(spark, planted):
    items, rows, inside = planted
    out = run(spark, items, rows)
    got = {(m.doc_id, m.item_id) for m in out}
    assert got <= set(inside.items())  # nothing clean is found
    exact = {(k, i) for k, i in inside.items() if k % 3 == 0}
    plain = {k: dc.plain(t) for k, t in rows}
    within = {
        (k, i) for k, i in inside.items()
        if closest(dc.plain(items[i][1]), plain[k]) <= int(dc.MAX_EDITS * len(dc.plain(items[i][1])))
    }
    assert exact <= got <= within and len(got) >= 0.95 * len(within)
    text = dict(rows)
    for m in out:
        if m.edits == 0:
            part = text[m.doc_id][m.start_char : m.end_char]
            assert dc.plain(part) == dc.plain(items[m.item_id][1])
        assert m.edits <= dc.MAX_EDITS * m.item_length


def random_edits(r, text, n):
    text = list(text)
    for _ in range(n):
        k = r.randrange(len(text))
        text[k : k + r.choice([0, 1, 1])] = r.choice(["", "q", "e", "t"])
    return "".join(text)


@pytest.mark.parametrize("share", [0.10, 0.15])
@pytest.mark.parametrize("least,most", [(12, 40), (2, 5)])
def test_recall_of_passages_edited_everywhere(spark, share, least, most):
    r = random.Random(9)
    items = [(i, words(r, r.randint(least, most))) for i in range(120)]
    rows = []
    for i, text in items:
        # many verbatim copies: the words that the edited copy has lost are the item's rarest
        rows += [(i, f"{words(r, 9)}. {text}. {words(r, 9)}")] * 25
        rows.append((1000 + i, f"{words(r, 9)}. {random_edits(r, text, int(share * len(text)))}. {words(r, 9)}"))
    plain = {k: dc.plain(t) for k, t in rows}
    within = set()
    for i, text in items:
        if closest(dc.plain(text), plain[1000 + i]) <= int(dc.MAX_EDITS * len(dc.plain(text))):
            within.add((1000 + i, i))
    got = {(m.doc_id, m.item_id) for m in run(spark, items, rows)}
    assert {(i, i) for i, _ in items} <= got
    assert len(within) > 100 and len(got & within) >= 0.95 * len(within), (len(got & within), len(within))


def test_words_that_the_corpus_has_not_are_no_anchors(spark):
    words_of_item = [(h, h * 8, h * 8 + 7) for h in range(1, 30)]
    counts = {h: 30 for h in range(12, 30)}
    chosen = dc._anchors(words_of_item, counts, 20, 29 * 8, 30, 0.02)
    assert chosen and {h for h, *_ in chosen} <= set(counts)
    assert dc._anchors(words_of_item, {}, 20, 29 * 8, 30, 0.02) == ()


def test_blocks_of_items_give_the_same(spark, planted, monkeypatch):
    items, rows, _ = planted
    want = sorted(map(tuple, run(spark, items, rows)))
    monkeypatch.setattr(dc, "BLOCK_ITEMS", 15)
    got = sorted(map(tuple, run(spark, items, rows)))
    exact = [m for m in want if m[4] == 0]
    assert [m for m in got if m[4] == 0] == exact and len(got) >= 0.95 * len(want)


def test_given_tables(spark, sf):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    got = {(m.doc_id, m.item_id) for m in run(spark, items, docs)}
    plain = [(i, b" " + dc.plain(t) + b" ") for i, t in docs]
    bench = [(i, b" " + dc.plain(t) + b" ") for i, t in items]
    exact = {(d, i) for d, t in plain for i, b in bench if b in t}
    assert exact <= got
    near = {x for x in got - exact}
    for d, i in near:
        pattern = dict(bench)[i].strip()
        assert closest(pattern, dict(plain)[d]) <= dc.MAX_EDITS * len(pattern)


def test_odd_rows(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, None), (2, ""), (3, item), (3, item), (None, item.upper()), (4, "... " + item.replace(" ", ",\n")), (5, "one")]
    items = [(1, item), (2, item), (3, None), (4, ""), (5, "?!"), (None, item)]
    got = sorted(((m.doc_id or 0), m.item_id, m.edits) for m in run(spark, items, rows))
    assert got == [(d, i, 0) for d in (0, 3, 3, 4) for i in (1, 2)] or sorted(set(got)) == [(d, i, 0) for d in (0, 3, 4) for i in (1, 2)]
    assert run(spark, [], rows) == [] and run(spark, items, []) == []
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    left = dc.decontaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.where("doc_id is not null").collect()) == [1, 2, 5]


def test_members():
    wanted = np.array([5, 9, 1 << 40], np.uint64)
    at, which = dc._Members(wanted).of(np.array([9, 7, 1 << 40, 9 + (1 << 20)], np.uint64))
    assert at.tolist() == [0, 2] and which.tolist() == [1, 2]


def test_a_count_holds_a_bounded_part_of_its_texts(planted):
    items, rows, _ = planted
    docs = pa.RecordBatch.from_arrays([pa.array([t for _, t in rows] * 40)], ["text"])
    wanted = np.array(sorted({w[0] for _, t in items for w in dc._item_words(dc.plain(t))}), np.uint64)
    tracemalloc.start()
    rows = sum(out.num_rows for out in dc._anchor_counts(wanted)(iter([docs])))
    most = tracemalloc.get_traced_memory()[1] >> 20
    tracemalloc.stop()
    assert rows > 1 and most < 40, most
