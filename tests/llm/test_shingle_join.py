"""The n-gram Jaccard join against brute force."""

import random
import re
import time
import tracemalloc
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tracewell.llm import shingle_join as sj

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [shingles(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((doc_id, len(sets[i]), least[find(i)]) for i, (doc_id, _) in enumerate(rows))


def run(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name, value in more.items():
        docs = docs.withColumn(name, value)
    out = sj.similar_components(docs).select("doc_id", "n_shingles", "component_id").collect()
    return sorted(map(tuple, out))


def edited(random, words, n):
    words = list(words)
    for _ in range(n):
        words[random.randrange(len(words))] = f"x{random.randrange(10**6)}"
    return words


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, common = [], " ".join(r.choices(vocabulary, k=25))
    for base in range(12):
        words = r.choices(vocabulary, k=r.choice([3, 6, 9, 12, 16, 24, 60, 150]))
        for _ in range(r.choice([1, 2, 6, 12])):
            text = " ".join(edited(r, words, r.randrange(0, 3)))
            if r.random() < 0.3:
                text = common + "\n" + text
            if r.random() < 0.2:
                text = text.upper()
            rows.append((len(rows) * 7 % 1009, text))
    # short sets of like words: sizes 1 to 14 that differ at an end
    line = [f"s{i}" for i in range(40)]
    for n in range(1, 19):
        for cut in range(3):
            rows.append((2000 + len(rows), " ".join(line[cut : cut + n])))
    rows += [(5000, None), (5001, ""), (5002, " \n "), (5003, rows[0][1]), (5004, rows[0][1].upper())]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)


def test_given_documents(spark, sf):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    assert run(spark, rows) == brute(rows)


def test_a_large_group_of_near_copies(spark):
    r = random.Random(5)
    base = [f"w{r.randrange(5000)}" for _ in range(130)]
    rows = [(i, " ".join(edited(r, base, 1 + i % 3))) for i in range(1, 200)] + [(300, " ".join(base))]
    rows += [(400 + i, f"the same common line stands here in all of them {i} {i * 7} own {i * 3}") for i in range(60)]
    assert run(spark, rows) == brute(rows)


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    text = "one two three four five six seven eight nine ten"
    rows = [(3, text), (3, text), (None, text), (9, text + " eleven"), (None, "alone words only here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumns({"n": F.lit("x"), "sid": F.lit(1), "component_id": F.lit(5)})
    out = {tuple(r) for r in sj.similar_components(docs).select("doc_id", "n_shingles", "component_id").collect()}
    assert out == {(3, 6, 3), (None, 6, 3), (9, 7, 3), (None, 1, None)}


def test_rows_without_doc_id_link_and_connect(spark):
    words = [f"w{i}" for i in range(60)]

    def text(a, b):
        return " ".join(words[a:b])

    # 1 and 2 are unlike each other and both like the row without doc_id
    rows = [(1, text(0, 44)), (None, text(3, 50)), (2, text(10, 54)), (None, "x " + text(50, 60)), (None, text(50, 60) + " y")]
    rows += [(None, text(3, 50))] * 40
    assert set(run(spark, rows[:1] + rows[2:3])) == {(1, 40, 1), (2, 40, 2)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = [tuple(r) for r in sj.similar_components(docs).select("doc_id", "n_shingles", "component_id").collect()]
    assert {r for r in out if r[0]} == {(1, 40, 1), (2, 40, 1)}
    assert out.count((None, 43, 1)) == 41 and out.count((None, 7, None)) == 2


def test_different_texts_of_one_doc_id_or_none_are_joined_apart(spark):
    def text(name, a, b):
        return " ".join(f"{name}{i}" for i in range(a, b))

    # per name two like texts; the first of each pair shares its doc_id, or has none
    rows = [(5, text(f"g{k}x", 0, 44)) for k in range(4)] + [(10 + k - 8 * (k % 2), text(f"g{k}x", 3, 47)) for k in range(4)]
    assert run(spark, rows) == brute(rows)
    nameless = [(None, text(f"h{k}x", 0, 44)) for k in range(12)] + [(20 + k, text(f"h{k}x", 3, 47)) for k in range(12)]
    docs = spark.createDataFrame(rows + nameless, "doc_id long, text string")
    out = sj.similar_components(docs).select("doc_id", "n_shingles", "component_id", "checked_links").collect()
    assert sorted(r[:3] for r in out if r[0] and r[0] < 20) == brute(rows)
    assert sorted(r[2] for r in out if r[0] is None) == sorted(r[2] for r in out if r[0] and r[0] >= 20) == list(range(20, 32))
    assert all(r[3] == 1 for r in out)


def test_a_shared_template_makes_no_pairs(spark):
    """60 common and 12 own words, similarity 0.70: listed common shingles lie too far back to meet."""
    made = []
    for n in (300, 1200):
        rows = [(i, " ".join([f"own{i}x{k}" for k in range(12)] + [f"t{k}" for k in range(60)])) for i in range(n)]
        entries = []
        for i, text in rows:
            own = sorted(shingles(text), key=lambda s: (all(w[0] == "t" for w in s), s))
            entries += [((zlib.crc32(repr(s).encode()) << 1), i, len(own), place, i) for place, s in enumerate(own[: sj.listed(len(own))])]
        met = sj.meeting(spark.createDataFrame(entries, "key long, sid long, n int, place int, part long"))
        other = met.selectExpr("key", "own as other", "other as own", "sid as sid_a")
        made.append(met.join(other, ["key", "own", "other"]).where("sid < sid_a").count())
    assert made == [0, 0]
    assert all(c == i for i, _, c in run(spark, rows[:300]))


def test_empty_table(spark):
    assert run(spark, []) == []


def test_very_long_text(spark):
    words = [f"a{i}" for i in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-9000])), (3, " ".join(words[:20_000]))]
    assert run(spark, rows) == [(1, 59_996, 1), (2, 50_996, 1), (3, 19_996, 3)]


def test_boundary_is_where_costs_cross():
    sizes = {n: 100 for n in range(1, 40)}
    assert sj.choose_boundary(sizes, 1000.0) > sj.choose_boundary(sizes, 3.0)
    assert sj.overlap(8, 8) == 7 and sj.listed(8) == 3
    for n in range(1, 60):
        for m in range(n, 60):
            need = next(i for i in range(n + 1) if 7 * i >= 3 * (n + m)) if 7 * n >= 3 * (n + m) else None
            if need is not None:
                assert sj.overlap(n, m) == need and need >= m - sj.listed(m) + 1


def test_tasks_hold_little_at_once():
    words = np.random.default_rng(5).integers(0, 10**6, (6000, 300)).astype(str)
    texts = pa.array([" ".join(row) for row in words])
    ids = pa.array(range(len(texts)))
    docs = pa.RecordBatch.from_arrays([ids, ids, texts], ["doc_id", "text_hash", "text"])
    pairs = pa.RecordBatch.from_arrays([ids, ids, texts, texts], ["a", "b", "text_a", "text_b"])
    entries = sj._entries(sj.Plan(np.empty(0, np.uint64), np.empty(0, np.uint64), 0), 8)
    for step, batch in ((sj._describe, docs), (entries, docs), (sj._similar, pairs)):
        tracemalloc.start()
        rows = sum(out.num_rows for out in step(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows and most < 64 << 20, (step, most >> 20)


def test_shuffles_go_with_the_job_that_needed_them(spark):
    def held():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().iterator()
        names = set()
        while blocks.hasNext():
            names.add(blocks.next().name())
        return {name for name in names if name.startswith("shuffle_")}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = held(), spark.conf.get(setting)
    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{words} {i}") for i in range(40)], "doc_id long, text string")
    found = sj.similar_components(docs)
    until = time.time() + 30  # files are deleted by another thread
    while held() - before and time.time() < until:
        time.sleep(0.2)
    assert not held() - before
    assert spark.conf.get(setting) == was
    assert {(r.component_id, r.n_shingles) for r in found.collect()} == {(0, 57)}


def test_only_texts_of_pairs_are_written(spark, monkeypatch):
    written, landed = [], sj.landed

    def watched(rows, name):
        out = landed(rows, name)
        if "text" in out.columns:
            written.append(out.count())
        return out

    monkeypatch.setattr(sj, "landed", watched)
    words = [f"s{i}" for i in range(8)]
    texts = [" ".join(words + [f"d{k}w{i}" for i in range(100)]) for k in range(30)]
    texts += [texts[0] + " more", texts[0] + " more"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.component_id for r in sj.similar_components(docs).collect()}
    assert out == {i: 0 if i >= 30 else i for i in range(32)}
    assert sum(written) <= 4
