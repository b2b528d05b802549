"""The Merkle manifest against a plain tree."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tracewell.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def tree(nodes, fanout):
    """(top, a list of (left, right) siblings for each node)."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            a = i - i % fanout
            steps[k].append(("".join(nodes[a:i]), "".join(nodes[i + 1 : a + fanout])))
        nodes = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return nodes[0], steps


def brute(rows, claims, fanout):
    by_source = {}
    for row, claim in zip(rows, claims, strict=True):
        by_source.setdefault(row[1], []).append((row, leaf(row), leaf((*row[:4], claim))))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    tops, paths = [], {}
    for s in sources:
        by_source[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1], x[2]))
        top, paths[s] = tree([x[1] for x in by_source[s]], fanout)
        tops.append(top)
    root, over = tree(tops, fanout)
    out = []
    for s, subroot, more in zip(sources, tops, over, strict=True):
        for (row, own, node), path in zip(by_source[s], paths[s], strict=True):
            for left, right in path + more:
                node = h(left, node, right)
            out.append((str(row[0]), own, subroot, root, h(*(x for step in path + more for x in step)), node))
    return sorted(out)


def run(spark, rows, claimed=None, fanout=3, **more):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns(more)
    found = merkle.manifest(docs, claimed, fanout)
    proof = F.sha2(F.lower(F.hex(merkle.proof_bytes(F.col("path")))), 256)
    hexes = [F.lower(F.hex(x)) for x in ("leaf", "subroot", "root")]
    node = F.lower(F.hex(merkle.folded(F.col("claimed_leaf"), F.col("path"))))
    return sorted((str(r[0]), *tuple(r)[1:]) for r in found.select("doc_id", *hexes, proof, node).collect())


def struck():
    return F.replace(F.col("text"), F.lit("\n"), F.lit(""))


def corpus(n, seed=1):
    r = random.Random(seed)
    sources = ["b", "a", "é", "", None, "a:b", "z"]
    rows = []
    for i in range(n):
        source = r.choice(sources[:6]) if r.random() < 0.6 else "b"
        text = r.choice([None, "", f"line {i}\nnext", "one line", "é\n" * r.randrange(5)])
        rows.append((i * 7 % 1009, source, r.choice(["en", None]), r.choice([None, i]), text))
    rows += [(5000, "z", None, None, "alone in its source\n"), (None, "a", "en", 1, "no id\n"), (None, None, None, None, None)]
    rows += [(6000, "a", "en", 3, "twice\n")] * 2 + [(6000, "a", "en", 3, "other")]
    return rows


@pytest.mark.parametrize("fanout", [2, 3])
def test_equals_a_plain_tree(spark, fanout):
    rows = corpus(90 if fanout == 2 else 300)
    claims = [None if r[4] is None else r[4].replace("\n", "") for r in rows]
    clash = {x: F.lit(1) for x in ("g", "idx", "size", "h", "slot", "path", "position", "leaf", "root")}
    assert run(spark, rows, struck(), fanout, **clash) == brute(rows, claims, fanout)


def test_sources_of_all_shapes(spark):
    sizes = [1, 2, 3, 4, 9, 10, 27, 28, 82]
    rows = [(i, f"s{n}", "en", i, f"text {i}") for n in sizes for i in range(n)]
    out = run(spark, rows)
    assert out == brute(rows, [r[4] for r in rows], 3)
    assert all(r[3] == r[5] for r in out)  # what is as it was folds to the root


def test_lone_row_and_empty_table(spark):
    row = (1, None, None, None, None)
    assert run(spark, [row]) == [("1", leaf(row), leaf(row), leaf(row), h(""), leaf(row))]
    assert run(spark, []) == []


def test_very_long_text_and_one_huge_source(spark):
    rows = [(i, "s" if i else "t", "en", i, "x" * 5) for i in range(3000)] + [(9000, "t", "en", 1, "long\n" * 400_000)]
    out = run(spark, rows, struck())
    assert out == brute(rows, [r[4].replace("\n", "") for r in rows], 3)


def test_query(spark, sf):
    from tracewell.llm.queries import op12_merkle_manifest

    out = op12_merkle_manifest(spark, sf).collect()
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(out) == len(rows) and len({r["root"] for r in out}) == 1
    for r in out:
        hit = zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and "\n" in (rows[r["doc_id"]] or "")
        assert r["verified"] == (not hit) == (r["folded_root"] == r["root"])
