"""Water-filling against a plain loop, and what documents give."""

import random

import pytest

from tracewell.llm import mixing


def fill(sizes):
    """Targets by clamping and sharing again until none is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = sum(w for s, w in weight.items() if s not in capped)
        left = total - sum(3 * sizes[s] for s in capped)
        target = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / free for s in names}
        above = {s for s in names if s not in capped and target[s] > 3 * sizes[s]}
        if not above:
            return target
        capped |= above


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_words(spark, seed):
    r = random.Random(seed)
    names = ["b", "a", "é", "z", "Z", "", None, "10", "9"]
    rows = [(i, r.choice(names[: 3 + 2 * seed]), "w " * int(r.paretovariate(0.7))) for i in range(300)]
    rows += [(1000, "tiny", "one\x0btwo three"), (1001, "none", None), (1002, "none", " \n ")]
    out = mixing.mixture(frame(spark, rows)).collect()
    sizes = {}
    for _, s, t in rows:
        n = len([w for w in (t or "").replace("\x0b", " ").replace("\n", " ").split(" ") if w])
        sizes[s] = sizes.get(s, 0) + n
    want = fill(sizes)
    taken = {}
    for row in out:
        assert row.source_size == sizes[row.source] and abs(row.target - want[row.source]) < 1e-5
        assert 0 <= row.taken <= 3 * row.size
        taken[row.source] = taken.get(row.source, 0) + row.taken
    assert len(out) == len(rows)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.mixture(frame(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_empty_and_repeated(spark):
    assert mixing.mixture(frame(spark, [])).collect() == []
    out = mixing.mixture(frame(spark, [(1, "a", "x y"), (1, "a", "x y"), (None, None, "z")])).collect()
    assert sum(r.taken for r in out if r.source == "a") == round(out[0].target if out[0].source == "a" else out[-1].target)
    assert len(out) == 3
