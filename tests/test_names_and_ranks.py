"""Templates through the index of literal pieces, and ranks in two scans, against plain loops."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.functions import text as tx
from tracewell.operators import ranking, rewrite

TEMPLATES = "template_name string, patterns array<string>, priority int"


def plain_match(names, templates):
    """The best template of every name, each pattern tried on each name."""
    out = {}
    for name in {n for n in names if n is not None}:
        best = None
        for template, patterns, priority in templates:
            for pattern in patterns or []:
                if pattern is None:
                    continue
                regex = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern)
                if re.fullmatch(regex, name, re.S):
                    best = max(best or (-1, "", ""), (priority, template, pattern))
        if best:
            out[name] = (best[1], best[2], best[0])
    return out


def matched(spark, names, templates):
    found = rewrite.match_templates(
        spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(templates, TEMPLATES)
    ).collect()
    assert len({r.name for r in found}) == len(found)
    return {r.name: (r.template_name, r.pattern, r.priority) for r in found}


def test_every_pattern_on_every_name(spark):
    rng = random.Random(4)
    words = ["logs", "web", "a", "b.c", "eu-west", "über", "x^y", "2024", "metrics[1]", "\\d", "日本", "a\n"]
    names = ["-".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(400)] + ["", "a", "ab", None, "a", "end\n"]
    templates = []
    for i in range(120):
        pattern = list(rng.choice([n for n in names if n]))
        for _ in range(rng.randint(0, 3)):
            pattern[rng.randrange(len(pattern))] = rng.choice(["*", "?", "**", "*?"])
        templates.append((f"t{i % 40}", ["".join(pattern), rng.choice(["web-*", "nowhere*", "*-2024"])], rng.randint(0, 9)))
    assert matched(spark, names, templates) == plain_match(names, templates)


def test_patterns_of_wildcards_alone(spark):
    names = ["", "a", "ab", "abc", "abcd", "日本語"]
    templates = [("none", [""], 9), ("one", ["?"], 5), ("two up", ["?*?", "*??"], 3), ("three", ["???"], 4), ("all", ["*"], 0)]
    assert matched(spark, names, templates) == plain_match(names, templates)


def test_ties_and_repeats(spark):
    names = ["x-1"] * 500 + ["x-2"]
    templates = [("b", ["x-*", "x-?"], 1), ("b", ["x-*"], 1), ("a", ["x-?"], 1), ("b", None, 7), ("c", [None], 8)]
    assert matched(spark, names, templates) == plain_match(names, templates)
    assert matched(spark, names, templates)["x-1"] == ("b", "x-?", 1)


def test_no_names_or_templates(spark):
    assert matched(spark, [], [("a", ["*", "x*"], 1)]) == {}
    assert matched(spark, ["x"], []) == {}
    assert matched(spark, ["x"], [("a", [], 1)]) == {}


def test_a_name_meets_few_patterns(spark):
    """Thousands of patterns share their beginning and their end: names still meet their own alone."""
    names = spark.range(6000).select(F.format_string("logs-app%05d-prod", "id").alias("name"))
    templates = spark.range(6000).select(
        F.format_string("t%05d", "id").alias("template_name"),
        F.array(F.format_string("*-app%05d-*", "id")).alias("patterns"),
        F.lit(1).alias("priority"),
    )
    patterns = templates.select("template_name", F.explode("patterns").alias("pattern"))
    patterns = ranking.numbered_rows(patterns, "pattern", name="id").withColumn("pieces", tx.glob_pieces(F.col("pattern")))
    keyed = rewrite._under_rarest_gram(names, rewrite._with_grams(patterns), [8], True)
    pairs = rewrite._grams_of_names(names, [8]).join(keyed, "gram").count()
    assert 6000 <= pairs <= 6000 * 100  # of 36 million
    out = rewrite.match_templates(names, templates)
    assert out.where("substring(template_name, 2) = substring(name, 9, 5)").count() == 6000
    assert "CartesianProduct" not in out._jdf.queryExecution().executedPlan().toString()


# --- ranks -------------------------------------------------------------------


def test_magnitude_never_falls(spark):
    values = sorted({0.0, 5e-324, 1e-308, 1.0, 1.5, 1e300, 1.7e308, math.inf, *(np.random.default_rng(1).lognormal(0, 90, 2000))})
    values = [-v for v in reversed(values) if v] + values + [math.nan]
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    places = [r.m for r in rows.select("i", ranking.magnitude(F.col("v")).alias("m")).orderBy("i").collect()]
    assert places == sorted(places) and places[-1] > places[-2]


GROUPS = {
    "crowded": 1e6 + np.random.default_rng(2).random(4000),
    "below": -np.random.default_rng(3).lognormal(2, 3, 3000),
    "ends": np.array([math.inf, -math.inf, 0.0, -0.0, 1.0, math.inf, 2.0]),
    "no numbers": np.array([math.nan, math.nan, 3.0]),
    "near": 1.0 + np.arange(500) * 2.0**-52,
    "copies": np.repeat([4.0, 4.01, 4.02], [900, 60, 40]),
    "one": np.array([5.0]),
    None: np.random.default_rng(4).integers(0, 500, 2500).astype(float),
}


@pytest.mark.parametrize("crowded", [30, 100_000])
@pytest.mark.parametrize("share", [0.0, 0.5, 0.95, 1.0])
def test_ranks_of_hard_groups(spark, monkeypatch, crowded, share):
    monkeypatch.setattr(ranking, "CROWDED", crowded)
    data = [(k, float(v)) for k, values in GROUPS.items() for v in values] + [("one", None), ("none", None)]
    rows = spark.createDataFrame(data, "k string, v double").repartition(7)
    got = {r.k: r for r in ranking.nearest_rank(rows, ["k"], "v", share).collect()}
    assert got.keys() == GROUPS.keys()
    for k, values in GROUPS.items():
        want = np.sort(values)[min(len(values) - 1, math.floor(len(values) * share))]
        assert got[k].ranked == want or math.isnan(got[k].ranked) and math.isnan(want), k
        assert got[k].rows == len(values)
        for mine, numpy in ((got[k].least, np.sort(values)[0]), (got[k].most, np.sort(values)[-1])):
            assert mine == numpy or math.isnan(mine) and math.isnan(numpy), k


def test_ranks_without_keys_or_rows(spark):
    rows = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    assert ranking.nearest_rank(rows, [], "v", 0.95).head().ranked == 950
    assert ranking.nearest_rank(rows.limit(0), [], "v", 0.95).collect() == []
    assert ranking.nearest_rank(rows.where("v < 0").withColumn("k", F.lit(1)), ["k"], "v", 0.5).collect() == []
