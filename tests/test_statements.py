"""Detectors and severity on literal statements."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from tracewell import rules, schemas
from tracewell.functions import statements as st
from tracewell.operators import diagnosis
from tracewell.operators.telemetry import slowest_statements
from tracewell.plans.cycle import field_facts
from workload import queries

BREAKER_LONG = "CircuitBreakingException: [parent] Data too large, data for [<http_request>]"
BREAKER_SHORT = "circuit_breaking_exception: request rejected"
CLEAN = '{"query": {"match": {"message": "hello world"}}}'
TERMS = '{"aggs": {"by_user": {"terms": {"field": "user_id"}}}}'
TERMS_SIZED = '{"aggs": {"by_user": {"terms": {"field": "user_id", "size": 10}}}}'
NESTED_TWO = '{"query": {"nested": {"path": "a", "query": {"nested": {"path": "b"}}}}}'
NESTED_ONE = '{"query": {"nested": {"path": "a", "query": {"match_all": {}}}}}'
SCRIPT = '{"query": {"script": {"script": {"source": "doc[1].value > 5"}}}}'
REGEXP = '{"query": {"regexp": {"user_id": {"value": "kim.*"}}}}'


def wildcard(field, value):
    return '{"query": {"wildcard": {"%s": {"value": "%s"}}}}' % (field, value)


def diagnose(spark, rows, types=(), counts=()):
    """rows: (statement, ms); types and counts: (field, ...) of index ``logs``."""
    stats = spark.createDataFrame(
        [("logs", text, ms * 1e6, 200) for text, ms in rows],
        "index_name string, statement string, avg_duration double, count bigint",
    )
    known = spark.createDataFrame(
        [("logs", f, t) for f, t in types],
        "index_name string, field_name string, field_type string",
    )
    cards = spark.createDataFrame(
        [("logs", f, c) for f, c in counts],
        "index_name string, field_name string, cardinality bigint",
    )
    facts = diagnosis.measure_facts(known, cards)
    return diagnosis.order_findings(diagnosis.diagnose(stats, facts)).collect()


def one(spark, statement, ms=1, **kw):
    (row,) = diagnose(spark, [(statement, ms)], **kw)
    return row


def codes(row):
    return [item.code for item in row.anti_patterns]


WILDCARD_CASES = [
    (wildcard("user_id", "john*"), "keyword", 50_000, [rules.HIGH_CARD, rules.TRIGRAM]),
    (wildcard("message", "*error*"), "keyword", 50_000,
     [rules.LEADING, rules.HIGH_CARD, rules.TRIGRAM]),
    (wildcard("message", "?rror"), "text", 0, [rules.LEADING]),
    (wildcard("status", "act*"), "keyword", 10, []),
    (wildcard("body", "error*"), "text", 0, []),
    (wildcard("f", "a*"), "keyword", 1_000, []),
    (wildcard("f", "a*"), "keyword", 1_001, [rules.HIGH_CARD]),
    (wildcard("f", "a*"), "text", 10_000, [rules.HIGH_CARD]),
    (wildcard("f", "a*"), "text", 10_001, [rules.HIGH_CARD, rules.TRIGRAM]),
    (wildcard("f", "a*"), "wildcard", 10_001, [rules.HIGH_CARD]),
    # an extra key before "value" is taken for the field
    ('{"wildcard": {"user_id": {"boost": 1, "value": "k*"}}}', "keyword", 9, []),
]


def test_wildcard_rules(spark):
    """Every case is an index of its own, so all run at once and both ways."""
    names = [f"i{n}" for n in range(len(WILDCARD_CASES))]
    fields = [re.findall(rules.WILDCARD_CLAUSE, c[0], re.I)[0][0] for c in WILDCARD_CASES]
    triples = list(zip(names, fields, WILDCARD_CASES))
    stats = spark.createDataFrame(
        [(name, case[0]) for name, _, case in triples], "index_name string, statement string"
    )
    types = spark.createDataFrame(
        [(name, field, case[1]) for name, field, case in triples],
        "index_name string, field_name string, field_type string",
    )
    cards = spark.createDataFrame(
        [(name, field, case[2]) for name, field, case in triples],
        "index_name string, field_name string, cardinality bigint",
    )
    facts = diagnosis.measure_facts(types, cards)
    for facts.narrow in (True, False):
        got = {row.index_name: row for row in diagnosis.diagnose(stats, facts).collect()}
        for name, field, case in triples:
            assert codes(got[name]) == case[3], case
            assert got[name].affected_fields == [field]
            assert got[name].field_types == {field: case[1]}


def test_extra_key_is_taken_for_the_field(spark):
    row = one(spark, '{"wildcard": {"user_id": {"boost": 1, "value": "*k"}}}')
    assert row.affected_fields == ["boost"] and row.field_types == {"boost": "unknown"}
    assert one(spark, '{"wildcard": {"f": "*k"}}').affected_fields == []


TEXT_CASES = [
    (BREAKER_LONG, [rules.BREAKER]),
    (BREAKER_SHORT, [rules.BREAKER]),
    (CLEAN, []),
    (TERMS, [rules.UNBOUNDED]),
    (TERMS_SIZED, []),
    ('{"query": {"terms": {"user": ["kim"]}}}', [rules.UNBOUNDED]),
    ('{"aggs": {"a": {"terms": {"field": "x"}}}, "size": 3}', [rules.UNBOUNDED]),
    (NESTED_TWO, [rules.NESTING]),
    (NESTED_ONE, []),
    (SCRIPT, [rules.SCRIPT]),
    (REGEXP, [rules.REGEXP]),
    ('{"fuzzy": {"user": "ki"}}', []),
    ("", []),
]


def test_text_rules(spark):
    frame = spark.createDataFrame([(text,) for text, _ in TEXT_CASES], "statement string")
    rows = diagnosis.statement_detectors(frame).collect()
    assert [[i.code for i in row.text_findings] for row in rows] == [want for _, want in TEXT_CASES]


def test_texts_are_filled(spark):
    row = one(
        spark, wildcard("message", "*error*"), types=[("message", "text")], counts=[("message", 20_000)]
    )
    texts = [item.message for item in row.anti_patterns]
    assert texts[0].startswith("Leading wildcard '*error*' on field 'message' (type=text) prevents")
    assert "(~20000 unique values, type=text)" in texts[1]
    assert texts[2].startswith("Field 'message' is type 'text' with 20000 unique values.")
    assert one(spark, NESTED_TWO).anti_patterns[0].message.startswith("Query contains 2 nested")
    assert row.recommended_searches == sorted(set(item.hint for item in row.anti_patterns))


def test_optional_fuzzy(spark):
    rows = spark.createDataFrame([('{"fuzzy": {"user": "ki"}}',)], "statement string")
    (row,) = diagnosis.statement_detectors(rows, fuzzy=True).collect()
    assert [item.code for item in row.text_findings] == [rules.FUZZY]


@pytest.mark.parametrize(
    "found, ms, expected",
    [
        ([rules.BREAKER], 1, "critical"),
        (["x"], 15_000, "critical"),
        (["x"], 6_000, "high"),
        (["x", "y"], 3_000, "medium"),
        ([], 1, "low"),
        ([], 99_000, "low"),
        (["x"], 10_000, "high"),
        (["x"], 10_000.001, "critical"),
        (["x"], 5_000, "medium"),
        (["x"], 5_000.001, "high"),
        (["x"], 2_000, "low"),
        (["x"], 2_000.001, "medium"),
        (["x", "y"], 1, "medium"),
        (["x", "y", "z"], 1, "high"),
    ],
)
def test_severity(spark, found, ms, expected):
    items = [(code, None, rules.MESSAGES.get(code, code), "") for code in found]
    frame = spark.createDataFrame(
        [(items, ms * 1e6)], f"p array<{schemas.FINDING_ITEM.lower()}>, ns double"
    )
    assert frame.select(st.severity(F.col("p"), F.col("ns"))).head()[0] == expected


def test_breaker_word_in_a_value_is_critical_too(spark):
    row = one(spark, wildcard("f", "*CircuitBreakerException"))
    assert codes(row) == [rules.LEADING] and row.severity == "critical"


def test_order_and_empty_input(spark):
    rows = diagnose(
        spark,
        [(CLEAN, 1_000), (wildcard("user_id", "*x"), 9_000), (BREAKER_SHORT, 5), (REGEXP, 9_500)],
    )
    assert [row.severity for row in rows] == ["critical", "high", "high", "low"]
    assert [row.statement for row in rows][1] == REGEXP
    assert diagnose(spark, []) == []


def test_two_clauses_keep_their_order_and_fields(spark):
    text = wildcard("b", "*1") + wildcard("a", "?2") + wildcard("b", "3*")
    stats = spark.createDataFrame([("logs", text)], "index_name string, statement string")
    facts = spark.createDataFrame(
        [("logs", "a", "text", 0), ("logs", "b", "keyword", 2_000)],
        "index_name string, field string, field_type string, cardinality bigint",
    )
    row, same = (
        diagnosis.diagnose(stats, diagnosis.Facts(facts, True, narrow)).head()
        for narrow in (True, False)
    )
    assert row == same
    assert [(i.code, i.field) for i in row.anti_patterns] == [
        (rules.LEADING, "b"), (rules.HIGH_CARD, "b"), (rules.LEADING, "a"), (rules.HIGH_CARD, "b"),
    ]
    assert row.affected_fields == ["a", "b"]
    assert row.field_types == {"a": "text", "b": "keyword"}


def test_missing_columns_take_defaults(spark):
    cards = spark.createDataFrame([], "index_name string, field_name string, cardinality bigint")
    types = spark.createDataFrame([], "index_name string, field_name string, field_type string")
    stats = spark.createDataFrame([(None,)], "statement string")
    (row,) = diagnosis.diagnose(stats, diagnosis.measure_facts(types, cards)).collect()
    assert (row.statement, row.avg_duration, row["count"], row.raw_exception) == ("", 0.0, 0, "")


pieces = hs.sampled_from(
    ['"wildcard"', '"terms"', '"size"', '"value"', '"nested"', '"script"', '"regexp"', ":", " ", "{",
     "}", '"a"', '"*b"', ",", "[", "]", "\n", '"Terms"', '"WILDCARD"', "é"]
)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(hs.lists(hs.lists(pieces, max_size=25).map("".join), min_size=200, max_size=300))
def test_detectors_agree_with_python_regex(spark, texts):
    s = F.col("s")
    out = (
        spark.createDataFrame([(t,) for t in texts], "s string")
        .select(
            "s",
            st.wildcard_clauses(s).alias("clauses"),
            st.has_unbounded_terms(s).alias("unbounded"),
            st.nested_count(s).alias("nested"),
            st.has_script(s).alias("script"),
            st.has_regexp(s).alias("regexp"),
        )
        .collect()
    )
    for row in out:
        text = row.s
        assert [tuple(c) for c in row.clauses] == re.findall(rules.WILDCARD_CLAUSE, text, re.I)
        assert row.unbounded == bool(re.search(rules.UNBOUNDED_TERMS, text, re.S))
        assert row.nested == len(re.findall(rules.NESTED_TOKEN, text, re.I))
        assert row.script == bool(re.search(rules.SCRIPT_CLAUSE, text, re.I))
        assert row.regexp == bool(re.search(rules.REGEXP_CLAUSE, text, re.I))


def test_long_statement_does_not_overflow(spark):
    text = '{"aggs": {"terms": {' + "x" * 1_000_000
    frame = spark.createDataFrame([(text,), (text + "}",), (text + '"size"}',)], "s string")
    got = [r[0] for r in frame.select(st.has_unbounded_terms(F.col("s"))).collect()]
    assert got == [False, True, False]


def test_hot_statement_and_hot_field(spark):
    """A third of the log is one statement, and all clauses name one field."""
    log = spark.range(30_000).select(
        F.lit("2024-01-01").cast("timestamp").alias("ts"),
        F.lit("logs").alias("index_name"),
        F.when(F.col("id") % 3 == 0, F.lit(wildcard("f", "*hot"))).otherwise(
            F.concat(F.lit('{"wildcard": {"f": {"value": "v'), F.col("id") % 500, F.lit('*"}}}'))
        ).alias("statement"),
        (F.col("id") * 1000).alias("duration_ns"),
    )
    stats = slowest_statements(log, None, min_count=0, top_n=None, by=diagnosis.KEYS)
    types = spark.createDataFrame(
        [("logs", "f", "keyword", "2024-01-01"), ("logs", "f", "text", "2024-01-02")],
        "index_name string, field_name string, field_type string, refreshed_at string",
    )
    cards = spark.createDataFrame(
        [("logs", "f", 1_500)], "index_name string, field_name string, cardinality bigint"
    )
    rows = diagnosis.diagnose(stats, field_facts(types, cards)).collect()
    assert len(rows) == 501 and sum(row["count"] for row in rows) == 30_000
    assert all(row.field_types == {"f": "text"} for row in rows)
    assert sum(rules.LEADING in codes(row) for row in rows) == 1


def test_facts_are_measured(spark):
    types = spark.range(diagnosis.MAX_FIELDS_PER_INDEX + 1).selectExpr(
        "'wide' index_name", "concat('f', id) field_name", "'text' field_type"
    )
    cards = spark.createDataFrame(
        [("wide", "f7", 2_000), ("other", "g", 9)],
        "index_name string, field_name string, cardinality bigint",
    )
    facts = diagnosis.measure_facts(types, cards)
    assert (facts.small, facts.narrow) == (True, False)
    stats = spark.createDataFrame([("wide", wildcard("f7", "a*"))], "index_name string, statement string")
    (row,) = diagnosis.diagnose(stats, facts).collect()
    assert codes(row) == [rules.HIGH_CARD] and row.field_types == {"f7": "text"}
    assert diagnosis.measure_facts(types.limit(9), cards).narrow


def test_diagnosis_needs_one_shuffle_of_statements(spark, sf):
    """Clauses are gathered in the partitioning that the statement grouping made."""
    found = queries.findings(spark, sf)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    shuffles = re.findall(r"Exchange hashpartitioning\([^)]*statement#[^)]*\)", plan)
    assert len(shuffles) == 1
    assert "SortMergeJoin" not in plan and "Cartesian" not in plan
