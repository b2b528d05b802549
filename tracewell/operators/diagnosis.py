"""Findings per statement: detectors, lookups, severity, order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import rules, schemas
from tracewell.functions import statements as st
from tracewell.operators.sizes import MAX_BROADCAST_ROWS, landed

KEYS = ("index_name", "statement")
MAX_FIELDS_PER_INDEX = 5_000  # a map is searched from its start
ITEM = schemas.FINDING_ITEM.lower()


def _with_defaults(stats: DataFrame) -> DataFrame:
    columns = set(stats.columns)

    def column(name: str, kind: str, default):
        value = F.col(name).cast(kind) if name in columns else F.lit(None).cast(kind)
        return F.coalesce(value, F.lit(default).cast(kind)).alias(name)

    return stats.select(
        column("index_name", "string", ""),
        column("statement", "string", ""),
        column("avg_duration", "double", 0.0),
        column("count", "bigint", 0),
    )


def wildcard_clauses(stats: DataFrame, keep_all: bool = False) -> DataFrame:
    """One row per wildcard clause: (..., clause, field, value, is_leading).

    ``keep_all`` keeps statements without one, with nulls in the new columns.
    """
    explode = F.posexplode_outer if keep_all else F.posexplode
    clauses = stats.select("*", explode(st.wildcard_clauses(F.col("statement"))).alias("clause", "c"))
    return clauses.select(
        *stats.columns,
        "clause",
        "c.field",
        "c.value",
        st.is_leading_wildcard(F.col("c.value")).alias("is_leading"),
    )


def field_facts(catalog: DataFrame, cardinality: DataFrame) -> DataFrame:
    """(index_name, field, field_type, cardinality); what is not known is ``unknown`` and 0.

    ``catalog`` and ``cardinality`` hold one row per (index_name, field_name).
    """
    types = catalog.select("index_name", F.col("field_name").alias("field"), "field_type")
    counts = cardinality.select("index_name", F.col("field_name").alias("field"), "cardinality")
    both = types.join(counts, ["index_name", "field"], "full_outer")
    # a fact without a name can match no clause, and a map has no key for it
    return both.where("index_name is not null and field is not null").select(
        "index_name",
        "field",
        F.coalesce("field_type", F.lit(rules.UNKNOWN_TYPE)).alias("field_type"),
        F.coalesce("cardinality", F.lit(0).cast("bigint")).alias("cardinality"),
    )


@dataclass
class Facts:
    """Field facts with what was measured about them."""

    rows: DataFrame
    small: bool  # few enough rows in all to broadcast
    narrow: bool  # few enough fields in each index to look up in one map per index


def measure_facts(catalog: DataFrame, cardinality: DataFrame) -> Facts:
    """Compute the field facts once and measure them. Starts jobs."""
    rows = landed(field_facts(catalog, cardinality), "field-facts")
    per_index = rows.groupBy("index_name").agg(F.count(F.lit(1)).alias("fields"))
    seen = per_index.agg(F.sum("fields").alias("all"), F.max("fields").alias("widest")).head()
    return Facts(
        rows, (seen.all or 0) <= MAX_BROADCAST_ROWS, (seen.widest or 0) <= MAX_FIELDS_PER_INDEX
    )


def with_facts(clauses: DataFrame, facts: DataFrame) -> DataFrame:
    """Add field type and cardinality to clause rows.

    Facts that were measured to be small may carry a broadcast hint; else both
    sides are shuffled and AQE splits a hot (index, field) of the clause side.
    """
    joined = clauses.join(facts, ["index_name", "field"], "left")
    return joined.withColumns(
        {
            "field_type": F.coalesce("field_type", F.lit(rules.UNKNOWN_TYPE)),
            "cardinality": F.coalesce("cardinality", F.lit(0).cast("bigint")),
        }
    )


def wildcard_items(clause: Callable[[str], Column] = F.col) -> Column:
    """Findings of one clause, in rule order, from its value, field, type and cardinality."""
    field, value = clause("field"), clause("value")
    kind, cardinality = clause("field_type"), clause("cardinality")
    items = F.array(
        F.when(
            st.is_leading_wildcard(value), st.finding(rules.LEADING, field, value=value, type=kind)
        ),
        F.when(
            st.is_high_cardinality(cardinality),
            st.finding(rules.HIGH_CARD, field, cardinality=cardinality, type=kind),
        ),
        F.when(
            st.is_trigram_candidate(kind, cardinality),
            st.finding(rules.TRIGRAM, field, cardinality=cardinality, type=kind),
        ),
    )
    return F.array_compact(items)


def wildcard_findings(stats: DataFrame, facts: DataFrame) -> DataFrame:
    """One row per wildcard finding, with the facts it rests on."""
    known = with_facts(wildcard_clauses(_with_defaults(stats)), facts)
    return known.select("*", F.explode(wildcard_items()).alias("item")).select(
        *KEYS, "clause", "field", "value", "field_type", "cardinality", "item.code", "item.message"
    )


def statement_items(fuzzy: bool = False) -> Column:
    """Findings that need the text only, in rule order."""
    text = F.col("statement")
    tests = [
        (st.has_breaker_text(text), st.finding(rules.BREAKER)),
        (st.has_unbounded_terms(text), st.finding(rules.UNBOUNDED)),
        (st.has_deep_nesting(text), st.finding(rules.NESTING, count=st.nested_count(text))),
        (st.has_script(text), st.finding(rules.SCRIPT)),
        (st.has_regexp(text), st.finding(rules.REGEXP)),
    ]
    if fuzzy:
        tests.append((st.has_fuzzy(text), st.finding(rules.FUZZY)))
    # no higher-order function here: those fall out of generated code
    none = F.array().cast(f"array<{ITEM}>")
    return F.concat(*(F.when(test, F.array(item)).otherwise(none) for test, item in tests))


def statement_detectors(statements: DataFrame, fuzzy: bool = False) -> DataFrame:
    """Add the array ``text_findings`` from the text-only detectors."""
    return statements.withColumn("text_findings", statement_items(fuzzy))


def _clauses_by_map(stats: DataFrame, facts: Facts) -> DataFrame:
    """Add ``clauses``: each wildcard clause with its findings, looked up in place.

    The facts of an index travel as one map, so statements are neither exploded
    nor gathered again.
    """
    entry = F.struct("field", F.struct("field_type", "cardinality"))
    per_index = facts.rows.groupBy("index_name").agg(
        # bounded: a wide index takes the other way
        F.map_from_entries(F.collect_list(entry)).alias("known")
    )
    if facts.small:
        per_index = F.broadcast(per_index)

    def look_up(clause: Column) -> Column:
        return F.struct(
            clause["field"].alias("field"),
            clause["value"].alias("value"),
            F.try_element_at("known", clause["field"]).alias("fact"),
        )

    def grade(clause: Column) -> Column:
        facts_of = {
            "field": clause["field"],
            "value": clause["value"],
            "field_type": F.coalesce(clause["fact"]["field_type"], F.lit(rules.UNKNOWN_TYPE)),
            "cardinality": F.coalesce(clause["fact"]["cardinality"], F.lit(0).cast("bigint")),
        }
        return F.struct(
            clause["field"].alias("field"),
            facts_of["field_type"].alias("field_type"),
            wildcard_items(facts_of.__getitem__).alias("items"),
        )

    clauses = st.wildcard_clauses(F.col("statement"))
    return stats.join(per_index, "index_name", "left").select(
        *stats.columns, F.transform(F.transform(clauses, look_up), grade).alias("clauses")
    )


def _clauses_by_join(stats: DataFrame, facts: Facts) -> DataFrame:
    """The same by one row per clause, for indices with very many fields."""
    rows = wildcard_clauses(stats, keep_all=True)
    known = with_facts(rows, F.broadcast(facts.rows) if facts.small else facts.rows)
    clause = F.when(
        F.col("clause").isNotNull(),
        F.struct("clause", "field", "field_type", wildcard_items().alias("items")),
    )
    return known.groupBy(*stats.columns).agg(
        # bounded by the clauses of one statement; nulls are not collected
        F.array_sort(F.collect_list(clause)).alias("clauses")
    )


def diagnose(stats: DataFrame, facts: Facts, fuzzy: bool = False) -> DataFrame:
    """Grade every statement: findings, fields, severity, searches.

    ``stats`` holds one row per (index_name, statement), as ``slowest_statements``
    gives with those keys; ``facts`` comes from ``measure_facts``.
    """
    stats = _with_defaults(stats)
    gathered = _clauses_by_map(stats, facts) if facts.narrow else _clauses_by_join(stats, facts)
    found = gathered.withColumn(
        "anti_patterns",
        F.concat(F.flatten(F.col("clauses.items")), statement_items(fuzzy)).cast(f"array<{ITEM}>"),
    )
    return found.select(
        *KEYS,
        "avg_duration",
        "count",
        "anti_patterns",
        F.sort_array(F.array_distinct("clauses.field")).alias("affected_fields"),
        # one type per (index, field), so equal fields carry equal types
        F.map_from_entries(
            F.array_distinct(
                F.transform("clauses", lambda c: F.struct(c["field"], c["field_type"]))
            )
        ).alias("field_types"),
        st.severity(F.col("anti_patterns"), F.col("avg_duration")).alias("severity"),
        F.sort_array(F.array_distinct("anti_patterns.hint")).alias("recommended_searches"),
        F.lit("").alias("raw_exception"),
    )


def report_order() -> list:
    """Critical first, then the slowest mean; ties by statement."""
    rank = st.severity_rank(F.col("severity"))
    return [rank, F.col("avg_duration").desc(), "statement", "index_name"]


def order_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*report_order())


def severity_summary(findings: DataFrame) -> DataFrame:
    return findings.agg(
        F.count(F.lit(1)).alias("findings_count"),
        F.count_if(F.col("severity") == "critical").alias("critical_count"),
        F.count_if(F.col("severity") == "high").alias("high_count"),
    )


def recommended_searches(findings: DataFrame) -> DataFrame:
    """Distinct follow-up searches over all findings."""
    return findings.select(F.explode("recommended_searches").alias("search")).distinct()
