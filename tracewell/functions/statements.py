"""Column functions that read a query statement.

Each regex is guarded by a plain substring test for a literal it needs, so most
statements never reach the regex engine. A guard cannot change a result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell import rules


def _guarded(statement: Column, literal: str, pattern: str) -> Column:
    return F.contains(F.lower(statement), F.lit(literal)) & statement.rlike(f"(?i){pattern}")


def wildcard_clauses(statement: Column) -> Column:
    """Array of (field, value), one per wildcard clause, in statement order."""
    pattern = f"(?i){rules.WILDCARD_CLAUSE}"
    hits = F.regexp_extract_all(statement, F.lit(pattern), F.lit(0))
    clauses = F.transform(
        hits,
        lambda hit: F.struct(
            F.regexp_extract(hit, pattern, 1).alias("field"),
            F.regexp_extract(hit, pattern, 2).alias("value"),
        ),
    )
    none = F.array().cast("array<struct<field:string,value:string>>")
    return F.when(F.contains(F.lower(statement), F.lit('"wildcard"')), clauses).otherwise(none)


def is_leading_wildcard(value: Column) -> Column:
    return value.rlike(rules.LEADING_WILDCARD)


def is_high_cardinality(cardinality: Column) -> Column:
    return cardinality > rules.HIGH_CARDINALITY


def is_trigram_candidate(field_type: Column, cardinality: Column) -> Column:
    return field_type.isin(*rules.TRIGRAM_TYPES) & (cardinality > rules.TRIGRAM_CARDINALITY)


def has_breaker_text(statement: Column) -> Column:
    """One of three fixed texts, in any case; needs no regex."""
    lowered = F.lower(statement)
    tests = [F.contains(lowered, F.lit(text.lower())) for text in rules.BREAKER_TEXTS]
    return tests[0] | tests[1] | tests[2]


def has_unbounded_terms(statement: Column) -> Column:
    """Some ``"terms": {`` whose next ``}`` comes before the next ``"size"``."""
    return F.contains(statement, F.lit('"terms"')) & statement.rlike(
        f"(?s){rules.UNBOUNDED_TERMS}"
    )


def nested_count(statement: Column) -> Column:
    return F.regexp_count(statement, F.lit(f"(?i){rules.NESTED_TOKEN}"))


def has_deep_nesting(statement: Column) -> Column:
    return nested_count(statement) >= rules.NESTED_MIN_COUNT


def has_script(statement: Column) -> Column:
    return _guarded(statement, '"script"', rules.SCRIPT_CLAUSE)


def has_regexp(statement: Column) -> Column:
    return _guarded(statement, '"regexp"', rules.REGEXP_CLAUSE)


def has_fuzzy(statement: Column) -> Column:
    """Optional detector, off by default in the diagnosis."""
    return _guarded(statement, '"fuzzy"', rules.FUZZY_CLAUSE)


def ns_to_ms(nanoseconds: Column) -> Column:
    return nanoseconds / F.lit(1_000_000)


def severity(anti_patterns: Column, avg_duration_ns: Column) -> Column:
    """Grade from the findings (array of structs with ``message``) and the mean duration."""
    ms, found = ns_to_ms(avg_duration_ns), F.size(anti_patterns)
    breaker = F.exists(anti_patterns, lambda f: F.contains(f["message"], F.lit(rules.BREAKER_MARK)))
    return (
        F.when(found == 0, "low")
        .when(breaker | (ms > rules.CRITICAL_MS), "critical")
        .when((ms > rules.HIGH_MS) | (found >= rules.HIGH_FINDINGS), "high")
        .when((ms > rules.MEDIUM_MS) | (found >= rules.MEDIUM_FINDINGS), "medium")
        .otherwise("low")
    )


def severity_rank(level: Column) -> Column:
    """0 for critical up to 3 for low."""
    return F.array_position(F.array(*map(F.lit, rules.SEVERITIES)), level) - 1


def fill(template: str, **values: Column) -> Column:
    """A text of ``rules`` with its ``{name}`` places filled from columns."""
    pieces, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        pieces += [F.lit(head), values[name].cast("string")]
    return F.concat(*pieces, F.lit(rest))


def finding(code: str, field: Column | None = None, **values: Column) -> Column:
    """One finding struct for a rule code."""
    if field is not None:
        values["field"] = field
    return F.struct(
        F.lit(code).alias("code"),
        (F.lit(None).cast("string") if field is None else field).alias("field"),
        fill(rules.MESSAGES[code], **values).alias("message"),
        fill(rules.SEARCH_HINTS[code], **values).alias("hint"),
    )
