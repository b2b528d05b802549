"""Findings as text for a reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import rules
from tracewell.functions.statements import ns_to_ms
from tracewell.operators.diagnosis import order_findings, report_order
from tracewell.operators.ranking import numbered_rows


def _lines(head: str, items: Column) -> Column:
    """``head`` and one line per item, or an empty array when there is none."""
    none = F.array().cast("array<string>")
    return F.when(F.size(items) > 0, F.concat(F.array(F.lit(head)), items)).otherwise(none)


def finding_text(findings: DataFrame, statement_chars: int | None = None) -> DataFrame:
    """Add ``body``: the block of one finding without its number. Works row by row.

    ``statement_chars`` cuts the statement for display; None shows all of it.
    """
    statement = F.col("statement")
    if statement_chars is not None:
        statement = F.substring(statement, 1, statement_chars)
    facts = F.concat(
        F.lit("    Avg Duration: "),
        F.format_string("%.1f", ns_to_ms(F.col("avg_duration"))),
        F.lit("ms | Count: "),
        F.col("count").cast("string"),
        F.lit(" | Severity: "),
        F.upper("severity"),
    )
    patterns = F.transform(
        "anti_patterns", lambda item: F.concat(F.lit("      - "), item["message"])
    )
    fields = F.concat(
        F.lit("    Affected Fields: "), F.array_join("affected_fields", ", ")
    )
    types = F.transform(
        F.map_entries("field_types"),
        lambda e: F.concat(F.lit("      "), e["key"], F.lit(" → type: "), e["value"]),
    )
    searches = F.transform(
        "recommended_searches", lambda s: F.concat(F.lit('      - "'), s, F.lit('"'))
    )
    body = F.concat(
        F.array(
            F.concat(F.lit("Statement: "), statement),
            facts,
        ),
        _lines("    Anti-Patterns Detected:", patterns),
        F.when(F.size("affected_fields") > 0, F.concat(F.array(fields), types)).otherwise(
            F.array().cast("array<string>")
        ),
        _lines("    Recommended Knowledge Tool Queries:", searches),
    )
    return findings.withColumn("body", F.array_join(body, "\n"))


def finding_report(
    findings: DataFrame, top_n: int | None = None, statement_chars: int | None = None
) -> DataFrame:
    """All findings, or the ``top_n`` worst, numbered in report order: (position, text). Starts jobs."""
    worst = order_findings(findings)
    if top_n is not None:
        worst = worst.limit(top_n)
    numbered = numbered_rows(finding_text(worst, statement_chars), *report_order(), name="position")
    head = F.concat(F.lit("\n["), F.col("position").cast("string"), F.lit("] "))
    return numbered.select("position", F.concat(head, F.col("body")).alias("text"))


def report_document(
    findings: DataFrame, top_n: int = rules.TOP_STATEMENTS, statement_chars: int | None = None
) -> DataFrame:
    """The ``top_n`` worst findings as one text: (report, summary); none gives a fixed sentence.

    One row must hold it, so ``top_n`` bounds it; ``finding_report`` has them all.
    """
    blocks = finding_report(findings, top_n, statement_chars).agg(
        F.array_sort(F.collect_list(F.struct("position", "text"))).alias("blocks")
    )
    report = F.when(F.size("blocks") == 0, rules.EMPTY_REPORT).otherwise(
        F.concat_ws("\n", F.lit(rules.REPORT_HEAD), F.col("blocks.text"))
    )
    return blocks.select(report.alias("report")).withColumn(
        "summary", F.substring("report", 1, rules.REPORT_SUMMARY_CHARS)
    )
