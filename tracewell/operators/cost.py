"""Month-to-date cost and the rule that gates proposed actions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import rules


def node_cost(nodes: Column | int = 1, rate: float = rules.NODE_MONTHLY_RATE) -> Column:
    """Monthly cost of ``nodes`` more nodes."""
    count = nodes if isinstance(nodes, Column) else F.lit(nodes)
    return count * F.lit(float(rate))


def month_to_date(
    lines: DataFrame, as_of: date | str, since: date | str | None = None
) -> DataFrame:
    """Cost so far this month and its 30-day projection, per provider and currency.

    The range is [first of month, as_of). Every provider seen in ``lines`` gets
    a row, so on the first of a month all sums are 0. Providers are looked for
    from ``since`` on (no later than the first of the month); this reaches the
    scan, where without it all of history is read for the keys.
    """
    day = F.lit(as_of).cast("date")
    if since is not None:
        start = F.least(F.lit(since).cast("date"), F.trunc(day, "month"))
        lines = lines.where(F.col("usage_date") >= start)
    in_range = (F.col("usage_date") >= F.trunc(day, "month")) & (F.col("usage_date") < day)
    spent = F.coalesce(F.sum(F.when(in_range, F.col("amount"))), F.lit(0.0))
    return (
        lines.groupBy("provider", "currency")
        .agg(spent.alias("month_to_date_cost"))
        .withColumn(
            "projected_monthly_cost",
            F.col("month_to_date_cost") / F.dayofmonth(day) * rules.DAYS_PER_MONTH,
        )
    )


def cost_decisions(
    actions: DataFrame, rate: float = rules.NODE_MONTHLY_RATE, action: str = "action"
) -> DataFrame:
    """Add the cost decision to a table of proposed actions, row by row.

    The price list has five fixed entries, so it is part of the expression and
    there is no join.
    """
    name, scale = F.col(action), node_cost(1, rate)
    free = name.isin(*rules.FREE_ACTIONS)
    scaling = name.isin(*rules.SCALING_ACTIONS)
    cost = F.when(scaling, scale).otherwise(F.lit(0.0))
    reason = (
        F.when(free, F.format_string(rules.REASON_FREE, name, cost, scale, scale - cost))
        .when(scaling, F.format_string(rules.REASON_SCALING, scale))
        .otherwise(F.format_string(rules.REASON_OTHER, name))
    )
    return actions.withColumns(
        {
            "proceed": ~F.coalesce(scaling, F.lit(False)),
            "reason": reason,
            "cost_of_action_monthly": cost,
            "cost_of_scaling_monthly": scale,
            "projected_monthly_savings": scale - cost,
        }
    )
