"""Approval ledger, action tally, workflow and cycle outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell import rules
from tracewell.functions.ledger import approval_id, is_decision


def change_requests(changes: DataFrame) -> DataFrame:
    """Add the approval id to (ts, action, target, payload, reason)."""
    return changes.select(
        approval_id(F.col("action"), F.col("target"), F.col("payload")).alias("approval_id"), "*"
    )


def pending_approvals(
    requests: DataFrame,
    decisions: DataFrame,
    as_of: str | None = None,
    timeout_seconds: int = rules.APPROVAL_TIMEOUT_SECONDS,
) -> DataFrame:
    """Requests still open: the newest per approval id, if no decision came at or after it.

    With ``as_of`` a request that has waited longer than the timeout is closed,
    as rejected; without it time stands still and none times out.

    An anti join written as one grouping over both tables: everything is merged
    before the shuffle, so an id that was asked or answered a million times
    sends one row per task.
    """
    columns = requests.columns
    asked = requests.select(
        "approval_id",
        F.struct(*columns).alias("request"),
        F.col("ts").alias("asked_ts"),
        F.lit(None).cast("timestamp").alias("answered_ts"),
    )
    answered = decisions.where(is_decision(F.col("decision"))).select(
        "approval_id",
        F.lit(None).cast(asked.schema["request"].dataType).alias("request"),
        F.lit(None).cast("timestamp").alias("asked_ts"),
        F.col("decision_ts").alias("answered_ts"),
    )
    # Equal ids carry equal action, target and payload; ties in time go by reason.
    tie = "request.reason" if "reason" in columns else "approval_id"
    state = (
        asked.unionByName(answered)
        .groupBy("approval_id")
        .agg(
            F.max_by("request", F.when(F.col("asked_ts").isNotNull(), F.struct("asked_ts", tie)))
            .alias("request"),
            F.max("answered_ts").alias("answered_ts"),
        )
    )
    still_open = F.col("answered_ts").isNull() | (F.col("answered_ts") < F.col("request.ts"))
    state = state.where(F.col("request").isNotNull() & still_open)
    if as_of is not None:
        limit = F.lit(as_of).cast("timestamp") - F.make_dt_interval(secs=F.lit(timeout_seconds))
        state = state.where(F.col("request.ts").cast("timestamp") >= limit)
    return state.select("request.*")


def resolve_approvals(
    requests: DataFrame,
    decisions: DataFrame,
    timeout_seconds: int = rules.APPROVAL_TIMEOUT_SECONDS,
) -> DataFrame:
    """Add ``outcome``: the first decision within the timeout, else ``rejected_timeout``.

    Each request looks ahead one timeout, so time is cut into slots of that
    length and a request asks only its own slot and the next. Requests and
    decisions of one (approval id, slot) are sorted together and the answer is
    read by a window: no pairs are formed, and an id in use for years is spread
    over its slots.
    """
    columns = requests.columns

    def slot(ts: str) -> Column:
        return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (timeout_seconds * 1_000_000))

    times = requests.select("approval_id", "ts").distinct()
    asked = times.select(
        "approval_id",
        slot("ts").alias("slot"),
        F.col("ts").cast("timestamp").alias("at"),
        F.lit(None).cast("string").alias("decision"),
        F.col("ts").alias("asked_ts"),
    )
    answered = (
        decisions.where(is_decision(F.col("decision")))
        # of equal ids and times one answer is enough
        .groupBy("approval_id", "decision_ts")
        .agg(F.min("decision").alias("decision"))
        .select(
            "approval_id",
            F.explode(F.array(slot("decision_ts"), slot("decision_ts") - 1)).alias("slot"),
            F.col("decision_ts").cast("timestamp").alias("at"),
            "decision",
            F.lit(None).cast(asked.schema["asked_ts"].dataType).alias("asked_ts"),
        )
    )
    # Newest first, so a frame that only grows holds all that is still to come.
    ahead = (
        Window.partitionBy("approval_id", "slot")
        .orderBy(F.col("at").desc())
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    answer = F.when(F.col("decision").isNotNull(), F.struct("at", "decision"))
    first = F.last(answer, ignorenulls=True).over(ahead)
    outcome_by_time = (
        asked.unionByName(answered)
        .withColumn("answer", first)
        .where(F.col("asked_ts").isNotNull())
        .select(
            "approval_id",
            F.col("asked_ts").alias("ts"),
            F.when(
                F.col("answer.at") <= F.col("at") + F.make_dt_interval(secs=F.lit(timeout_seconds)),
                F.col("answer.decision"),
            ).alias("outcome"),
        )
    )
    resolved = requests.join(outcome_by_time, ["approval_id", "ts"], "left")
    return resolved.select(
        *columns, F.coalesce("outcome", F.lit("rejected_timeout")).alias("outcome")
    )


def action_tally(actions: DataFrame) -> DataFrame:
    """Actions per tool and result."""
    return actions.groupBy("tool", "result_status").agg(F.count(F.lit(1)).alias("actions"))


def workflow_status(
    events: DataFrame,
    timeout_seconds: int = rules.WORKFLOW_TIMEOUT_SECONDS,
    as_of: str | None = None,
) -> DataFrame:
    """Final state of each three-step table rewrite from its step events.

    Step a must be ``applied``, b ``started``, a copy task that was started must
    be ``completed`` in time, and c ``applied``. Without a ``task`` event the
    wait is skipped; with ``as_of``, a copy that was started longer than the
    timeout before and has no ``task`` event has timed out, whatever followed.
    The newest event of a step counts.
    """
    def newest(step: str, wanted: str) -> Column:
        """Time of the newest event of a step, and in the last bit whether it is as wanted.

        One number per step keeps this a plain hash aggregate. Of equal times
        the wanted status counts.
        """
        ok = F.coalesce((F.col("status") == wanted).cast("bigint"), F.lit(0))
        at = F.unix_micros(F.col("event_ts").cast("timestamp"))
        return F.max(F.when(F.col("step") == step, at * 2 + ok))

    steps = (("a", "applied"), ("b", "started"), ("task", "completed"), ("c", "applied"))
    states = events.groupBy("workflow_id").agg(*(newest(s, ok).alias(s) for s, ok in steps))

    def failed(step: str) -> Column:
        return F.pmod(F.col(step), F.lit(2)) == 0

    def micros(step: str) -> Column:
        return F.shiftright(step, 1)

    waited = F.lit(False)
    if as_of is not None:
        now = F.unix_micros(F.lit(as_of).cast("timestamp"))
        waited = now - micros("b") > timeout_seconds * 1_000_000
    late = failed("task") | (micros("task") - micros("b") > timeout_seconds * 1_000_000)
    status = (
        F.when(F.col("a").isNull(), "incomplete")
        .when(failed("a"), "halted_at_step_a")
        .when(F.col("b").isNull(), "incomplete")
        .when(failed("b"), "halted_at_step_b")
        .when(F.col("task").isNotNull() & late, "reindex_timeout")
        .when(F.col("task").isNull() & waited, "reindex_timeout")
        .when(F.col("c").isNull(), "incomplete")
        .when(failed("c"), "halted_at_step_c")
        .otherwise("completed")
    )
    return states.select("workflow_id", status.alias("overall_status"))


def cycle_outcome(
    turns: DataFrame, max_rounds: int = rules.MAX_ROUNDS, tool_role: str = "assistant"
) -> DataFrame:
    """Per conversation: ``completed``, ``max_rounds_reached`` or ``running``.

    Turns of ``tool_role`` count as rounds; a last turn of that role ends the
    cycle unless the rounds were used up first.
    """
    is_tool = F.coalesce((F.col("role") == tool_role).cast("bigint"), F.lit(0))
    seen = turns.groupBy("conv_id").agg(
        F.count_if(F.col("role") == tool_role).alias("rounds"),
        # turn number, and in the last bit whose turn it was: a plain hash aggregate
        F.max(F.col("turn").cast("bigint") * 2 + is_tool).alias("last"),
    )
    status = (
        F.when(F.col("rounds") >= max_rounds, "max_rounds_reached")
        .when(F.pmod("last", F.lit(2)) == 1, "completed")
        .otherwise("running")
    )
    return seen.select("conv_id", "rounds", status.alias("status"))
