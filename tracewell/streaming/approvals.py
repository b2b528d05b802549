"""One outcome per approval request, from keyed state with timers.

Requests and decisions are one stream of events by approval id. A request is
answered by its earliest decision within the timeout, or by the timeout. Its
outcome is given as soon as no earlier decision can come: when the watermark has
passed the decision, or the deadline. Nothing is kept for an id after that.

Ids share their state and its timer in ``BUCKETS`` groups, since a call to Python
per id would cost a hundred times what it does. Any state store will do.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewell import rules
from tracewell.functions.ledger import is_decision
from tracewell.operators.ledger import resolve_approvals

DELAY = "10 minutes"
TIMEOUT = "rejected_timeout"
OPEN = "open"
BUCKETS = 512  # a checkpoint is bound to it
NEVER = -(1 << 63)  # the time of a request that has none: out at once, as a timeout

_STATE = (
    "asked_ids array<string>, asked array<long>, payloads array<string>, "
    "said_ids array<string>, said array<long>, decisions array<string>"
)
_OUTCOME = "approval_id string, at long, payload string, decision_at long, outcome string"


def _outcomes(timeout_seconds: int):
    timeout = timeout_seconds * 1_000_000

    def settled(key, asked: set, said: set, past: int) -> tuple[list, list, list, list]:
        """Rows that are certain at the watermark, what is kept of each kind, and when to look again."""
        rows, left, calls = [], [], []
        answers = sorted(said) if key is not None else []  # an id that is null is nobody's
        for ts, payload in sorted(asked, key=lambda x: (x[0], x[1] or "")):
            first = bisect_left(answers, (ts,))
            answered = first < len(answers) and answers[first][0] <= ts + timeout
            at, outcome = answers[first] if answered else (ts + timeout, TIMEOUT)
            if at <= past:
                rows.append((key, ts, payload, at if answered else None, outcome))
            else:
                left.append((key, ts, payload))
                calls.append(at)
        # a decision may come before its request, but not before one that is late already
        oldest = min([ts for _, ts, _ in left], default=past + 1)
        kept = [(key, *x) for x in said if x[0] >= min(oldest, past + 1)]
        calls += [at for _, at, _ in kept if not left]
        return rows, left, kept, calls

    def run(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        asked, said = defaultdict(set), defaultdict(set)
        if state.exists:
            columns = state.get
            for x, part in ((asked, columns[:3]), (said, columns[3:])):
                for key, at, what in zip(*part, strict=True):
                    x[key].add((at, what))
        if state.hasTimedOut:
            frames = ()
        for frame in frames:
            columns = (frame[c] for c in ("approval_id", "at", "payload", "decision"))
            for key, at, payload, decision in zip(*columns, strict=True):
                key = key if isinstance(key, str) else None
                if isinstance(decision, str):
                    said[key].add((at, decision))
                else:
                    asked[key].add((at, payload if isinstance(payload, str) else None))
        past = state.getCurrentWatermarkMs() * 1000  # no event up to here is still to come
        rows, left, kept, calls = [], [], [], []
        for key in asked.keys() | said.keys():
            found = settled(key, asked.get(key, set()), said.get(key, set()), past)
            for every, some in zip((rows, left, kept, calls), found, strict=True):
                every += some
        if left or kept:
            columns = [list(c) for part in (left, kept) for c in (zip(*part) if part else ((), (), ()))]
            state.update(tuple(columns))
            state.setTimeoutTimestamp(-(-min(calls) // 1000) + 1)
        elif state.exists:
            state.remove()
        if rows:
            frame = pd.DataFrame(rows, columns=["approval_id", "at", "payload", "decision_at", "outcome"])
            yield frame.astype({"decision_at": "Int64"})

    return run


def approval_outcomes(
    requests: DataFrame,
    decisions: DataFrame,
    timeout_seconds: int = rules.APPROVAL_TIMEOUT_SECONDS,
    delay: str = DELAY,
) -> DataFrame:
    """(approval_id, ts, payload, decision_ts, outcome): a stream with one row per distinct request.

    ``requests`` (approval_id, ts, payload) and ``decisions`` (approval_id,
    decision_ts, decision) are streams with TIMESTAMP columns. Answers that are no
    decision, and decisions without a time, count for nothing; of decisions at one
    time the first by name does. A null id is answered by nobody.
    """
    none = F.lit(None).cast("string")
    asked = requests.select("approval_id", "ts", "payload", none.alias("decision"))
    said = decisions.where(is_decision(F.col("decision")) & F.col("approval_id").isNotNull() & F.col("decision_ts").isNotNull())
    said = said.select("approval_id", F.col("decision_ts").alias("ts"), none.alias("payload"), "decision")
    # a watermark of its own each: the slower stream holds back both
    events = asked.withWatermark("ts", delay).unionByName(said.withWatermark("ts", delay))
    bucket = F.pmod(F.xxhash64("approval_id"), F.lit(BUCKETS)).alias("bucket")
    events = events.select(bucket, "ts", F.coalesce(F.unix_micros("ts"), F.lit(NEVER)).alias("at"), "approval_id", "payload", "decision")
    outcomes = events.groupBy("bucket").applyInPandasWithState(
        _outcomes(timeout_seconds), _OUTCOME, _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    return outcomes.select(
        "approval_id",
        F.timestamp_micros(F.nullif(F.col("at"), F.lit(NEVER))).alias("ts"),
        "payload",
        F.timestamp_micros("decision_at").alias("decision_ts"),
        "outcome",
    )


def with_open_requests(
    outcomes: DataFrame,
    requests: DataFrame,
    decisions: DataFrame,
    as_of: Column,
    timeout_seconds: int = rules.APPROVAL_TIMEOUT_SECONDS,
) -> DataFrame:
    """Landed ``outcomes`` and, with ``final`` false, the requests that have none yet.

    These are given as they stand at ``as_of``: the first decision in time so far,
    ``rejected_timeout`` if it is too late for one, else ``open``.
    """
    keys = ["approval_id", "ts", "payload"]
    done = outcomes.select(*(F.col(k).alias(f"_{k}") for k in keys))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    rest = requests.select(*keys).distinct().join(done, same, "left_anti")
    rest = resolve_approvals(rest, decisions.where(F.col("decision_ts") <= as_of), timeout_seconds)
    too_late = F.col("ts") + F.make_dt_interval(secs=F.lit(timeout_seconds)) <= as_of
    outcome = F.when((F.col("outcome") == TIMEOUT) & ~too_late, OPEN).otherwise(F.col("outcome"))
    rest = rest.select(*keys, outcome.alias("outcome"), F.lit(False).alias("final"))
    return outcomes.select(*keys, "outcome", F.lit(True).alias("final")).unionByName(rest)
