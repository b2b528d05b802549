"""Column functions of the approval ledger."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tracewell.functions.text import strip_whitespace

# --- Fixed values: id length and accepted answers -------------------------
APPROVAL_ID_CHARS = 12
YES_ANSWERS = ("yes", "y")
DECISIONS = ("approved", "rejected")


@F.pandas_udf(StringType())
def canonical_payload(payload: pd.Series) -> pd.Series:
    """JSON text with sorted keys, for ingest. No built-in writes this spacing."""
    return payload.map(
        lambda text: None if text is None else json.dumps(json.loads(text), sort_keys=True)
    )


def approval_id(action: Column, target: Column, payload: Column) -> Column:
    """Short digest of a change; time and reason are left out, so equal changes share it."""
    return F.substring(F.sha2(F.concat(action, target, payload), 256), 1, APPROVAL_ID_CHARS)


def decision_from_answer(answer: Column) -> Column:
    """A typed answer: yes or y approves, all else, no answer included, rejects."""
    yes = F.lower(strip_whitespace(answer)).isin(*YES_ANSWERS)
    return F.when(F.coalesce(yes, F.lit(False)), "approved").otherwise("rejected")


def is_decision(decision: Column) -> Column:
    return decision.isin(*DECISIONS)
