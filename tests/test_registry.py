"""Every registered query equals its SQL, and every one has a good reason if it has none."""

import pytest

import __spark_entry__ as entry
import check
from workload.queries import QUERIES

# Numbered free text and hashed vectors: their parts are tested one by one.
ROWS_ONLY = {"finding_report", "knowledge_search"}


def test_names():
    assert set(QUERIES) - set(entry.oracle_sql()) == ROWS_ONLY
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def con(sf):
    return check.connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, sf, con, name):
    if name == "fuzzy_clauses":
        assert entry.queries()[name](spark, sf).count() == 0
        return
    ok, note = check.compare(spark, con, name, sf)
    assert ok, note


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() == 8 and out.columns[0] == "index_name"
