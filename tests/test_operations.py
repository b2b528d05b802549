"""Catalogue, latency, cost, ledger, rewrite and report."""

import hashlib
import json
import math
import statistics
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell import rules
from tracewell.functions import ledger as lf
from tracewell.functions import text as tx
from tracewell.operators import catalog, cost, latency, ledger, report, rewrite
from tracewell.operators.sizes import broadcast_if_small
from tracewell.plans import cycle
from workload import queries, views

T0 = datetime(2024, 1, 1)


# --- catalogue ---------------------------------------------------------------

MAPPING = {
    "properties": {
        "user_id": {"type": "keyword"},
        "message": {"type": "text", "fields": {"raw": {"type": "keyword"}}},
        "event": {"properties": {"duration": {"type": "long"}, "type": {"type": "byte"}}},
        "empty": {"properties": {}},
    }
}


def nest(levels):
    return {"type": "long"} if levels == 0 else {"properties": {"x": nest(levels - 1)}}


def test_flatten(spark):
    docs = spark.createDataFrame([("logs", json.dumps(MAPPING)), ("none", "{}")], "index_name string, mapping string")
    rows = {(r.index_name, r.field_name, r.field_type) for r in catalog.flatten_mappings(docs).collect()}
    assert rows == {
        ("logs", "user_id", "keyword"), ("logs", "message", "text"), ("logs", "event", "object"),
        ("logs", "event.duration", "long"), ("logs", "event.type", "byte"), ("logs", "empty", "object"),
        ("none", "_doc", "unknown"),
    }


def tree(levels):
    """All fields of ``nest(levels)`` as (name, type), found by a plain walk."""
    found, todo = set(), [("", nest(levels))]
    while todo:
        prefix, node = todo.pop()
        for name, child in node.get("properties", {}).items():
            found.add((prefix + name, child.get("type", "object")))
            todo.append((prefix + name + ".", child))
    return found


@pytest.mark.parametrize("levels", [3, 20])
def test_flatten_goes_to_any_depth(spark, levels):
    depths = [1, 2, 3, 4, 6, 7, 20, 21, 60]
    docs = [(f"d{n}", n, {"n": n}, json.dumps(nest(n))) for n in depths]
    wide = {"properties": {f"o{i}": {"properties": {"x": {"type": "long"}}} for i in range(30)}}
    spelled = json.dumps(nest(60)).replace("properties", "\\u0070roperties")
    docs += [("spelled", 0, None, spelled), ("wide", 0, None, json.dumps(wide)), ("none", 0, None, "{}"), (None, 0, None, None)]
    frame = spark.createDataFrame(docs, "index_name string, n int, settings map<string,int>, mapping string")
    rows = catalog.flatten_mappings(frame, levels).collect()
    for n in depths:
        mine = [(r.field_name, r.field_type) for r in rows if r.index_name == f"d{n}"]
        assert len(mine) == len(set(mine)) and set(mine) == tree(n)
    assert all(r.settings == {"n": r.n} for r in rows if r.n)
    assert sum(r.index_name == "wide" for r in rows) == sum(r.index_name == "spelled" for r in rows) == 60
    assert [r.field_name for r in rows if r.index_name in ("none", None)] == ["_doc", "_doc"]
    flat = frame.where("n < 3 and index_name not in ('wide', 'spelled')")
    assert flat.where(catalog._is_deeper(3)).count() == 0
    assert catalog.flatten_mappings(frame.limit(0), levels).count() == 0


def test_build_catalog(spark):
    docs = spark.createDataFrame(
        [("logs", json.dumps(MAPPING)), (".kibana", json.dumps(MAPPING)), ("bare", "{}")],
        "index_name string, mapping string",
    )
    settings = spark.createDataFrame(
        [("logs", {"number_of_shards": "3", "number_of_replicas": "0"})],
        "index_name string, settings map<string,string>",
    )
    stats = spark.createDataFrame([("logs", 1_000_000, 50)], "index_name string, doc_count long, store_size_bytes long")
    aliases = spark.createDataFrame([("logs", ["logs-current"])], "index_name string, aliases array<string>")
    built = catalog.build_catalog(docs, settings, stats, aliases, F.lit("2024-01-01"))
    rows = {(r.index_name, r.field_name): r for r in built.collect()}
    assert {key[0] for key in rows} == {"logs", "bare"}
    full, bare = rows["logs", "user_id"], rows["bare", "_doc"]
    assert (full.shard_count, full.replica_count, full.doc_count, full.aliases) == (3, 0, 1_000_000, ["logs-current"])
    assert tuple(bare)[2:9] == ("unknown", {}, [], 1, 1, 0, 0)
    (summary,) = catalog.catalog_summary(built).collect()
    assert tuple(summary) == (2, 7, T0)


def test_appended_catalog_is_read_by_latest(spark):
    spark.sql("DROP TABLE IF EXISTS cat_history")
    rows = [("i", "f", "long", T0), ("i", "g", "long", T0)]
    schema = "index_name string, field_name string, field_type string, refreshed_at timestamp"
    catalog.write_catalog(spark.createDataFrame(rows, schema), "cat_history", append=True)
    newer = [("i", "f", "text", T0 + timedelta(days=1))]
    catalog.write_catalog(spark.createDataFrame(newer, schema), "cat_history", append=True)
    got = {(r.field_name, r.field_type) for r in catalog.latest(spark.table("cat_history")).collect()}
    assert got == {("f", "text"), ("g", "long")}
    spark.sql("DROP TABLE cat_history")


@pytest.mark.parametrize(
    "glob, name, fits",
    [
        ("*", "", True), ("logs-*", "logs-1", True), ("logs-*", "log-1", False), ("a?c", "abc", True),
        ("a?c", "ac", False), ("a_c", "abc", False), ("50%*", "50% off", True), ("50%", "50x", False),
        ("a\\b", "a\\b", True), ("a.b", "axb", False), ("(x)[1]+", "(x)[1]+", True), ("*\n*", "a\nb", True),
    ],
)
def test_globs(spark, glob, name, fits):
    row = spark.createDataFrame([(name, glob)], "n string, g string")
    like, regex = row.select(
        F.col("n").like(tx.glob_to_like(glob)), tx.glob_matches(F.col("n"), F.col("g"))
    ).head()
    assert (like, regex) == (fits, fits)


def test_templates(spark):
    names = spark.createDataFrame([("logs-opt-1",), ("logs-raw",), ("other",)], "name string")
    templates = spark.createDataFrame(
        [("all", ["*"], 0), ("logs", ["logs-*", "x"], 5), ("opt", ["logs-opt-*"], 9), ("no", ["logs-opt"], 99)],
        "template_name string, patterns array<string>, priority int",
    )
    got = {r.name: r.template_name for r in rewrite.match_templates(names, templates).collect()}
    assert got == {"logs-opt-1": "opt", "logs-raw": "logs", "other": "all"}


# --- latency -----------------------------------------------------------------


def stats_of(spark, values, **kw):
    rows = spark.createDataFrame([("q", "v", float(v)) for v in values], "query string, variant string, elapsed_ms double")
    (row,) = latency.latency_stats(rows, **kw).collect()
    return row


@pytest.mark.parametrize("n", [1, 2, 10, 19, 20, 21, 40, 100, 101])
def test_p95_is_by_nearest_rank(spark, n):
    values = [((i * 37) % n) ** 1.5 for i in range(n)]
    row = stats_of(spark, values)
    assert row.p95_ms == sorted(values)[int(n * 0.95)]
    assert (row.min_ms, row.max_ms, row.iterations) == (min(values), max(values), n)
    assert row.avg_ms == pytest.approx(statistics.mean(values))


def test_p95_of_large_and_tied_groups(spark):
    rng = np.random.default_rng(5)
    groups = {
        "wide": rng.lognormal(3, 2, 60_000),
        "tied": rng.integers(0, 4, 50_000).astype(float),
        "same": np.full(30_000, 7.0),
        "top": np.where(rng.random(40_000) < 0.2, 9.0, rng.random(40_000)),
        "edge": rng.random(20_001),
        "small": rng.random(333),
    }
    rows = spark.createDataFrame(
        [(name, float(v)) for name, values in groups.items() for v in values], "query string, elapsed_ms double"
    ).repartition(9)
    got = {r["query"]: r.p95_ms for r in latency.latency_stats(rows, ["query"]).collect()}
    for name, values in groups.items():
        assert got[name] == np.sort(values)[math.floor(len(values) * 0.95)], name
    close = {r["query"]: r.p95_ms for r in latency.latency_stats(rows, ["query"], exact_p95=False).collect()}
    assert close["wide"] == pytest.approx(got["wide"], rel=0.02)


def test_compare(spark):
    rows = [("up", "baseline", 200.0), ("up", "optimized", 50.0), ("down", "baseline", 10.0),
            ("down", "optimized", 15.0), ("zero", "baseline", 0.0), ("zero", "optimized", 1.0),
            ("same", "baseline", 3.0), ("same", "optimized", 3.0), ("half", "baseline", 3.0),
            ("tiny", "baseline", 1e6), ("tiny", "optimized", 999_999.99)]
    frame = spark.createDataFrame(rows, "query string, variant string, elapsed_ms double")
    got = {r["query"]: (r.improvement_pct, r.improvement_confirmed) for r in latency.latency_compare(frame).collect()}
    assert got == {
        "up": (75.0, True), "down": (-50.0, False), "zero": (0.0, False), "same": (0.0, False),
        "half": (0.0, False), "tiny": (0.0, True),
    }


# --- cost --------------------------------------------------------------------


def test_node_cost(spark):
    got = spark.range(1).select(
        cost.node_cost(), cost.node_cost(3), cost.node_cost(F.lit(2), 150)
    ).head()
    assert tuple(got) == (200.0, 600.0, 300.0)


def test_cost_decisions(spark):
    actions = [("reindex",), ("scale_node",), ("new_node",), ("update_alias",), ("mapping_change",)]
    frame = spark.createDataFrame(actions, "action string")
    rows = {r.action: r for r in cost.cost_decisions(frame, rate=150).collect()}
    assert rows["reindex"].proceed and rows["reindex"].projected_monthly_savings == 150.0
    assert "costs $0.00/mo. Scaling a node costs $150.00/mo." in rows["reindex"].reason
    assert not rows["scale_node"].proceed and rows["scale_node"].cost_of_action_monthly == 150.0
    assert rows["new_node"].reason.startswith("Scaling costs $150.00/mo. Query and mapping")
    assert rows["update_alias"].reason == "No cost constraint identified for action 'update_alias'."
    assert rows["update_alias"].proceed and rows["update_alias"].cost_of_action_monthly == 0.0


def test_month_to_date(spark):
    lines = spark.createDataFrame(
        [("2024-05-31", "aws", 5.0), ("2024-06-01", "aws", 10.0), ("2024-06-09", "aws", 20.0),
         ("2024-06-10", "aws", 40.0), ("2023-06-02", "gcp", 9.0)],
        "day string, provider string, amount double",
    ).select(F.to_date("day").alias("usage_date"), "provider", "amount", F.lit("USD").alias("currency"))

    def at(day):
        return {r.provider: (r.month_to_date_cost, r.projected_monthly_cost) for r in cost.month_to_date(lines, day).collect()}

    assert at("2024-06-10") == {"aws": (30.0, 90.0), "gcp": (0.0, 0.0)}
    assert at("2024-06-01") == {"aws": (0.0, 0.0), "gcp": (0.0, 0.0)}
    recent = cost.month_to_date(lines, "2024-06-10", since="2024-05-01").collect()
    assert [(r.provider, r.month_to_date_cost) for r in recent] == [("aws", 30.0)]
    assert cost.month_to_date(lines, "2024-06-10", since="2024-06-09").head().month_to_date_cost == 30.0


# --- ledger ------------------------------------------------------------------


def test_approval_id(spark):
    payload = {"source": {"query": {"match_all": {}}, "index": "é"}, "b": [1, 2.5, None, True]}
    rows = spark.createDataFrame([("act", "a → b", json.dumps(payload, ensure_ascii=False)), ("act", "t", None)],
                                 "action string, target string, payload string")
    out = rows.withColumn("payload", lf.canonical_payload("payload"))
    text = json.dumps(payload, sort_keys=True)
    got = out.select(lf.approval_id(F.col("action"), F.col("target"), F.col("payload")), "payload").collect()
    assert got[0][1] == text
    assert got[0][0] == hashlib.sha256(f"acta → b{text}".encode()).hexdigest()[:12]
    assert got[1][0] is None


def test_answers(spark):
    rows = spark.createDataFrame([(x,) for x in ("yes", " Y ", "no", "", None, "yeah")], "a string")
    got = [r[0] for r in rows.select(lf.decision_from_answer(F.col("a"))).collect()]
    assert got == ["approved", "approved", "rejected", "rejected", "rejected", "rejected"]


def ledger_tables(spark, asked, answered):
    requests = spark.createDataFrame(
        [(i, T0 + timedelta(seconds=s), n) for n, (i, s) in enumerate(asked)],
        "approval_id string, ts timestamp, n int",
    )
    decisions = spark.createDataFrame(
        [(i, T0 + timedelta(seconds=s), d) for i, s, d in answered],
        "approval_id string, decision_ts timestamp, decision string",
    )
    return requests, decisions


def test_pending(spark):
    requests, decisions = ledger_tables(
        spark,
        [("open", 0), ("done", 0), ("again", 0), ("again", 50), ("twice", 0), ("twice", 9), ("odd", 0)],
        [("done", 1, "approved"), ("again", 20, "rejected"), ("odd", 3, "maybe"), ("ghost", 1, "approved")],
    )
    got = sorted((r.approval_id, r.n) for r in ledger.pending_approvals(requests, decisions).collect())
    assert got == [("again", 3), ("odd", 6), ("open", 0), ("twice", 5)]


def test_resolve(spark):
    requests, decisions = ledger_tables(
        spark,
        [("a", 0), ("b", 0), ("c", 0), ("d", 0), ("e", 100), ("f", 0), ("f", 200), ("g", 10), ("g", 10)],
        [("a", 300, "approved"), ("b", 301, "approved"), ("c", 5, "rejected"), ("c", 9, "approved"),
         ("e", 99, "approved"), ("f", 250, "approved"), ("g", 10, "approved"), ("d", 1, "unclear")],
    )
    got = {r.n: r.outcome for r in ledger.resolve_approvals(requests, decisions).collect()}
    late = "rejected_timeout"
    assert got == {0: "approved", 1: late, 2: "rejected", 3: late, 4: late, 5: "approved", 6: "approved",
                   7: "approved", 8: "approved"}


@pytest.mark.parametrize("seed", [1, 2])
def test_resolve_equals_brute_force_on_a_hot_id(spark, seed):
    """Two ids share all requests and decisions."""
    rng = np.random.default_rng(seed)
    asked = [(str(i), int(s)) for i, s in zip(rng.integers(0, 2, 500), rng.integers(0, 20_000, 500))]
    answered = [
        (str(i), int(s), ("approved", "rejected")[s % 2])
        for i, s in zip(rng.integers(0, 2, 60), rng.integers(0, 20_000, 60))
    ]
    requests, decisions = ledger_tables(spark, asked, answered)
    got = {r.n: r.outcome for r in ledger.resolve_approvals(requests, decisions).collect()}
    for n, (key, at) in enumerate(asked):
        fits = [(s, d) for i, s, d in answered if i == key and at <= s <= at + 300]
        assert got[n] == (min(fits)[1] if fits else "rejected_timeout")


def test_workflow_states(spark):
    def events(name, *steps):
        return [(name, s, status, T0 + timedelta(seconds=at)) for s, status, at in steps]

    a, b = ("a", "applied", 0), ("b", "started", 5)
    rows = (
        events("none", ("b", "started", 0))
        + events("only_a", a)
        + events("bad_a", ("a", "rejected", 0), b)
        + events("bad_b", a, ("b", "rejected", 5))
        + events("slow", a, b, ("task", "completed", 5 + 3_601), ("c", "applied", 9_000))
        + events("edge", a, b, ("task", "completed", 5 + 3_600), ("c", "applied", 9_000))
        + events("running", a, b, ("task", "running", 9))
        + events("bad_c", a, b, ("c", "rejected", 9))
        + events("retry", ("a", "rejected", -9), a, b, ("c", "applied", 9))
    )
    frame = spark.createDataFrame(rows, "workflow_id string, step string, status string, event_ts timestamp")
    got = {r.workflow_id: r.overall_status for r in ledger.workflow_status(frame).collect()}
    assert got == {
        "none": "incomplete", "only_a": "incomplete", "bad_a": "halted_at_step_a",
        "bad_b": "halted_at_step_b", "slow": "reindex_timeout", "edge": "completed",
        "running": "reindex_timeout", "bad_c": "halted_at_step_c", "retry": "completed",
    }


def test_cycle_outcome(spark):
    rows = [(1, 0, "user"), (1, 1, "assistant"), (2, 0, "user"), (3, 0, "assistant"), (3, 1, "user")]
    rows += [(4, t, "assistant") for t in range(15)]
    frame = spark.createDataFrame(rows, "conv_id int, turn int, role string")
    got = {r.conv_id: r.status for r in ledger.cycle_outcome(frame).collect()}
    assert got == {1: "completed", 2: "running", 3: "running", 4: "max_rounds_reached"}


# --- rewrite -----------------------------------------------------------------


def test_rewrite_and_alias(spark):
    for name in ("dst_one", "dst_two"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql("DROP VIEW IF EXISTS current")
    source = spark.createDataFrame([(1, "7", "x"), (2, "8", "y")], "id int, n string, keep string")
    assert cycle.rewrite_table(source, "dst_one", "current", {"n": "int"}) == 2
    assert dict(spark.table("current").dtypes) == {"id": "int", "n": "int", "keep": "string"}
    assert cycle.rewrite_table(source, "dst_two", "current", {"id": "string"}, "id > 1", ("keep",)) == 1
    assert [tuple(r) for r in spark.table("current").select("id", "n", "keep").collect()] == [("2", "8", "y")]
    with pytest.raises(Exception, match="dst_one"):
        cycle.rewrite_table(source, "dst_one", "current", {})
    assert spark.table("current").count() == 1
    bad = source.withColumn("n", F.lit("not a number"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        cycle.rewrite_table(bad, "dst_three", "current", {"n": "int"})
    assert spark.table("current").count() == 1
    spark.sql("DROP VIEW current")
    for name in ("dst_one", "dst_two", "dst_three"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_renames(spark):
    out = rewrite.apply_mapping(spark.range(1), {"id": "string"}, {"id": "key"})
    assert out.dtypes == [("key", "string")]


# --- reports and whole cycles --------------------------------------------------


def test_report(spark, sf):
    found = queries.findings(spark, sf)
    (doc,) = report.report_document(found, top_n=8).collect()
    assert doc.report.startswith(rules.REPORT_HEAD + "\n\n[1] Statement: CircuitBreakingException: [parent]")
    assert "| Severity: CRITICAL\n    Anti-Patterns Detected:\n      - CircuitBreakerException detected." in doc.report
    assert "    Affected Fields: l_orderkey\n      l_orderkey → type: keyword\n" in doc.report
    assert doc.report.count("Recommended Knowledge Tool Queries:") == 6 and "[8]" in doc.report
    assert doc.summary == doc.report[:500]
    assert report.report_document(found.limit(0)).head().report == rules.EMPTY_REPORT
    long = found.limit(1).withColumn("statement", F.lit("y" * 500))
    assert report.finding_report(long).head().text.split("\n")[1] == "[1] Statement: " + "y" * 500
    cut = report.finding_report(long, statement_chars=200).head()
    assert cut.text.split("\n")[1] == "[1] Statement: " + "y" * 200


def test_expected_findings(spark, sf):
    got = queries.statement_findings(spark, sf).collect()
    turn = {text: n for n, (_, text) in enumerate(views.TEMPLATES)}
    assert [turn[r.statement] for r in got] == [6, 7, 5, 4, 3, 2, 1, 0]
    assert {turn[r.statement]: r.severity for r in got} == {
        0: "low", 1: "low", 2: "medium", 3: "high", 4: "high", 5: "high", 6: "critical", 7: "high",
    }


def test_run_cycle(spark, sf):
    result = cycle.run_cycle(
        views.slowlog(spark, sf), views.node_metrics(spark, sf), views.field_catalog(spark),
        views.searched_tables(spark, sf), hours=720, as_of=views.AS_OF, top_n=None,
    )
    assert [r.severity for r in result.findings.collect()][0] == "critical"
    assert tuple(result.summary.head()) == (8, 1, 4)
    assert result.hot_nodes.count() == 2 and result.slowest.count() == 8
    assert result.searches.count() == 7
    nothing = cycle.run_cycle(
        views.slowlog(spark, sf), views.node_metrics(spark, sf), views.field_catalog(spark), {},
        hours=1, as_of="2030-01-01",
    )
    assert nothing.findings.count() == 0 and nothing.summary.head().findings_count == 0


def test_refresh_catalog(spark, sf):
    spark.sql("DROP TABLE IF EXISTS field_catalog_test")
    out = cycle.refresh_catalog(
        views.mapping_docs(spark, sf), views.index_settings(spark, sf), views.index_stats(spark, sf),
        views.index_aliases(spark, sf), "field_catalog_test",
    )
    assert tuple(out.head())[:2] == (180, 400)
    spark.sql("DROP TABLE field_catalog_test")


def test_broadcast_is_measured(spark):
    def hinted(frame):
        return "broadcast" in frame._jdf.queryExecution().analyzed().toString().lower()

    assert hinted(broadcast_if_small(spark.range(5), 5))
    assert not hinted(broadcast_if_small(spark.range(6), 5))
