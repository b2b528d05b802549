"""Metric documents whose schema changes from file to file."""

import json
from datetime import datetime

from tracewell.sources import logs, metric_files


def document(time, name, **os):
    return {"@timestamp": time, "elasticsearch": {"node": {"name": name, "stats": {"os": os}}}}


def test_what_is_read_and_what_is_rejected(spark, tmp_path):
    (tmp_path / "day=1").mkdir()
    (tmp_path / "day=2").mkdir()
    good = [
        document("2024-01-05T10:00:00Z", "a", cpu={"percent": 7}),
        document(1704448800000, "b", cpu={"percent": "8.5"}, load=[1, 2]),
        document("1704448800000", "c", mem={"used_percent": 1e2}) | {"more": {"deep": [1]}},
        document("2024-01-05", "d", cpu={"percent": {"total": 3}}, mem={"used_percent": "NaN"}),
        document("2024-01-05T10:00:00Z", 5, cpu={"percent": "much"}),
        document("2024-01-05T10:00:00Z", "e") | {"note": "x" * 300_000},
    ]
    bad = {
        '{"@timestamp": "2024-01-05T10:0': "unreadable",
        "no json": "unreadable",
        "null": "unreadable",
        '{"elasticsearch": "down", "@timestamp": "2024-01-05"}': "unreadable",
        json.dumps(document("soon", "a")): "no time",
        json.dumps(document("99999999999999999", "a")): "no time",
        json.dumps(document(None, None)): "no time",
        "{}": "no time",
        json.dumps(document("2024-01-05", " ")): "no node",
        '{"@timestamp": "2024-01-05"}': "no node",
    }
    lines = [json.dumps(d) for d in good]
    (tmp_path / "day=1" / "x.json").write_text("\n".join(lines[:3] + ["", "  "] + list(bad)) + "\n")
    (tmp_path / "day=2" / "y.json").write_text("\n".join(lines[3:] + [lines[3]]))
    rows = metric_files.read_metric_files(spark, str(tmp_path))
    assert {r.line: r.reject for r in rows.where("reject is not null").collect()} == bad
    got = sorted((r.node, r.ts, r.cpu_pct, r.mem_used_pct, r.disk_read_kb) for r in metric_files.usable(rows).collect())
    ten, midnight = datetime(2024, 1, 5, 10), datetime(2024, 1, 5)
    assert got == [
        ("5", ten, None, None, None), ("a", ten, 7.0, None, None), ("b", ten, 8.5, None, None),
        ("c", ten, None, 100.0, None), ("d", midnight, None, None, None), ("d", midnight, None, None, None),
        ("e", ten, None, None, None),
    ]
    assert metric_files.usable(rows).columns == ["ts", "node", *logs.METRIC_LEAVES]
    counts = {r.file.rsplit("/", 1)[1]: tuple(r)[1:] for r in metric_files.rejected(rows).collect()}
    assert counts == {"x.json": (13, 4, 4, 2), "y.json": (4, 0, 0, 0)}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    one_day = metric_files.read_metric_files(spark, str(tmp_path / "day=2*"))
    assert one_day.count() == 4


def test_empty_files(spark, tmp_path):
    (tmp_path / "a.json").write_text("")
    rows = metric_files.read_metric_files(spark, str(tmp_path))
    assert rows.collect() == [] and metric_files.rejected(rows).collect() == []
