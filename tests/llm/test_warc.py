"""WARC archives: round trips, revisits, odd payloads."""

import gzip
import hashlib
import os

from tracewell.llm import warc
from tracewell.session import work_path

SCHEMA = "page_id long, url string, html string"


def trip(spark, rows):
    path = work_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(3), path)
    return path, warc.read_archives(spark, path)


def brute(rows):
    out = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        same = [i for i, _, h in rows if (h or "").encode() == body and i is not None]
        revisit = len(body) >= 100 and same and page_id != min(same)
        out.append(
            (page_id, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", min(same) if revisit else None)
        )
    return sorted(out, key=str)


ROWS = [
    (5, "http://a/", "<p>é " * 60),
    (3, "http://b/", "<p>é " * 60),
    (9, None, "<p>é " * 60),
    (None, "http://n/", "<p>é " * 60),
    (3, "http://b/", "<p>é " * 60),
    (4, "http://c/\r\nX: y", "short"),
    (6, "http://d/", "short"),
    (7, "http://e/", None),
    (8, "http://f/", ""),
    (10, "http://g/", "x" * 90 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nWARC/1.1\r\n"),
    (11, "http://h/", "\r\n\r\n" * 40),
    (12, "http://i/", "WARC/1.1\r\n" * 30),
    (13, "http://i/", "WARC/1.1\r\n" * 30),
    (None, None, "n" * 200),
    (None, None, "n" * 200),
]


def test_equals_brute_force(spark):
    _, found = trip(spark, ROWS)
    assert sorted(map(tuple, warc.resolve_revisits(found).collect()), key=str) == brute(ROWS)


def test_payloads_come_back(spark):
    path, found = trip(spark, ROWS)
    got = sorted((r.page_id or 0, bytes(r.payload)) for r in found.where("record_type = 'response'").collect())
    kinds = {(i, (h or "").encode()) for (i, _, h) in ROWS}
    assert set(got) == {((i or 0), h) for i, h in kinds if not (h.startswith(b"<p>") and i != 3) and (i != 13)}
    raw = b"".join(
        gzip.open(os.path.join(path, f)).read() for f in sorted(os.listdir(path)) if f.endswith(".gz")
    )
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: ") and raw.endswith(b"\r\n\r\n")
    assert raw.count(b"WARC-Refers-To: <urn:uuid:") == 4


def test_empty_table(spark):
    _, found = trip(spark, [])
    assert warc.resolve_revisits(found).collect() == []
