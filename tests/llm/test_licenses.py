"""Licence lookups: normal forms, whole texts and lines."""

from pyspark.sql import functions as F

from tracewell.llm import licenses as li


def found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("mine"))
    return sorted((r.doc_id or 0, r.line_no, r.license) for r in li.license_matches(docs).collect())


def test_matches(spark):
    mit = dict(li.KNOWN[::-1])["MIT"]
    mit = next(t for n, t in li.KNOWN if n == "MIT" and "Permission" in t)
    rows = [
        (1, "Words before.\nReleased under the MIT License.\nwords after"),
        (2, "released  UNDER the (MIT) licence!"),
        (3, "Copyright (c) 2020 Someone\n\n" + mit.replace("Software", "software").replace('"', "“")),
        (4, "Released under the MIT License, not."),
        (5, None),
        (6, ""),
        (7, "\n\n"),
        (8, "Licensed under the Apache License, Version 2.0.\nLicensed under the Apache License, Version 2.0."),
        (None, "Licensed under CC BY-NC 4.0."),
    ]
    assert found(spark, rows) == [
        (0, -1, "CC-BY-NC-4.0"),
        (1, 1, "MIT"),
        (2, -1, "MIT"),
        (3, -1, "MIT"),
        (8, 0, "Apache-2.0"),
        (8, 1, "Apache-2.0"),
    ]


def test_whole_licences(spark):
    """Each under a title, years and owners of its own, wrapped anew, with other marks and quotes."""
    rows, want = [], []
    for i, (name, title, text) in enumerate(li.TEXTS):
        body = text.replace("{1}", "1.").replace("{2}", "2.").replace("{3}", "3.")
        marked = text.replace("{1}", "*").replace("{2}", "*").replace("{3}", "*")
        wrapped = "Copyright (c) 2011-2020, A. Nother\nAll rights reserved.\n\n" + marked.replace(", ", ",\n   ")
        headed = f"# {title}\n\n(c) 1999 Someone\n\n" + body.replace('"', "''").upper()
        other = body + "\n\nExcept on Sundays."
        rows += [(10 * i + 1, body), (10 * i + 2, wrapped), (10 * i + 3, headed), (10 * i + 4, other)]
        want += [(10 * i + k, -1, name) for k in (1, 2, 3)]
    assert found(spark, rows) == want


def test_neighbouring_spellings_and_empty_table(spark):
    rows = spark.createDataFrame([("licence licence, Licence",), ("license. license license",), ("...",)], "t string")
    out = [r[0] for r in rows.select(li.canonical(F.col("t"))).collect()]
    assert out[0] == out[1] and out[2] == ""
    assert found(spark, []) == []


def test_anchors_are_in_every_known_text():
    words = li.anchor_words()
    assert words and all(any(w in text.lower() for w in words) for _, text in li.KNOWN)
    assert li.anchor_words([("x", "licence licenses"), ("y", "Odd words")]) == ["", "words"]


def test_no_python_runs(spark, sf):
    plan = li.license_matches(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
