"""Personal data: patterns against plain regular expressions, terms on a planted corpus."""

import random
import re

import duckdb

from tracewell.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    d = [int(x) for x in digits[::-1]]
    return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def plain(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_patterns():
    r = random.Random(4)
    for _ in range(4000):
        text = "".join(r.choice("ab1234567890..@@-+ ()é_%") for _ in range(r.randrange(60)))
        assert pii.base_spans(text) == plain(text), text
    for text in ("a@b.c@d.e", "@b.c", "x@y", "1.2.3.4.5.6.7.8", "001.02.3.255", "1.2.3.00000256", "4111 1111 1111 1111", "+1 (555) 123-4567 9"):
        assert pii.base_spans(text) == plain(text), text
    long = "a" * 300_000 + "@" + "1" * 300_000 + " " + "9" * 300_000
    assert pii.base_spans(long) == []


def test_given_documents(spark, sf):
    rows = dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{sf}/documents.parquet'").fetchall())
    out = pii.personal_data(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert {r.doc_id: [tuple(s) for s in r.spans] for r in out} == {i: plain(t) for i, t in rows.items()}


def test_disclosing_terms(spark):
    r = random.Random(8)
    fill = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)]

    def words(k):
        return " ".join(r.choice(fill) for _ in range(k))

    rows = [(i, f"{words(9)} Zanzibarov {words(1)} ann@x.org {words(9)}") for i in range(12)]
    rows += [(100 + i, words(30)) for i in range(60)]
    rows += [(300 + i, "copied text rare1 raretwo bob@y.org stays the same") for i in range(9)]
    rows += [(400, None), (401, ""), (None, "x ann@x.org y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {row.doc_id: row for row in pii.personal_data(docs).collect()}
    for i in range(12):
        assert [rows[i][1][d.start : d.end] for d in out[i].disclosed] == ["Zanzibarov"]
    # copies of one passage are one context and prove nothing
    assert not any(row.disclosed for i, row in out.items() if i not in range(12))
    clean = {row.doc_id: row.text for row in pii.sanitised(docs).collect()}
    assert "[EMAIL]" in clean[0] and "Zanzibarov" not in clean[0] and clean[100] == rows[12][1]
    assert clean[None] == "x [EMAIL] y" and len(clean) == len(rows)


def test_any_word_may_be_a_term(spark):
    r = random.Random(3)
    fill = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)]

    def words(k):
        return " ".join(r.choice(fill) for _ in range(k))

    # a customer number, a user name, a plate and a name of two letters; long words between
    terms = ["4711", "ann77", "B2", "Xu"]
    rows = [(i, f"{words(9)} {terms[i % 4]} {words(2)} u{i % 4}x@x.org {words(9)}") for i in range(40)]
    rows += [(40 + i, f"{words(9)} Farov {'-' * 70} {words(3)} {'z' * 180} far@x.org {words(9)}") for i in range(9)]
    rows += [(100 + i, words(30)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {row.doc_id: row for row in pii.personal_data(docs).collect()}
    for i in range(49):
        found = {rows[i][1][d.start : d.end] for d in out[i].disclosed}
        assert found == ({terms[i % 4]} if i < 40 else {"Farov", "z" * 180})
    clean = {row.doc_id: row.text for row in pii.sanitised(docs).collect()}
    assert not any(t in clean[i] for i in range(40) for t in [f" {terms[i % 4]} "])


def test_empty_table(spark):
    assert pii.personal_data(spark.createDataFrame([], "doc_id long, text string")).collect() == []
