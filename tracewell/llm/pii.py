"""Personal data: fixed patterns, then terms that disclose the entities found.

Emails, IP addresses, card numbers and phone numbers are found by pattern. Then
corpus statistics decide which words near an entity give it away: for a term t
and an entity e, the disclosure is PMI(t; e) / IC(e), which is 1 where t occurs
with e only and falls the more t occurs elsewhere. Terms that reach
``GENERALISE`` are generalised, those that reach ``REMOVE`` are removed. A term
must stand by the entity in ``SUPPORT`` different contexts, so that copies of
one passage prove nothing. All counts are over all documents. Every word may be
a term, of any length, with digits or without. Only the ``NEAR`` words on either
side of an entity stand by it: what is always further off is not found.

Cases: null text is empty; repeated rows are handled each for itself; a text of
any length is read once, in time that grows with its length; columns other than
doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.words import PUNCTUATION_TOO, WordSlices
from tracewell.operators.sizes import landed

KINDS = ("email", "ip", "card", "phone")
NEAR = 5  # words on either side of an entity
SUPPORT = 3
GENERALISE, REMOVE = 0.95, 0.99

LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TERM = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")

SPANS = "array<struct<kind: string, start: int, end: int>>"
CONTEXTS = "array<struct<entity: string, term: string, context: long, start: int, end: int>>"
SCHEMA = f"doc_id long, text_hash long, spans {SPANS}, near {CONTEXTS}"


def emails(text: str) -> Iterator[tuple[int, int]]:
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL_PART:
            start -= 1
        end = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        low = end
        at = text.find("@", end)


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        value = int(d) * (1 + k % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    out = [("email", *span) for span in emails(text)]
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part[-4:]) <= 255 for part in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def near_terms(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """The words around each entity that are part of none, with their places."""
    out = []
    terms = [m.span() for m in TERM.finditer(text)]
    starts, ends = [a for a, _ in terms], [b for _, b in terms]
    taken = _taken(terms, spans)
    for kind, start, end in spans:
        if start == 0 and end == len(text):
            continue
        before, after = bisect_right(ends, start), bisect_left(starts, end)
        near = [*range(max(0, before - NEAR), before), *range(after, min(len(terms), after + NEAR))]
        places = [terms[k] for k in near if not taken[k]]
        words = [text[a:b].translate(ASCII_LOWER) for a, b in places]
        context = int.from_bytes(hashlib.blake2b(" ".join(words).encode(), digest_size=8).digest(), "big", signed=True)
        entity = f"{kind}:{text[start:end].translate(ASCII_LOWER)}"
        for (a, b), word in zip(places, words, strict=True):
            out.append({"entity": entity, "term": word, "context": context, "start": a, "end": b})
    return out


def _taken(terms: list[tuple[int, int]], spans: list[tuple[str, int, int]]) -> list[bool]:
    """Which words are part of an entity?"""
    out, k, reach = [], 0, 0
    spans = sorted((x, y) for _, x, y in spans)
    for a, b in terms:
        while k < len(spans) and spans[k][0] < b:
            reach = max(reach, spans[k][1])
            k += 1
        out.append(a < reach)
    return out


ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    contexts = pa.struct(
        [("entity", pa.string()), ("term", pa.string()), ("context", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]
    )
    for batch in batches:
        spans, near = [], []
        for text in batch.column("text"):
            text = text.as_py() or ""
            found = base_spans(text)
            spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
            near.append(near_terms(text, found) if found else [])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(spans, pa.list_(kinds)), pa.array(near, pa.list_(contexts))],
            ["doc_id", "text_hash", "spans", "near"],
        )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cut = WordSlices(PUNCTUATION_TOO)
    for batch in batches:
        for piece in cut.slices(batch.column("text")):
            h, n = np.unique(piece.hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])


def _term_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cut = WordSlices(PUNCTUATION_TOO)
    for batch in batches:
        h = [piece.hashes for piece in cut.slices(batch.column("term"))]
        h = np.concatenate(h) if h else np.empty(0, np.uint64)
        yield batch.append_column("h", pa.array(h.view(np.int64)))


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def disclosing_terms(docs: DataFrame, near: DataFrame, support: int = SUPPORT, least: float = GENERALISE) -> DataFrame:
    """(entity, term, disclosure) of at least ``least``. Starts jobs.

    ``near``: one row per word by an entity (entity, term, context). An entity
    counts as often as its most frequent neighbour: each of its places has it once.
    """
    once = near.groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("n"))
    pairs = once.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("together"))
    pairs = landed(pairs.where(F.col("contexts") >= support), "pii-pairs")
    if pairs.isEmpty():
        return pairs.select("entity", "term", F.lit(0.0).alias("disclosure"))
    counts = docs.select("text").mapInArrow(_count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    terms = pairs.select("term").distinct().mapInArrow(_term_hash, "term string, h long")
    counts = landed(counts, "word-counts")
    total = counts.agg(F.sum("n")).first()[0]
    found = pairs.groupBy("entity").agg(F.max("together").alias("entity_n"))
    return (
        pairs.join(terms.join(counts, "h"), "term")
        .join(found, "entity")
        .select(
            "entity",
            "term",
            (
                F.log2(F.lit(float(total)) * F.col("together") / (F.greatest("n", "together") * F.col("entity_n")))
                / F.log2(F.lit(float(total)) / F.col("entity_n"))
            ).alias("disclosure"),
        )
        .where(F.col("disclosure") >= least)
    )


def personal_data(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """Per row: doc_id, text_hash, spans (kind, start, end), disclosed (start, end, disclosure).

    ``spans`` has the pattern's finds in order of kind and start, ``disclosed``
    the terms in order of start. Starts jobs.
    """
    rows = _rows(docs)
    found = landed(rows.mapInArrow(_scan, SCHEMA), "pii-found")
    near = found.select("doc_id", "text_hash", F.explode("near").alias("x")).select("doc_id", "text_hash", "x.*")
    flagged = landed(disclosing_terms(rows, near, support, generalise), "pii-terms")
    places = near.join(flagged, ["entity", "term"]).groupBy("doc_id", "text_hash", "start", "end")
    places = places.agg(F.max("disclosure").alias("disclosure")).groupBy("doc_id", "text_hash")
    places = places.agg(F.sort_array(F.collect_list(F.struct("start", "end", "disclosure"))).alias("disclosed"))
    places = landed(places.withColumnsRenamed({"doc_id": "d", "text_hash": "x"}), "pii-places")
    out = found.join(places, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("x")), "left")
    return out.select(
        "doc_id",
        "text_hash",
        "spans",
        F.coalesce("disclosed", F.expr("cast(array() as array<struct<start: int, end: int, disclosure: double>>)")).alias("disclosed"),
    )


def sanitised(docs: DataFrame, remove: float = REMOVE, **settings) -> DataFrame:
    """doc_id and the text with entities named by kind, terms generalised or removed."""
    found = personal_data(docs, **settings)
    body = _rows(docs).withColumnsRenamed({"doc_id": "d", "text_hash": "x"}).dropDuplicates(["d", "x"])
    found = found.join(body, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("x")))
    found = found.select("doc_id", "text", "spans", "disclosed")

    def rewrite(batches):
        for batch in batches:
            texts = []
            for row in batch.to_pylist():
                marks = [(s["start"], s["end"], f"[{s['kind'].upper()}]") for s in row["spans"]]
                marks += [(s["start"], s["end"], "" if s["disclosure"] >= remove else "[TERM]") for s in row["disclosed"]]
                parts, at = [], 0
                for start, end, mark in sorted(marks, key=lambda m: (m[0], -m[1])):
                    if start >= at:
                        parts += [row["text"][at:start], mark]
                    at = max(at, end)
                texts.append("".join([*parts, row["text"][at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return found.mapInArrow(rewrite, "doc_id long, text string")
