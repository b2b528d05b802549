"""WARC archives with revisit records.

``write_archives`` digests every payload, shuffles headers only (no payload) by
digest, and writes one record per page: a ``response`` with the payload, or a
``revisit`` with fresh headers that point to the original response.
``read_archives`` parses the files again; ``resolve_revisits`` joins revisits to
their originals.

The text sink writes the files, with the blank lines that end a WARC record as
its line separator; gzip keeps a file in one task when it is read. A payload
that holds a record's first line is put together again by Content-Length.

Cases: null html is an empty payload; null url and null page_id leave their
headers out and come back as null; CR and LF in a url are percent-encoded.
Payloads below ``MIN_BYTES`` are never revisits. Rows that repeat the smallest
page_id with an equal payload are all responses. Without any page_id in a group
of equal payloads all are responses. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.sizes import landed

MIN_BYTES = 100
VERSION = "WARC/1.1\r\n"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "page_id long, url string, record_type string, record_id string, refers_to_record string, "
    "payload_digest string, payload binary"
)


def _record_id(page_id: Column, digest: Column, nothing: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), nothing), digest))
    piece = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *piece), F.lit(">"))


def _header(name: str, value: Column) -> Column:
    """The header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _safe(url: Column) -> Column:
    return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def records(pages: DataFrame, min_bytes: int = MIN_BYTES, date: str = DATE) -> DataFrame:
    """One column ``record``: header lines and block of each page's record. Starts a job."""
    rows = pages.select("page_id", _safe(F.col("url")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha2("html", 256), "n": F.octet_length("html")})
    heads = rows.where(F.col("n") >= min_bytes).select("page_id", "url", "digest")
    originals = (
        heads.groupBy("digest")
        .agg(
            F.min("page_id").alias("first_id"),
            F.min(F.struct(F.col("page_id").isNull(), "page_id", "url")).getField("url").alias("first_url"),
            F.count(F.lit(1)).alias("copies"),
        )
        .where("copies > 1 and first_id is not null")
        .drop("copies")
    )
    rows = rows.join(landed(originals, "warc-originals"), "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    nothing = F.concat(F.lit("none-"), F.coalesce("url", F.lit("")))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("n").cast("string"),
        F.lit("\r\n\r\n"),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    lines = F.concat(
        F.lit(VERSION),
        _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"), nothing)),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _header("WARC-Refers-To", F.when(revisit, _record_id(F.col("first_id"), F.col("digest"), nothing))),
        _header("WARC-Refers-To-Target-URI", F.when(revisit, F.col("first_url"))),
        _header("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _header("X-Page-ID", F.col("page_id").cast("string")),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(lines, block).alias("record"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, date: str = DATE) -> None:
    """Write one record per page to gzip files under ``path``. Starts jobs."""
    sink = records(pages, min_bytes, date).write.option("lineSep", "\r\n\r\n")
    sink.option("compression", "gzip").text(path)


def _parsed(head: bytes, block: bytes) -> tuple:
    fields = {}
    for line in head.decode("utf-8").split("\r\n"):
        name, colon, value = line.partition(": ")
        if colon:
            fields[name.lower()] = value
    payload = block.partition(b"\r\n\r\n")[2]
    page_id = fields.get("x-page-id")
    return (
        None if page_id is None else int(page_id),
        fields.get("warc-target-uri"),
        fields.get("warc-type"),
        fields.get("warc-record-id"),
        fields.get("warc-refers-to"),
        fields.get("warc-payload-digest", "").removeprefix("sha256:"),
        payload if fields.get("warc-type") == "response" else None,
    )


def _records(pieces: Iterator[tuple[str, bytes]]) -> Iterator[tuple]:
    """Records from what stands between version lines, in file order."""
    file, held = None, b""
    for name, piece in pieces:
        if name != file:
            if held:
                raise ValueError(f"record cut short in {file}")
            file, held = name, b""
        held = held + VERSION.encode() + piece if held else piece
        head, found, rest = held.partition(b"\r\n\r\n")
        if not found:
            if held.strip():
                raise ValueError(f"no WARC header in {file}")
            held = b""
            continue
        size = int(head.lower().rpartition(b"\r\ncontent-length: ")[2].partition(b"\r\n")[0])
        if len(rest) >= size + 4:
            yield _parsed(head, rest[:size])
            held = b""
    if held:
        raise ValueError(f"record cut short in {file}")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pieces():
        for batch in batches:
            yield from zip(batch.column("file").to_pylist(), batch.column("value").to_pylist(), strict=True)

    kinds = [pa.int64(), *[pa.string()] * 5, pa.binary()]
    names = [field.split()[0] for field in RECORD.split(", ")]

    def out(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names
        )

    rows, size = [], 0
    for row in _records(pieces()):
        rows.append(row)
        size += len(row[-1] or b"")
        if size > 4_000_000 or len(rows) >= 5000:
            yield out(rows)
            rows, size = [], 0
    if rows:
        yield out(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of gzip WARC files, payload of responses included."""
    lines = spark.read.option("lineSep", VERSION).text(path)
    pieces = lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    return pieces.mapInArrow(_parse, RECORD)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads = batch.column("payload")
        n = pa.array([None if p is None else len(p.as_py()) for p in map(_valid, payloads)], pa.int64())
        d = [None if p is None else hashlib.sha256(p.as_py()).hexdigest() for p in map(_valid, payloads)]
        for mine, said in zip(d, batch.column("payload_digest").to_pylist(), strict=True):
            if mine is not None and mine != said:
                raise ValueError(f"payload digest {mine} is not that of the header, {said}")
        keep = [batch.column(name) for name in ("page_id", "record_type", "record_id", "refers_to_record")]
        yield pa.RecordBatch.from_arrays(
            [*keep, n, pa.array(d, pa.string())],
            ["page_id", "record_type", "record_id", "refers_to_record", "n", "digest"],
        )


def _valid(value):
    return value if value.is_valid else None


def resolve_revisits(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records read back.

    Length and digest are taken from payloads as read, for revisits from the
    response that they refer to; a digest unlike its header raises.
    """
    kinds = "page_id long, record_type string, record_id string, refers_to_record string, n long, digest string"
    heads = landed(found.mapInArrow(_digested, kinds), "warc-heads")
    wanted = heads.where("record_type = 'revisit'").select(F.col("refers_to_record").alias("record_id")).distinct()
    originals = heads.where("record_type = 'response'").join(wanted, "record_id", "left_semi")
    originals = originals.groupBy(F.col("record_id").alias("refers_to_record")).agg(
        F.min("page_id").alias("refers_to"), F.min("n").alias("first_n"), F.min("digest").alias("first_digest")
    )
    return heads.join(landed(originals, "warc-resolved"), "refers_to_record", "left").select(
        "page_id",
        F.coalesce("n", "first_n").alias("payload_bytes"),
        F.coalesce("digest", "first_digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )
