"""WARC archives: writing, reading, and assembling transactions.

A capture is three records: a response (or a revisit, if another capture has the same
payload), a request and a metadata record, both naming the first in
WARC-Concurrent-To. Reading gives one row per record. Assembly joins the records of a
transaction through that identifier to one nested row per capture, and a revisit to
the response it refers to.

Archives are written by Spark's text writer, one row a record, with the record end as
the line separator, compressed by file, RECORDS_IN_FILE at most in each. They are read by
its text reader, cut at the version line that starts a record; a task goes through its
pieces in order and puts those together that Content-Length says belong to one record, so
a payload that holds a version line, a record or blank lines does no harm. Any WARC file
can be read so, also one of many gzip members. Lengths and digests are taken while reading;
the joins work on the identifiers, and payloads are kept only where they are asked for.

Which page is the response of a payload is found from digests alone. Only the texts of
responses are shuffled, once; a revisit has no text.

Defined cases: a null html is an empty payload; payloads under 100 bytes are always
responses; rows that repeat a page_id with the same payload are numbered, the first
one is the response and the others revisit it; a null url has no target field; a null
page_id is kept and comes after all others; an empty table gives an empty archive and an
empty result; other columns are not written. A record that ends before its length is there
is read as not ``whole``. An uncompressed file may be split between tasks; there a record
with a version line in its payload at the border of two tasks is not whole either.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.llm.common import bloom_filtered_joins, stored
from tablewright.session import new_path

VERSION = "WARC/1.1"
END = "\r\n\r\n"
LEAST_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS_IN_FILE = 100_000
LAST_PAGE = (1 << 63) - 1
RECORD = (
    "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, stated_digest string,"
    " block string, payload string, payload_bytes long, payload_digest string, whole boolean"
)


def _urn(*parts) -> Column:
    """An identifier that depends on ``parts`` alone."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """``name: value`` and a line end; nothing for a null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def _record(kind: Column, record_id: Column, block: Column, content_type: Column, **fields) -> Column:
    names = {
        "concurrent": "WARC-Concurrent-To",
        "refers": "WARC-Refers-To",
        "target": "WARC-Target-URI",
        "digest": "WARC-Payload-Digest",
        "profile": "WARC-Profile",
    }
    return F.concat(
        F.lit(f"{VERSION}\r\n"),
        _field("WARC-Type", kind),
        _field("WARC-Record-ID", record_id),
        _field("WARC-Date", F.lit(DATE)),
        *[_field(names[k], v) for k, v in fields.items()],
        _field("Content-Type", content_type),
        _field("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
        block,
    )


def roles(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """One row per page without its text: digest, ordinal, first_page and is_first.

    ``first_page`` is the smallest page with the same payload, null for a payload that is
    too short to be revisited; ``ordinal`` numbers equal rows of a page. ``page`` stands for
    the page_id, the last one for null; ``short`` is the text of a short payload.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    size = F.octet_length(html).cast("long")
    rows = stored(
        pages.select(
            F.col("page_id").cast("long"),
            F.coalesce(F.col("page_id").cast("long"), F.lit(LAST_PAGE)).alias("page"),
            F.col("url"),
            F.sha2(html.cast("binary"), 256).alias("digest"),
            F.xxhash64(html).alias("quick"),
            size.alias("payload_bytes"),
            F.when(size < least, html).alias("short"),
        ),
        "warc-pages",
    )
    spans = rows.where("short IS NULL").groupBy("digest").agg(F.min("page").alias("first_page"), F.count(F.lit(1)).alias("n"))
    shared = stored(spans.where("n > 1").select(F.col("digest").alias("d"), "first_page"), "warc-shared")
    copies = Window.partitionBy("page", "digest").orderBy("url")
    placed = rows.join(shared, F.col("digest") == F.col("d"), "left").drop("d").withColumn("ordinal", F.row_number().over(copies))
    first = F.col("short").isNotNull() | (F.coalesce("first_page", "page") == F.col("page")) & (F.col("ordinal") == 1)
    return placed.withColumn("is_first", first)


def write_archive(pages: DataFrame, path: str, least: int = LEAST_REVISIT, compression: str = "gzip") -> None:
    """Write the pages' records to ``path``."""
    rows = stored(roles(pages, least), "warc-roles")
    page_id = F.col("page_id")
    own = _urn(page_id, F.col("digest"), F.col("ordinal"), F.lit("capture"))
    first_id = F.nullif(F.coalesce("first_page", "page"), F.lit(LAST_PAGE))
    first = _urn(first_id, F.col("digest"), F.lit(1), F.lit("capture"))
    target = F.regexp_replace("url", r"[\x00-\x20\x7F]", "_")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        _field("Content-Length", F.col("payload_bytes")),
        F.lit("\r\n"),
    )
    digest = F.concat(F.lit("sha256:"), "digest")

    def response(text: str) -> Column:
        return _record(
            F.lit("response"), own, F.concat(http, text), F.lit("application/http;msgtype=response"), target=target, digest=digest
        )

    revisit = _record(
        F.lit("revisit"), own, http, F.lit("application/http;msgtype=response"),
        refers=first, target=target, digest=digest, profile=F.lit(PROFILE),
    )
    ask = F.concat(F.lit("GET "), F.coalesce(target, F.lit("/")), F.lit(" HTTP/1.1\r\nAccept: text/html\r\n\r\n"))
    about = F.concat(_field("page", F.to_json(F.struct("page_id", "url"))))
    request = _record(
        F.lit("request"), _urn(own, F.lit("request")), ask, F.lit("application/http;msgtype=request"), concurrent=own, target=target
    )
    metadata = _record(
        F.lit("metadata"), _urn(own, F.lit("metadata")), about, F.lit("application/warc-fields"), concurrent=own, target=target
    )
    long = F.col("is_first") & (F.col("payload_bytes") >= least)
    narrow = F.when(F.col("short").isNotNull(), response("short")).when(~F.col("is_first"), revisit)
    others = rows.select(F.explode(F.array_compact(F.array(narrow, request, metadata))).alias("value"))
    html = F.coalesce(F.col("html"), F.lit(""))
    texts = pages.select(
        F.coalesce(F.col("page_id").cast("long"), F.lit(LAST_PAGE)).alias("p"), F.xxhash64(html).alias("q"), html.alias("html")
    ).where(F.octet_length("html") >= least)
    # rows that repeat a page and its text meet the same response
    met = rows.where(long).join(texts, (F.col("page") == F.col("p")) & (F.col("quick") == F.col("q"))).dropDuplicates(["page", "quick", "digest"])
    with bloom_filtered_joins(pages.sparkSession):
        (
            met.select(response("html").alias("value"))
            .unionByName(others)
            .write.option("lineSep", END)
            .option("compression", compression)
            .option("maxRecordsPerFile", RECORDS_IN_FILE)
            .text(path)
        )


def _parsed(record: bytes) -> tuple[dict[str, str], bytes, int] | None:
    """(fields, block as far as it is there, its length) of what follows a version line."""
    head, found, block = record.partition(b"\r\n\r\n")
    if not found:
        return None
    fields: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            fields.setdefault(name.strip().lower(), value.strip())
    length = fields.get("content-length", "")
    return (fields, block, int(length)) if length.isascii() and length.isdigit() else None


def _row(fields: dict[str, str], block: bytes, length: int, payloads: bool) -> dict:
    kind = fields.get("warc-type")
    held = kind in ("response", "resource")
    payload = None
    if held:
        # a response's block is an HTTP message, if it says so
        is_http = kind == "response" and fields.get("content-type", "application/http").startswith("application/http")
        payload = block[:length].partition(b"\r\n\r\n")[2] if is_http else block[:length]
    return {
        "record_id": fields.get("warc-record-id"),
        "record_type": kind,
        "concurrent_to": fields.get("warc-concurrent-to"),
        "refers_to": fields.get("warc-refers-to"),
        "target_uri": fields.get("warc-target-uri"),
        "stated_digest": fields["warc-payload-digest"].removeprefix("sha256:") if "warc-payload-digest" in fields else None,
        "block": None if held else block[:length].decode("utf-8", "replace"),
        "payload": payload.decode("utf-8", "replace") if held and payloads else None,
        "payload_bytes": len(payload) if held else None,
        "payload_digest": hashlib.sha256(payload).hexdigest() if held else None,
        "whole": len(block) >= length,
    }


def _framed(version: bytes, payloads: bool):
    """Records from pieces between version lines, in the order of their file."""
    kinds = pa.schema(
        [(name, {"long": pa.int64(), "boolean": pa.bool_()}.get(kind, pa.string())) for name, kind in (x.split() for x in RECORD.split(", "))]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: bytes | None = None  # a record that its length says goes on
        source = None
        for batch in batches:
            rows = []
            for piece, file in zip(batch.column("value"), batch.column("file"), strict=True):
                piece, file = piece.as_py(), file.as_py()
                if open_ is not None and file != source:
                    rows.append(_row(*_parsed(open_), payloads))
                    open_ = None
                source = file
                record = piece if open_ is None else open_ + version + piece
                found = _parsed(record)
                if found is None:
                    continue  # what stands before the first version line
                if len(found[1]) < found[2]:
                    open_ = record
                    continue
                open_ = None
                rows.append(_row(*found, payloads))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)
        if open_ is not None:
            yield pa.RecordBatch.from_pylist([_row(*_parsed(open_), payloads)], schema=kinds)

    return read


def read_archive(spark: SparkSession, path: str, payloads: bool = True, version: str = VERSION) -> DataFrame:
    """One row per record of WARC files of one version: fields, block, payload, length and digest.

    The payload is that of a response or resource, its block of any other kind is ``block``.
    ``payload`` is text, with a mark for bytes that are no UTF-8; length and digest are
    those of the bytes. Without ``payloads`` it stays null.
    """
    start = f"{version}\r\n"
    pieces = spark.read.schema("value string").option("lineSep", start).text(path)
    raw = pieces.select(F.col("value").cast("binary").alias("value"), F.input_file_name().alias("file"))
    return raw.mapInArrow(_framed(start.encode("ascii"), payloads), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, capture, request, metadata, referred.

    ``referred`` has the id, payload length and digest of the response a revisit names;
    a part that is missing is null.
    """
    parts = ["record_type", "target_uri", "refers_to", "stated_digest", "whole", "payload", "payload_bytes", "payload_digest"]
    own = records.where(F.col("record_type").isin("response", "resource", "revisit")).select(
        "record_id", F.struct(*parts).alias("capture")
    )

    def of(kind: str) -> DataFrame:
        return records.where((F.col("record_type") == kind) & F.col("concurrent_to").isNotNull()).select(
            F.col("concurrent_to").alias(f"{kind}_of"),
            F.struct("record_id", "target_uri", "block", "whole").alias(kind),
        )

    responses = own.select(
        F.col("record_id").alias("referred_id"),
        F.struct(
            F.col("record_id"),
            F.col("capture.payload_bytes").alias("payload_bytes"),
            F.col("capture.payload_digest").alias("payload_digest"),
        ).alias("referred"),
    ).where("referred.payload_bytes IS NOT NULL")
    return (
        own.join(of("request"), F.col("record_id") == F.col("request_of"), "left")
        .join(of("metadata"), F.col("record_id") == F.col("metadata_of"), "left")
        .join(responses, F.col("capture.refers_to") == F.col("referred_id"), "left")
        .select("record_id", "capture", "request", "metadata", "referred")
    )


def captures(pages: DataFrame) -> DataFrame:
    """Write the pages' archive, read it back and give one row per page."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archive(pages, path)
    nested = assemble(stored(read_archive(spark, path, payloads=False), "warc-records"))
    about = F.from_json(F.regexp_extract("metadata.block", r"page: (\{.*\})", 1), "page_id long, url string")
    rows = nested.select(
        "record_id",
        about["page_id"].alias("page_id"),
        F.coalesce("capture.payload_bytes", "referred.payload_bytes").alias("payload_bytes"),
        F.coalesce("capture.payload_digest", "referred.payload_digest").alias("payload_digest"),
        F.col("capture.record_type").alias("record_type"),
        F.col("capture.refers_to").alias("refers_to_record"),
        F.col("capture.stated_digest").alias("stated_digest"),
    )
    pages_of = rows.where("record_type = 'response'").select(
        F.col("record_id").alias("response_id"), F.col("page_id").alias("refers_to")
    )
    return rows.join(pages_of, F.col("refers_to_record") == F.col("response_id"), "left").select(
        "page_id",
        "payload_bytes",
        "payload_digest",
        "record_type",
        "refers_to",
        (F.col("payload_digest") == F.col("stated_digest")).alias("digest_ok"),
    )
