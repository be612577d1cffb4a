"""Web archives: pages out as WARC records, and back as one nested row per capture.

Writing: every page becomes a request, a response or revisit, and a metadata record; the
first and last name the middle one as concurrent. Of pages with equal payloads (compared by
SHA-1 and length) of at least ``min_bytes`` bytes, the one with the smallest id is the
response and the others revisit it. Files are text written by Spark with the blank line that
ends a record as its line separator, compressed as a whole, at most ``records_per_file``
records each.

Reading: Spark cuts the files at blank lines, and each task puts records together again by
their declared length, one at a time, so payloads may hold anything. Transactions are then
assembled by joins: a request belongs to the record it is concurrent to, a metadata record
to that record or to its request's. Payload digests are checked on the way.

Defined results: a null html is empty; a null url is left out; a null page id sorts after all
others and stays null; rows equal in id and payload are alike (all responses, if that id is
the smallest); an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.llm.work import Scratch

END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
RECORDS_PER_FILE = 60_000
MIN_BYTES = 0
# Names and types of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TYPES = {
    "request": "application/http;msgtype=request",
    "response": "application/http;msgtype=response",
    "revisit": "application/http;msgtype=response",
    "metadata": "application/warc-fields",
}


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, headers: dict[str, str | None], content: str) -> str:
    size = len(content.encode())
    fields = {"WARC-Type": kind, **headers, "Content-Type": TYPES[kind], "Content-Length": str(size)}
    lines = [VERSION, *(f"{k}: {v}" for k, v in fields.items() if v is not None)]
    return "\r\n".join(lines) + END + content


def _one_line(text: str | None) -> str | None:
    return None if text is None else " ".join(text.split())


def capture_records(page_id, url, html: str, first_url, revisits: bool, row: int, date: str) -> list[str]:
    """Request, response or revisit, and metadata of one page."""
    ids = [f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{row}:{kind}')}>" for kind in ("q", "r", "m")]
    payload = html.encode()
    uri = _one_line(url)
    common = {"WARC-Target-URI": uri, "WARC-Date": date}
    try:
        parts = urlsplit(uri or "")
        path, host = (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), parts.netloc
    except ValueError:
        path, host = "/", ""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}{END}"
    response = {"WARC-Record-ID": ids[1], **common, "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}"}
    if revisits:
        more = {"WARC-Profile": PROFILE, "WARC-Refers-To-Target-URI": _one_line(first_url), "WARC-Refers-To-Date": date}
        middle = _record("revisit", response | more, http)
    else:
        middle = _record("response", response, http + html)
    concurrent = {**common, "WARC-Concurrent-To": ids[1]}
    fields = f"payload-length: {len(payload)}\r\n" + ("" if page_id is None else f"page-id: {page_id}\r\n")
    return [
        _record("request", {"WARC-Record-ID": ids[0], **concurrent}, f"GET {path} HTTP/1.1\r\nHost: {host}{END}"),
        middle,
        _record("metadata", {"WARC-Record-ID": ids[2], **concurrent}, fields),
    ]


def write_archives(
    pages: DataFrame,
    folder: str,
    *,
    min_bytes: int = MIN_BYTES,
    date: str = DATE,
    records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """Writes ``page_id``, ``url``, ``html`` as archives below ``folder``."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")
    ).withColumns({"digest": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html")})
    first = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "url"))
    leaders = (
        rows.where(F.col("size") >= min_bytes)
        .groupBy("digest", "size")
        .agg(first.alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    revisits = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    # Read back, so that the rows of one very common payload can be split in the join.
    leaders = Scratch(pages.sparkSession).keep(leaders, "leaders")
    planned = rows.join(leaders.hint("merge"), ["digest", "size"], "left").select(
        "page_id",
        "url",
        "html",
        F.col("first.url").alias("first_url"),
        revisits.alias("revisits"),
        F.monotonically_increasing_id().alias("row"),
    )

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[str] = []
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                out += capture_records(*values, date)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    planned.mapInArrow(records, "value string").write.option("lineSep", END).option(
        "maxRecordsPerFile", records_per_file
    ).option("compression", "gzip").text(folder)


def _fields(block: bytes) -> dict[str, str]:
    found = {}
    for line in block.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            found[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return found


def parsed(segments: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and content of the records in one file, from its text cut at blank lines."""
    end = END.encode()
    held = bytearray()
    headers, need = None, 0
    for segment in segments:
        held += segment
        held += end
        while True:
            if headers is None:
                at = held.find(end)
                if at < 0 or not held.strip():
                    break
                headers = _fields(bytes(held[:at]))
                need = int(headers.get("content-length", 0))
                del held[: at + len(end)]
            if len(held) < need + len(end):
                break
            yield headers, bytes(held[:need])
            del held[: need + len(end)]
            headers = None


RECORDS = (
    "record_id string, type string, concurrent_to string, target_uri string, date string, digest string, "
    "digest_ok boolean, refers_to_uri string, payload_bytes long, fields map<string,string>, payload binary"
)


def read_records(spark: SparkSession, folder: str, *, payloads: bool = True) -> DataFrame:
    """The records of all archives below ``folder``."""
    lines = (
        spark.read.option("lineSep", END)
        .text(folder)
        .select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    )
    names = [part.split()[0] for part in RECORDS.split(", ")]
    kinds = [pa.string()] * 6 + [pa.bool_(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]

    def row(headers: dict[str, str], content: bytes) -> tuple:
        kind = headers.get("warc-type")
        digest = (headers.get("warc-payload-digest") or "").removeprefix("sha1:") or None
        payload = content.partition(END.encode())[2] if kind == "response" else None
        fields = _fields(content) if kind == "metadata" else {}
        ok = None if payload is None or digest is None else payload_digest(payload) == digest
        return (
            headers.get("warc-record-id"),
            kind,
            headers.get("warc-concurrent-to"),
            headers.get("warc-target-uri"),
            headers.get("warc-date"),
            digest,
            ok,
            headers.get("warc-refers-to-target-uri"),
            None if payload is None else len(payload),
            list(fields.items()),
            payload if payloads else None,
        )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def files() -> Iterator[tuple[str, bytes]]:
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

        from itertools import groupby

        out, size = [], 0
        for _, lines_of in groupby(files(), key=lambda pair: pair[0]):
            for headers, content in parsed(value for _, value in lines_of):
                out.append(row(headers, content))
                size += 200 + (len(content) if payloads else 0)
                if size > 1 << 23:
                    yield batch_of(out)
                    out, size = [], 0
        yield batch_of(out)

    return lines.mapInArrow(parse, RECORDS)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id``, ``response`` (a response or revisit record),
    ``requests`` and ``metadata`` (lists of records)."""
    body = F.struct(*[F.col(name) for name in records.columns]).alias("record")
    requests = records.where("type = 'request'").select(
        F.col("record_id").alias("request_id"), F.col("concurrent_to").alias("capture_id"), body
    )
    metadata = (
        records.where("type = 'metadata'")
        .select(F.col("concurrent_to"), body)
        .join(
            requests.select("request_id", F.col("capture_id").alias("of_request")).hint("merge"),
            F.col("concurrent_to") == F.col("request_id"),
            "left",
        )
        .select(F.coalesce("of_request", "concurrent_to").alias("capture_id"), "record")
    )
    responses = records.where("type in ('response', 'revisit')").select(
        F.col("record_id").alias("capture_id"), body.alias("response")
    )
    requests = requests.groupBy("capture_id").agg(F.collect_list("record").alias("requests"))
    metadata = metadata.groupBy("capture_id").agg(F.collect_list("record").alias("metadata"))
    return responses.join(requests.hint("merge"), "capture_id", "left").join(
        metadata.hint("merge"), "capture_id", "left"
    )


def archived_pages(pages: DataFrame, *, min_bytes: int = MIN_BYTES, **parameters) -> DataFrame:
    """Writes the archives to the shared folder, reads them back, and returns one row per
    page: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``,
    ``intact`` (the digest of what was read is the declared one)."""
    scratch = Scratch(pages.sparkSession)
    write_archives(pages, scratch.path("archives"), min_bytes=min_bytes, **parameters)
    records = scratch.keep(read_records(pages.sparkSession, scratch.path("archives"), payloads=False), "records")
    found = captures(records).select(
        F.col("metadata")[0]["fields"]["page-id"].cast("long").alias("page_id"),
        F.col("metadata")[0]["fields"]["payload-length"].cast("long").alias("declared_bytes"),
        "response.payload_bytes",
        F.col("response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("response.digest_ok").alias("digest_ok"),
    )
    found = scratch.keep(found, "captures")
    first = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "payload_bytes"))
    originals = found.where("record_type = 'response'").groupBy("payload_digest").agg(first.alias("first"))
    originals = scratch.keep(originals, "originals")
    is_revisit = F.col("record_type") == "revisit"
    return found.join(originals.hint("merge"), "payload_digest", "left").select(
        "page_id",
        F.when(is_revisit, F.col("first.payload_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.when(is_revisit, F.col("first.page_id")).alias("refers_to"),
        F.when(is_revisit, F.col("first.payload_bytes") == F.col("declared_bytes"))
        .otherwise(F.col("digest_ok"))
        .alias("intact"),
    )
