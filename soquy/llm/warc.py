"""WARC archives: records out, records in, and captures put together again.

``write_captures`` turns rows into transactions of three records: the request, the response (or, for
a payload that another capture holds, a revisit without it) and a metadata record. Request and
metadata name the response's id in WARC-Concurrent-To. ``read_records`` parses archives back into
one row per record and ``assemble`` joins the records of a transaction into one nested row per
capture.

* The archives are gzipped WARC/1.1 files of at most ``rows_per_file`` captures, written by Spark
  below the shared folder, so a lost task is simply run again and no file is seen before it is whole.
* A null payload is empty. Payload length and digest are those of the full payload, for a revisit
  too: its block has the HTTP headers, with the full length.
* Of captures with equal payloads of at least ``smallest`` bytes the one with the largest key is the
  response; the others revisit it. A null key is below every other. Rows that repeat the largest
  key are responses all of them. Payloads below ``smallest`` bytes are always responses.
* Record ids are derived from key and payload, so repeated rows share ids. A transaction has one
  request and one metadata record then (repeats are equal), and each response record is a capture.
* A line end inside a url is dropped. An empty table gives an empty archive and no capture.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from soquy.llm.common import shared_folder

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
HTTP_OK = "HTTP/1.1 200 OK"
RECORDS = (
    "record_type string, record_id string, concurrent_to string, target_uri string, date string, "
    "refers_to string, payload_digest string, payload_bytes long, payload binary, fields map<string,string>"
)
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, in built-in functions: 5 hex digits are 4 base32 digits."""
    digits = [
        F.lpad(F.conv(F.substring(F.sha1(payload), 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)
    ]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def urn(*parts: Column) -> Column:
    """A record id from what the record is about."""
    h = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts)))
    at = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in at)), F.lit(">"))


def record(kind: str | Column, headers: dict[str, Column], block: Column) -> Column:
    """The text of a record without its closing empty lines; headers that are null are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    length = F.octet_length(block).cast("string")
    lines = [
        F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
        for name, value in ({"WARC-Type": kind} | headers | {"Content-Length": length}).items()
    ]
    return F.concat(F.lit("WARC/1.1" + CRLF), *(F.coalesce(x, F.lit("")) for x in lines), F.lit(CRLF), block)


def originals(pages: DataFrame, smallest: int) -> DataFrame:
    """Rows with ``revisits``: the key of the response they revisit, and ``is_revisit``.

    The largest key of each digest comes from a partial aggregate; the join on the digest is between
    two plain exchanges, so a digest with a third of all rows is split by adaptive execution.
    """
    large = F.col("n") >= smallest
    best = (
        pages.filter(large)
        .groupBy("digest")
        .agg(F.max("key").alias("best_key"), F.count("*").alias("copies"))
        .filter("copies > 1")
        .select(F.concat(F.col("digest"), F.lit("")).alias("of_digest"), "best_key")
    )
    # payloads without a copy meet nothing, so they need no partner
    joined = pages.join(best, (F.col("digest") == F.col("of_digest")) & large, "left")
    revisit = F.col("of_digest").isNotNull() & ~F.col("key").eqNullSafe(F.col("best_key"))
    return joined.withColumn("is_revisit", revisit).withColumn(
        "revisits", F.when(revisit, F.col("best_key"))
    )


def write_captures(
    pages: DataFrame, key_col: str, url_col: str, payload_col: str, smallest: int = 0, rows_per_file: int = 20_000
) -> str:
    """Writes the archives and returns their folder."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(key_col).cast("long").alias("key"),
        F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), "[\\r\\n]", "").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("n"),
        base32_sha1(payload.cast("binary")).alias("digest"),
    )
    rows = originals(rows, smallest)
    about = (F.col("key"), F.col("digest"))
    main, target = urn(F.lit("response"), *about), F.when(F.col("url") != "", F.col("url"))
    shared = {"WARC-Date": F.lit(DATE), "WARC-Target-URI": target}
    head = F.concat(
        F.lit(HTTP_OK + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "),
        F.col("n").cast("string"),
        F.lit(CRLF + CRLF),
    )
    asked = F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1" + CRLF + CRLF))
    response = record(
        F.when(F.col("is_revisit"), "revisit").otherwise("response"),
        {
            "WARC-Record-ID": main,
            **shared,
            "WARC-Payload-Digest": F.concat(F.lit("sha1:"), F.col("digest")),
            "WARC-Profile": F.when(
                F.col("is_revisit"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
            ),
            "WARC-Refers-To": F.when(F.col("is_revisit"), urn(F.lit("response"), F.col("revisits"), F.col("digest"))),
            "Content-Type": F.lit("application/http; msgtype=response"),
        },
        F.concat(head, F.when(F.col("is_revisit"), "").otherwise(F.col("payload"))),
    )
    request = record(
        "request",
        {
            "WARC-Record-ID": urn(F.lit("request"), *about),
            **shared,
            "WARC-Concurrent-To": main,
            "Content-Type": F.lit("application/http; msgtype=request"),
        },
        asked,
    )
    said = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))
    metadata = record(
        "metadata",
        {
            "WARC-Record-ID": urn(F.lit("metadata"), *about),
            **shared,
            "WARC-Concurrent-To": main,
            "Content-Type": F.lit("application/warc-fields"),
        },
        F.concat(said("key", F.col("key")), said("original-key", F.col("revisits"))),
    )
    folder = shared_folder(pages.sparkSession)
    # every record is closed by two line ends, which are the writer's separator here
    rows.select(F.explode(F.array(request, response, metadata)).alias("value")).write.option(
        "lineSep", CRLF + CRLF
    ).option("compression", "gzip").option("maxRecordsPerFile", 3 * rows_per_file).text(folder)
    return folder


def headers_of(lines: list[str]) -> dict[str, str]:
    """Header fields by name; a field that is repeated has its values joined by commas."""
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if colon:
            name, value = name.strip(), value.strip()
            fields[name] = f"{fields[name]}, {value}" if name in fields else value
    return fields


def field(fields: dict[str, str], name: str) -> str | None:
    return next((v for k, v in fields.items() if k.lower() == name), None)


def parse_stream(stream: BinaryIO) -> Iterator[tuple]:
    """The records of one archive, in the order of RECORDS, one after the other."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):  # some writers leave more than two line ends
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        lines = []
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            lines.append(line.decode("utf-8", "replace"))
        headers = {k.lower(): v for k, v in headers_of(lines).items()}
        if "content-length" not in headers:
            raise ValueError(f"a record without a length: {headers.get('warc-record-id')}")
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"the record {headers.get('warc-record-id')} is cut off")
        kind, payload, length, digest, fields = headers.get("warc-type"), None, None, None, None
        if kind in ("response", "revisit"):
            top, body, fields = b"", block, {}
            if headers.get("content-type", "").lower().startswith("application/http") or block.startswith(b"HTTP/"):
                top, _, body = block.partition(b"\r\n\r\n")
                fields = headers_of(top.decode("utf-8", "replace").split(CRLF)[1:])
            if kind == "response":
                payload, length = body, len(body)
                digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
            else:
                said = field(fields, "content-length")
                length = int(said) if said and said.isdigit() else None
                digest = (headers.get("warc-payload-digest") or "").rpartition(":")[2].upper() or None
        elif kind == "metadata":
            fields = headers_of(block.decode("utf-8", "replace").splitlines())
        yield (
            kind,
            headers.get("warc-record-id"),
            headers.get("warc-concurrent-to"),
            headers.get("warc-target-uri"),
            headers.get("warc-date"),
            headers.get("warc-refers-to"),
            digest,
            length,
            payload,
            fields,
        )


def parse_archive(data: bytes) -> Iterator[tuple]:
    """The records of an archive, as it is or compressed: as a whole, or each record by itself."""
    stream = io.BytesIO(data)
    return parse_stream(io.BufferedReader(gzip.GzipFile(fileobj=stream)) if data[:2] == b"\x1f\x8b" else stream)


def read_records(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """One row per record of all archives in a folder (``.warc``, ``.warc.gz``, ``.gz``). Without
    ``payloads`` they are digested where they are read and left there.

    Archives are read record by record, so a task holds one archive as it is stored and some MB of
    records. Fields that a record lacks are null; the payload of a response that is no HTTP (``dns:``)
    is its whole block. An archive that is cut off fails.
    """
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.string()] * 7 + [pa.int64(), pa.binary(), pa.map_(pa.string(), pa.string())]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for content in files["content"]:
                rows, size = [], 0
                for row in parse_archive(content.as_buffer().to_pybytes()):
                    rows.append(row if payloads else (*row[:8], None, row[9]))
                    size += len(rows[-1][8] or b"") + 200
                    if size > 4 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").load(folder)
    return files.select("content").mapInArrow(run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id and the nested request, response and metadata records.

    Requests and metadata records without a response belong to no capture and are left out; a
    response without them has nulls there.
    """
    part = F.struct(*records.columns)
    sides = records.filter(F.col("record_type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
    row = F.struct(*(c for c in records.columns if c not in ("fields", "payload")), F.map_entries("fields").alias("said"))
    joined = (
        sides.groupBy(F.col("concurrent_to").alias("of"))
        .agg(
            F.min(F.when(F.col("record_type") == "request", row)).alias("request"),
            F.min(F.when(F.col("record_type") == "metadata", row)).alias("metadata"),
        )
        .withColumn("metadata", F.col("metadata").withField("fields", F.map_from_entries("metadata.said")).dropFields("said"))
        .withColumn("request", F.col("request").dropFields("said"))
    )
    responses = records.filter(F.col("record_type").isin("response", "revisit"))
    return responses.select(F.col("record_id").alias("capture_id"), part.alias("response")).join(
        joined, F.col("capture_id") == F.col("of"), "left"
    ).select("capture_id", "request", "response", "metadata")
