"""WARC archives: writing page captures, reading them back, assembling them.

A page becomes three records: a request, a response (or a revisit, if another
page holds the same payload) and metadata; request and metadata name the
response in WARC-Concurrent-To. Records are lines of a text file whose line
end is the blank line that ends a record, so Spark writes and reads archives
on any file system it knows. A reader gets a file's records as a stream of
bytes and takes blocks by their Content-Length; it holds one record at a time.

Defined results: null html is an empty payload; a null or empty url is left
out of the records; a null page id stays null and loses against any other when
the response among equal payloads is chosen (the largest id, then the largest
url); rows that repeat id, url and payload are one capture. Other columns are
ignored. Incomplete captures keep their missing parts as nulls.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format.
VERSION = "WARC/1.1"
BLANK = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"

FILE_RECORDS = 30_000
RECORD = (
    "record_id string, type string, concurrent_to string, refers_to string, uri string, date string, "
    "payload_bytes long, payload_digest string, fields map<string,string>"
)


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of a text's UTF-8 bytes in base 32, five bytes at a time."""
    digest = F.upper(F.sha1(payload))
    parts = [F.lpad(F.conv(F.substring(digest, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def _record(kind: str | Column, record_id: Column, date: str, uri: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record as text, without the blank line that ends it."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    rows = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri), *headers]
    lines = [F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{name}: "), v)) for name, v in rows]
    size = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws("\r\n", F.lit(VERSION), *lines, size), F.lit(BLANK), block)


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def write_archives(
    pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", min_revisit: int = 0, file_records: int = FILE_RECORDS
) -> None:
    """Archives of ``pages`` (page_id, url, html). Of equal payloads of at
    least ``min_revisit`` bytes one is a response, the others revisit it."""
    page = pages.select(
        F.col("page_id"), F.regexp_replace("url", "[\r\n]", " ").alias("url"), F.coalesce("html", F.lit("")).alias("html"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("digest", base32_sha1(F.col("html")))
    chosen = page.groupBy("digest").agg(F.max(F.struct("page_id", "url", "row")).alias("_first"))
    # By shuffle at every size: the pages move once, by their digests.
    page = page.join(chosen.hint("merge"), "digest")
    again = (F.octet_length("html") >= min_revisit) & ~F.struct("page_id", "url", "row").eqNullSafe(F.col("_first"))
    page = page.withColumn("_again", again)
    me = [F.col("page_id"), F.col("url"), F.col("digest"), F.col("row")]
    first = [F.col("_first.page_id"), F.col("_first.url"), F.col("digest"), F.col("_first.row")]
    response = _urn(F.lit("response"), *me)
    named = F.concat(F.lit("sha1:"), F.col("digest"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(BLANK))
    uri = F.col("url")
    records = F.array(
        _record(
            "request", _urn(F.lit("request"), *me), date, uri,
            [("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/http; msgtype=request"))],
            F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1" + BLANK)),
        ),
        _record(
            F.when(F.col("_again"), "revisit").otherwise("response"), response, date, uri,
            [
                ("WARC-Payload-Digest", named),
                ("WARC-Profile", F.when(F.col("_again"), REVISIT_PROFILE)),
                ("WARC-Refers-To", F.when(F.col("_again"), _urn(F.lit("response"), *first))),
                ("Content-Type", F.lit("application/http; msgtype=response")),
            ],
            F.concat(head, F.when(F.col("_again"), "").otherwise(F.col("html"))),
        ),
        _record(
            "metadata", _urn(F.lit("metadata"), *me), date, uri,
            [("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/warc-fields"))],
            F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n")),
        ),
    )
    lines = page.select(F.explode(records).alias("value"))
    lines.write.option("lineSep", BLANK).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


def _named(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def parse_record(head: bytes, block: bytes) -> tuple:
    """The fields of RECORD. The payload of a response is digested anew; that
    of a revisit is known by its headers only."""
    warc = _named(head)
    kind, size, digest, fields = warc.get("warc-type"), None, None, None
    if kind in ("response", "revisit"):
        http, _, payload = block.partition(BLANK.encode())
        if kind == "response":
            size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        else:
            length = _named(http).get("content-length", "")
            size, digest = int(length) if length.isdigit() else None, warc.get("warc-payload-digest", "").removeprefix("sha1:") or None
    elif kind == "metadata":
        fields = list(_named(block).items())
    return (warc.get("warc-record-id"), kind, warc.get("warc-concurrent-to"), warc.get("warc-refers-to"), warc.get("warc-target-uri"), warc.get("warc-date"), size, digest, fields)


def _stream(lines: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(headers, block) of the records in a stream that was cut at blank lines."""
    blank, held = BLANK.encode(), bytearray()
    for line in lines:
        held += line + blank
        while True:
            # The last line of a file may have got one line end too many.
            while held.startswith(b"\r\n"):
                del held[:2]
            end = held.find(blank)
            if end < 0:
                break
            head = bytes(held[:end])
            if not head.startswith(VERSION.encode()):
                raise ValueError(f"no record begins at {head[:40]!r}")
            begin = end + len(blank)
            stop = begin + int(_named(head)["content-length"])
            parts, have = [], len(held)
            while have < stop + len(blank):
                parts.append(next(lines) + blank)
                have += len(parts[-1])
            held += b"".join(parts)
            yield head, bytes(held[begin:stop])
            del held[: stop + len(blank)]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records below ``path``, see RECORD."""
    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = [*[pa.string()] * 6, pa.int64(), pa.string(), pa.map_(pa.string(), pa.string())]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (v.as_buffer().to_pybytes() for batch in batches for v in batch.column(0))
        found = []
        for record in _stream(lines):
            found.append(parse_record(*record))
            if len(found) == 2_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

    return spark.read.option("lineSep", BLANK).text(path).mapInArrow(parse, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """(capture_id, request, response, metadata), one nested row per capture:
    the records that name a response in WARC-Concurrent-To meet it there."""
    whole = F.struct(*[c for c in records.columns if c != "fields"], F.map_entries("fields").alias("fields"))
    hub = records.select(F.coalesce("concurrent_to", "record_id").alias("capture_id"), "type", whole.alias("r"))
    part = lambda *kinds: F.max(F.when(F.col("type").isin(*kinds), F.col("r")))
    return hub.groupBy("capture_id").agg(part("request").alias("request"), part("response", "revisit").alias("response"), part("metadata").alias("metadata"))
