"""Web archives: records written, read back, and put together from segments.

Writing: a payload becomes an HTTP response with chunked transfer coding
inside a WARC/1.1 record. A block beyond ``segment_chars`` is split into a
first record and continuation records, which name the first one as their
origin and carry their number; the last has the total length. Equal payloads
are stored once: one record is the response, the others are revisits that
refer to it. Files are written by Spark's text writer (gzip) and hold a
bounded number of records.

Reading: records are parsed from each file by their Content-Length. Continuation
records are grouped by origin identifier, ordered by segment number, and
joined; the total length is verified, the chunk framing decoded, and the
payload held against its digest.

Nulls and ties: a null payload counts as empty; a null identifier sorts below
all others. Rows that repeat identifier and payload get a record each, all of
them responses where theirs is the identifier that stays. A segment missing,
repeated or out of length makes the record ``complete = false``, not an error.
An empty table gives no records; columns other than the three are ignored.
"""
from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import NULL_ID, long_id, on_workers, salted_left_join, scratch, staged, whole_text

SEGMENT_CHARS, CHUNK_CHARS = 8192, 2048
#: a file holds at most so many records (or segments, of at most SEGMENT_CHARS)
FILE_RECORDS = 1000
_CRLF = "\r\n"


def _urn(identifier: Column) -> Column:
    """A record identifier from a text that is unique to the record."""
    h = F.md5(identifier)
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.lit("-"), F.substring(h, a, n))][1:], F.lit(">"))


def _base32(sha1_hex: Column) -> Column:
    """Upper-case base32 of 40 hex digits: 32 groups of five bits."""
    bits = F.concat(*[F.lpad(F.conv(F.substring(sha1_hex, 1 + 10 * i, 10), 16, 2), 40, "0") for i in range(4)])
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    return F.concat(*[F.substring(F.lit(letters), F.conv(F.substring(bits, 1 + 5 * i, 5), 2, 10).cast("int") + 1, F.lit(1)) for i in range(32)])


def records(pages: DataFrame, keep: str = "largest") -> DataFrame:
    """(_id, _url, _html, digest, n, type, refers_to): which record is the response
    and which revisit it. Payloads are equal when both digests and the length are."""
    html = whole_text("html")
    rows = pages.select(long_id("page_id").alias("_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("_url"), html.alias("_html"))
    rows = rows.withColumn("_sha", F.sha2("_html", 256)).withColumn("n", F.octet_length("_html").cast("long"))
    best = F.max("_id") if keep == "largest" else F.min("_id")
    groups = staged(rows.groupBy("_sha", "n").agg(best.alias("_best"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"), "payloads")
    joined = salted_left_join(rows, groups, ["_sha", "n"], F.col("_id"))
    revisit = F.col("_best").isNotNull() & (F.col("_best") != F.col("_id"))
    return joined.select("_id", "_url", "_html", F.sha1("_html").alias("_sha1"), "n",
                         F.when(revisit, "revisit").otherwise("response").alias("type"), F.when(revisit, F.col("_best")).alias("refers_to"))


def write(pages: DataFrame, path: str, segment_chars: int = SEGMENT_CHARS, chunk_chars: int = CHUNK_CHARS, file_records: int = FILE_RECORDS) -> None:
    """Archive rows (page_id, url, html) in the folder ``path``."""
    digest = F.concat(F.lit("sha1:"), _base32(F.col("_sha1")))
    rows = records(pages).withColumn("_row", F.monotonically_increasing_id().cast("string")).withColumn("_digest", digest)
    rows = rows.withColumn("_record", _urn(F.concat_ws("/", F.lit("record"), "_id", "_digest", "_row")))
    rows = rows.withColumn("_url", F.regexp_replace("_url", r"[\r\n]", "%0A")).select("_id", "_url", "_html", "_digest", "_record", "type", "refers_to")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The records of each page, a page at a time."""
        for batch in batches:
            columns = [batch.column(c) for c in ("_id", "_url", "_html", "_digest", "_record", "type", "refers_to")]
            held, size = [], 0
            for i in range(batch.num_rows):
                for line in archived(*(c[i].as_py() for c in columns), segment_chars, chunk_chars):
                    held.append(line)
                    size += len(line)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])

    (on_workers(rows, lines, "value string").write.option("lineSep", _CRLF * 2).option("compression", "gzip")
     .option("maxRecordsPerFile", file_records).text(path))


def archived(page_id: int, url: str, html: str, digest: str, record: str, kind: str, refers_to: int | None,
             segment_chars: int = SEGMENT_CHARS, chunk_chars: int = CHUNK_CHARS) -> Iterator[str]:
    """The records of one page: the first, and continuations where the block is
    longer than a segment. Each character is copied a fixed number of times."""
    # a revisit has the headers alone
    pieces = [] if kind == "revisit" else [html[a:a + chunk_chars] for a in range(0, len(html), chunk_chars)]
    chunks = [f"{len(p.encode()):X}{_CRLF}{p}{_CRLF}" for p in pieces]
    http = _CRLF.join(("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Transfer-Encoding: chunked", "", ""))
    block = "".join([http, *chunks, "" if kind == "revisit" else f"0{_CRLF}{_CRLF}"])
    total, split = len(block.encode()), len(block) > segment_chars
    for number, at in enumerate(range(0, len(block), segment_chars), 1):
        part, first = block[at:at + segment_chars], number == 1
        own = uuid.UUID(hashlib.md5(f"segment/{record}/{number}".encode()).hexdigest())
        fields = [("WARC-Type", kind if first else "continuation"), ("WARC-Record-ID", record if first else f"<urn:uuid:{own}>"), ("WARC-Date", "1970-01-01T00:00:00Z"),
                  ("WARC-Target-URI", url), ("WARC-Page-ID", page_id), ("WARC-Payload-Digest", digest)]
        if kind == "revisit":
            fields += [("WARC-Refers-To-Page-ID", refers_to), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        if split:
            fields.append(("WARC-Segment-Number", number))
            if not first:
                fields.append(("WARC-Segment-Origin-ID", record))
            if at + segment_chars >= len(block):
                fields.append(("WARC-Segment-Total-Length", total))
        fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(part.encode()))]
        yield "".join(["WARC/1.1", *[f"{_CRLF}{k}: {v}" for k, v in fields], _CRLF * 2, part])


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of an archive, plain or
    gzip (one member or many)."""
    if raw[:2] == b"\x1f\x8b":
        parts = []
        while raw[:2] == b"\x1f\x8b":
            z = zlib.decompressobj(31)
            parts.append(z.decompress(raw) + z.flush())
            raw = z.unused_data
        raw = b"".join(parts)
    at = 0
    while (at := raw.find(b"WARC/", at)) >= 0:
        end = raw.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = raw[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields.get("content-length", "0"))
        yield fields, raw[end + 4:end + 4 + size]
        at = end + 4 + size


def unchunked(body: bytes) -> tuple[bytes, bool]:
    """The body without its chunk framing, and whether the framing was whole."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        try:
            size = int(body[at:line].split(b";")[0], 16) if line >= 0 else -1
        except ValueError:
            size = -1
        if size < 0 or line + 2 + size > len(body):
            return b"".join(out), False
        if size == 0:
            return b"".join(out), True
        out.append(body[line + 2:line + 2 + size])
        at = line + 2 + size + 2


def payload(block: bytes) -> tuple[bytes, bool]:
    """The body of an HTTP message, its transfer coding undone."""
    head, _, body = block.partition(b"\r\n\r\n")
    if any(x.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for x in head.split(b"\r\n")):
        return unchunked(body)
    return body, True


def sha1(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


_READ = "record string, type string, page_id long, refers_to long, url string, digest string, payload binary, payload_bytes long, payload_digest string, complete boolean"
_READ_NAMES = [x.split()[0] for x in _READ.split(", ")]
_READ_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]


def _number(text: str | None) -> int | None:
    return int(text) if text not in (None, "") else None


def _whole(fields: dict[str, str], block: bytes, complete: bool = True) -> tuple:
    kind, digest = fields.get("warc-type"), fields.get("warc-payload-digest", "").partition(":")[2]
    common = (fields.get("warc-record-id"), kind, _number(fields.get("warc-page-id")), _number(fields.get("warc-refers-to-page-id")), fields.get("warc-target-uri"), digest)
    if kind == "revisit":
        return (*common, None, None, digest, complete)
    body, fine = payload(block)
    own = sha1(body)
    return (*common, body, len(body), own, complete and fine and own == digest)


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives in ``path``, segments put together."""
    files = spark.read.format("binaryFile").load(path).select("content")
    names = ["origin", "number", "total", "fields", "block", *_READ_NAMES]
    schema = "origin string, number long, total long, fields map<string,string>, block binary, " + _READ

    def rows(found) -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary(), *_READ_TYPES]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)

    def parsed(batches):
        for batch in batches:
            for raw in batch.column("content"):
                found, held = [], 0
                for fields, block in parse(raw.as_py()):
                    number = _number(fields.get("warc-segment-number"))
                    if number is None:
                        out = _whole(fields, block)
                        found.append((None, None, None, None, None, *(out if with_payload else (*out[:6], None, *out[7:]))))
                    else:
                        origin = fields.get("warc-segment-origin-id") or fields.get("warc-record-id")
                        found.append((origin, number, _number(fields.get("warc-segment-total-length")), list(fields.items()) if number == 1 else None, block, *(None,) * 10))
                    held += len(block)
                    if held > 8 << 20:
                        yield rows(found)
                        found, held = [], 0
                if found:
                    yield rows(found)

    every = staged(on_workers(files, parsed, schema), "records")
    whole = every.filter("number is null").select(*_READ_NAMES)
    # of a segment that was stored twice one is taken; the total length tells what is missing
    groups = every.filter("number is not null").groupBy("origin").agg(
        F.sort_array(F.collect_set(F.struct("number", "block"))).alias("segments"), F.max("total").alias("total"),
        F.max_by("fields", F.col("number") == 1).alias("fields"))

    def joined(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                segs, fields = batch.column("segments")[i].as_py(), dict(batch.column("fields")[i].as_py() or ())
                block = b"".join(s["block"] for s in segs)
                fine = [s["number"] for s in segs] == list(range(1, len(segs) + 1)) and batch.column("total")[i].as_py() == len(block)
                out = _whole(fields, block, fine)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out if with_payload else (*out[:6], None, *out[7:]), _READ_TYPES)], names=_READ_NAMES)

    return whole.unionAll(on_workers(groups, joined, _READ))


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Archive ``pages`` and read the archives back: page_id, payload_bytes,
    payload_digest, record_type, refers_to, complete. A revisit has the size of
    the payload that it refers to."""
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write(pages, path)
    back = staged(read(spark, path, with_payload=False), "back")
    target = back.filter("type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("_n"), F.col("payload_digest").alias("_d")).dropDuplicates(["refers_to", "_d"])
    known = target.join(back.filter("type = 'revisit'").select("refers_to", F.col("payload_digest").alias("_d")).distinct(), ["refers_to", "_d"], "left_semi")
    out = salted_left_join(back.withColumn("_d", F.col("payload_digest")), known, ["refers_to", "_d"], F.col("page_id"))
    null = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(null("page_id").alias("page_id"), F.coalesce("payload_bytes", "_n").alias("payload_bytes"), "payload_digest",
                      F.col("type").alias("record_type"), null("refers_to").alias("refers_to"), F.coalesce(F.col("complete"), F.lit(False)).alias("complete"))
