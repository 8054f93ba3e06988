import base64
import hashlib
from collections import Counter

import pytest

from covenant.llm import warc as W

HTML = "<p>Zeile ünd ligne</p>\r\n\r\nWARC/1.1\r\n" * 30
PAGES = [
    (1, "http://a/", HTML), (2, "http://b/", HTML), (3, "http://c/", "x"), (4, None, None), (5, "http://d/", ""), (6, "http://e/", "x"),
    (7, "http://f/\r\nEvil: 1", "漢" * 30_000), (8, "u", "漢" * 30_000), (9, "u", "0\r\n\r\n"), (9, "u", "0\r\n\r\n"), (None, "u", "x"), (10, "u", "long " * 50_000),
]
SCHEMA = "page_id long, url string, html string"


def brute(rows):
    order = lambda i: (i is not None, i or 0)
    best = {}
    for i, _, h in rows:
        h = (h or "").encode()
        best[h] = max(best.get(h, i), i, key=order)
    out = []
    for i, _, h in rows:
        h = (h or "").encode()
        first = best[h] == i
        out.append((i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if first else "revisit", None if first else best[h]))
    return Counter(out)


def got(df):
    rows = df.collect()
    assert all(r["complete"] for r in rows)
    return Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows)


def test_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert got(W.round_trip(df)) == brute([tuple(r) for r in df.select("page_id", "url", "html").collect()])


def test_odd_rows_and_segments(spark):
    df = spark.createDataFrame([(*r, "x", "y") for r in PAGES], SCHEMA + ", record string, n string")
    assert got(W.round_trip(df)) == brute(PAGES)


@pytest.mark.parametrize("segment,chunk,records", [(64, 7, 3), (10_000_000, 1 << 20, 1000), (1000, 1, 5)])
def test_payloads_come_back(spark, tmp_path, segment, chunk, records):
    rows = [r for r in PAGES if r[0] in (1, 3, 5, 9)] + [(11, "u", "ß😀" * 50)]
    path = str(tmp_path / "warc")
    W.write(spark.createDataFrame(rows, SCHEMA), path, segment, chunk, records)
    out = W.read(spark, path).collect()
    assert Counter((r["page_id"], bytes(r["payload"])) for r in out) == Counter((i, h.encode()) for i, _, h in rows)
    assert all(r["complete"] and r["payload_digest"] == r["digest"] for r in out)


def test_empty(spark, tmp_path):
    assert W.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def record(kind, body, **fields):
    head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\n{head}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_segments_in_any_order_and_missing_ones(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4;x=y\r\nWiki\r\n6\r\npedia \r\n0\r\n\r\n"
    a, b, c = block[:20], block[20:60], block[60:]
    digest = "sha1:" + W.sha1(b"Wikipedia ")
    first = lambda n: record("response", a, WARC_Record_ID=f"<{n}>", WARC_Page_ID=n, WARC_Payload_Digest=digest, WARC_Segment_Number=1)
    more = lambda n, k, x, **f: record("continuation", x, WARC_Record_ID=f"<{n}-{k}>", WARC_Segment_Origin_ID=f"<{n}>", WARC_Segment_Number=k, **f)
    end = {"WARC_Segment_Total_Length": len(block)}
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.warc").write_bytes(more(1, 3, c, **end) + first(2) + more(2, 2, b))
    (folder / "2.warc").write_bytes(more(1, 2, b) + more(1, 2, b) + first(1) + more(2, 3, c, WARC_Segment_Total_Length=len(block) + 1) + first(3) + more(3, 3, c, **end))
    out = {r["page_id"]: r for r in W.read(spark, str(folder)).collect()}
    assert out[1]["complete"] and bytes(out[1]["payload"]) == b"Wikipedia "
    assert not out[2]["complete"] and not out[3]["complete"]


def test_chunk_framing():
    assert W.unchunked(b"3\r\nabc\r\n0\r\n\r\n") == (b"abc", True)
    assert W.unchunked(b"3\r\nab") == (b"", False)
    assert W.unchunked(b"") == (b"", False)
    assert W.unchunked(b"zz\r\n") == (b"", False)


def test_a_page_takes_time_in_proportion(spark):
    """32 million characters: written in segments, read back whole."""
    import time

    html = "<p>ünd so weiter</p>\r\n" * (32_000_000 // 22)
    times = []
    for part in (html[: len(html) // 8], html):
        t0 = time.perf_counter()
        n = sum(len(x) for x in W.archived(1, "u", part, "sha1:X", "<urn:uuid:x>", "response", None))
        times.append(time.perf_counter() - t0)
        assert n > len(part)
    assert times[1] < 8 * 4 * max(times[0], 0.05)
    df = spark.createDataFrame([(1, "u", html)], SCHEMA)
    t0 = time.perf_counter()
    assert got(W.round_trip(df)) == brute([(1, "u", html)])
    assert time.perf_counter() - t0 < 60
