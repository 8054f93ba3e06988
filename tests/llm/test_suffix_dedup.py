import hashlib
import random

import numpy as np
import pytest

from covenant.llm import suffix_dedup as S


def brute(rows, length):
    """{doc: (n_bytes, n_removed, n_spans, sha256)} of rows in order."""
    seen, out = set(), []
    for doc, text in rows:
        b = (text or "").encode()
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i:i + length]
            if w in seen:
                cover[i:i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, y in zip(b, cover) if not y)
        spans = sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1]))
        out.append((doc, len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def test_documents(documents, corpus):
    assert got(S.deduplicated(documents)) == brute(corpus, S.LENGTH)


def test_odd_rows(odd):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got(S.deduplicated(odd)) == brute(rows, S.LENGTH)


def test_empty(empty):
    assert S.deduplicated(empty).count() == 0


@pytest.mark.parametrize("letters,hot", [("ab", 3), ("abc ", 512), ("a", 2)])
def test_short_strings_and_hot_anchors(spark, monkeypatch, letters, hot):
    """Windows of 8 bytes over few letters repeat everywhere; small pieces and
    a low limit for hot anchors take every path."""
    random.seed(3)
    rows = [(i, "".join(random.choice(letters) for _ in range(random.choice([0, 5, 8, 30, 90])))) for i in range(60)]
    monkeypatch.setattr(S.deduplicated, "__defaults__", (8, 3, False))
    monkeypatch.setattr(S.compared, "__defaults__", (8, hot))
    assert got(S.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == brute(rows, 8)


@pytest.mark.parametrize("bits,hot", [(0, 512), (2, 512), (2, 3), (6, 512)])
def test_colliding_content_hashes_keep_the_bytes(spark, monkeypatch, bits, hot):
    """With content hashes of a few bits, segments of different bytes meet as
    equal ones, in a record batch, across tasks and beyond hot anchors."""
    rng = random.Random(11)
    rows = [(i, "".join(rng.choice("abc ") for _ in range(rng.choice([0, 8, 9, 30, 90])))) for i in range(50)]
    rows += [(100 + i, rows[rng.randrange(50)][1]) for i in range(30)]
    monkeypatch.setattr(S.deduplicated, "__defaults__", (8, 3, False))
    monkeypatch.setattr(S.anchored, "__defaults__", (8, 3, bits))
    monkeypatch.setattr(S.compared, "__defaults__", (8, hot))
    assert got(S.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == brute(rows, 8)


def test_rows_of_an_anchor_are_a_stream(spark):
    """One copied segment and one anchor with many segments, in batches of a few rows."""
    rng = random.Random(2)
    line = "the same line stands in every one of the documents, and what stands around it is other text. " * 2
    rows = [(i, line if i % 2 else "".join(rng.choice("xyz") for _ in range(150)) + line + str(i)) for i in range(60)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert got(S.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))) == brute(rows, S.LENGTH)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_merge_order_against_sorted_bytes():
    random.seed(5)
    texts = [bytes(random.choice(b"ab") for _ in range(random.randint(1, 30))) for _ in range(300)]
    group = np.sort(np.array([random.randint(0, 9) for _ in texts]))
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array(list(map(len, texts)))
    place = np.cumsum(size) - size
    order, common = S.merge_order(S.PrefixHash(data), data, place, size, group)
    assert [texts[i] for i in order] == [t for g in range(10) for t in sorted(texts[i] for i in np.flatnonzero(group == g))]
    for k in range(1, len(order)):
        if group[k] == group[k - 1]:
            a, b = texts[order[k - 1]], texts[order[k]]
            assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_a_hash_collision_is_found():
    class Same(S.PrefixHash):
        def of(self, start, length):
            return np.zeros(len(start), np.uint64)

    texts = [b"b", b"a", b"ab", b"aa"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([1, 1, 2, 2])
    order, common = S.merge_order(Same(data), data, np.cumsum(size) - size, size, np.zeros(4, np.int64))
    assert [texts[i] for i in order] == sorted(texts) and common.tolist() == [-1, 1, 1, 0]


def test_long_texts_are_cut_into_overlapping_pieces():
    text = bytes(random.Random(1).choice(b"abc") for _ in range(5000))
    found = []
    for a, data in S.pieces(text, 100, 700):
        *_, start, n, _ = S.segments(data, np.array([len(data)]))
        found += [a + s + i for s, c in zip(start.tolist(), n.tolist()) for i in range(c)]
    assert sorted(found) == list(range(4901))
