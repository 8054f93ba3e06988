import random
import re
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from covenant.llm import simhash as H
from covenant.llm.common import salted_left_join


def reference_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute(rows, bits=4):
    fps = [(doc, reference_fingerprint(text)) for doc, text in rows]
    up = {d: d for d, _ in fps}

    def find(d):
        while up[d] != d:
            d = up[d]
        return d

    order = lambda d: (d is not None, d or 0)
    for i, (a, x) in enumerate(fps):
        for b, y in fps[:i]:
            if (x ^ y).bit_count() <= bits:
                p, q = sorted((find(a), find(b)), key=order)
                up[q] = p
    return sorted(((d, f"{f:016x}", find(d)) for d, f in fps), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_documents(documents, corpus):
    assert got(H.near_duplicates(documents)) == brute(corpus)


def test_odd_rows(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    exp = brute(rows)
    assert got(H.near_duplicates(odd)) == exp
    kept = H.representatives(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted({c for _, _, c in exp}, key=str)


def test_empty(empty):
    assert H.near_duplicates(empty).count() == 0
    assert H.representatives(empty).count() == 0


def test_index_finds_every_pair():
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 2 ** 63, 5, dtype=np.uint64)
    codes = []
    for c in centre:
        for _ in range(200):
            flip = np.uint64(0)
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                flip |= np.uint64(1) << np.uint64(b)
            codes.append(c ^ flip)
    codes = np.unique(np.array([*codes, *rng.integers(0, 2 ** 63, 300, dtype=np.uint64)], np.uint64))
    index = H.GrayIndex(codes)
    q, hit = index.search(index.codes, 4)
    near = np.bitwise_count(index.codes[:, None] ^ index.codes[None, :]) <= 4
    assert set(zip(q.tolist(), hit.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(near))))


def test_long_chains(spark):
    """Components reach along chains of links."""
    random.seed(1)
    edges = [(i, i + 1) for i in range(1, 400)] + [(1000, 1001), (1000, 1002), (5000, 7000)]
    random.shuffle(edges)
    out = {r["node"]: r["component"] for r in H.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    exp = defaultdict(int, {i: 1 for i in range(1, 401)} | {1000: 1000, 1001: 1000, 1002: 1000, 5000: 5000, 7000: 5000})
    assert out == exp


def test_gray_ranks_count_through_the_gray_sequence():
    n = np.arange(64, dtype=np.uint64)
    assert (H.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_null_and_repeated_identifiers_link_nothing(spark):
    words = [f"word{i}" for i in range(400)]
    texts = [" ".join(random.Random(seed).choices(words, k=120)) for seed in range(6)]
    fps = [reference_fingerprint(t) for t in texts]
    assert all((x ^ y).bit_count() > 4 for i, x in enumerate(fps) for y in fps[:i])
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (9, texts[5]),
            (10, texts[0]), (11, texts[4]), (8, texts[5]), (8, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    label = dict(zip(texts, (None, None, None, 7, 7, 8)))
    exp = sorted(((d, f"{reference_fingerprint(t):016x}", label[t]) for d, t in rows), key=str)
    assert got(H.near_duplicates(docs)) == exp
    kept = [(label[t], t) for t in texts]
    assert got(H.representatives(docs)) == sorted(kept, key=str)


def template_codes(n):
    """Distinct codes of one template: 26 bits vary, some of them seldom."""
    rng = np.random.default_rng(4)
    at, odds = rng.permutation(64)[:26], np.r_[np.full(16, 0.5), np.full(10, 0.03)]
    flips = (rng.random((n, 26)) < odds) @ (np.uint64(1) << at.astype(np.uint64)).astype(object)
    return np.unique(np.array([0x5A5A_1234_DEAD_BEEF ^ int(x) for x in flips], np.uint64))


def test_hot_buckets_are_dealt_again(spark):
    codes = template_codes(3000)
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4
    fps = spark.createDataFrame([(x,) for x in codes.view(np.int64).tolist()], "fp long")
    for hot in (H.HOT, 200):
        rows = H.buckets(fps, 4, hot).toPandas()
        assert rows.groupby(["mask", "value"]).size().max() <= hot
        place = {int(x): i for i, x in enumerate(codes.view(np.int64).tolist())}
        met = np.zeros_like(near)
        for _, own in rows.groupby(["mask", "value"])["fp"]:
            i = [place[x] for x in own]
            met[np.ix_(i, i)] = True
        assert (met | ~near).all()
    found = [{r["node"]: r["component"] for r in H.components(H.links(fps, 4, hot)).collect()} for hot in (H.HOT, 200)]
    assert found[0] == found[1]
    group = np.arange(len(codes))
    while (group != (least := np.array([group[row].min() for row in near]))).any():
        group = least
    own = codes.view(np.int64).tolist()
    pairs = [(found[1].get(own[i], own[i]), g) for i, g in enumerate(group.tolist())]
    assert len(set(pairs)) == len(set(a for a, _ in pairs)) == len(set(b for _, b in pairs))


def test_search_steps_are_bounded():
    codes = template_codes(3000)

    class Watched(H.GrayIndex):
        def search(self, queries, max_bits):
            assert len(queries) * len(self.codes) <= 1 << 16
            return super().search(queries, max_bits)

    plain, H.GrayIndex = H.GrayIndex, Watched
    try:
        steps = list(H.forest(codes, 4, 1 << 16))
    finally:
        H.GrayIndex = plain
    assert len(steps) == len(list(H.forest(codes, 4)))


def test_only_groups_are_joined(spark, monkeypatch):
    """Rows alone take no part in the joins; a hot group without identifiers is spread."""
    joined = []

    def watched(big, small, keys, spread, salts=16):
        joined.append((keys, small.count(), big.select(F.pmod(F.xxhash64(spread), F.lit(salts)).alias("s")).distinct().count()))
        return salted_left_join(big, small, keys, spread, salts)

    monkeypatch.setattr(H, "salted_left_join", watched)
    alone = [(i, " ".join(random.Random(i).choices([f"w{j}" for j in range(500)], k=100))) for i in range(50)]
    rows = alone + [(None, "one two three four five six")] * 60 + [(70, "red green blue"), (71, "red green blue")]
    out = got(H.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert out == brute(rows)
    keys, small, salts = joined[-1]
    assert keys == ["_fp"] and small == 2 and salts > 8
