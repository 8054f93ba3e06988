"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints: one bit per hash bit, set when over half of the document's word
shingles have it. Documents link when their fingerprints differ in at most
``max_bits`` bits, and form the connected components of these links.

Search: equal fingerprints fold into one first, so groups of copies cost one
row. Fingerprints that differ in at most d bits agree on one of d + 1 bit
blocks at least, so each distinct fingerprint goes to one partition per block
value. A bucket with too many is dealt again by the bits that vary in it.
There, fingerprints are sorted by Gray rank and grouped
level by level; a node keeps the bits that all its members share, a child only
those that its parent does not have. A search adds up differences on the way
down and drops a whole group once they exceed ``max_bits``. No pair that links
is missed, and a partition only emits a spanning forest of its links.
Components are then found by star contractions over the forests.

Nulls and ties: a null text counts as empty; a text without words has the
fingerprint zero, linked like any other. A component is one of fingerprints
and bears its smallest identifier, where null sorts below all others; so a null
or repeated identifier links nothing, and components may share such a label.
An empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import id_or_null, long_id, on_workers, pylist, salted_left_join, slices, staged, utf8

SHINGLE, MAX_BITS, SEED = 4, 4, 42
FANOUT = 16
#: queries of one search step, and about the pairs that it compares
QUERY_ROWS, PAIRS = 1024, 1 << 20
#: fingerprints of a bucket that one task searches at once; a larger one is dealt again
HOT = 1 << 14


def fingerprint(text: bytes, words: int = SHINGLE) -> int:
    """64 bits; ``text`` in UTF-8, lower-cased in A-Z here."""
    split = text.lower().split()  # bytes split at \x20 and \x09-\x0D, and lower-case A-Z only
    if not split:
        return 0
    joined = b" ".join(split)
    n = len(split)
    if n <= words:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, split), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[:n - words + 1].tolist(), ends[words - 1:].tolist())]
    h = np.array(hashes, "<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        part = h[i:i + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(counts * 2 > len(h)).tolist()))


def fingerprints(docs: DataFrame, words: int = SHINGLE, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """_id, _fp (the 64 bits as a signed long) and the ``keep`` columns."""
    rows = docs.select(long_id().alias("_id"), *({text: 0} | dict.fromkeys(keep)))
    schema = rows.select("_id", *keep).schema.add("_fp", "long")

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, 4 << 20):
                fps = np.array([fingerprint(t, words) for t in utf8(part, text)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("_id"), *[part.column(c) for c in keep], pa.array(fps)], names=["_id", *keep, "_fp"])

    return on_workers(rows, run, schema)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence."""
    x = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """Levels of masked patterns above fingerprints in Gray order."""

    def __init__(self, codes: np.ndarray, fanout: int = FANOUT):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes, self.fanout = codes[self.order], fanout
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # (mask, pattern), leaves' parents first
        ones, zeros = self.codes, ~self.codes
        while len(ones) > 1:
            cuts = np.arange(0, len(ones), fanout)
            ones, zeros = np.bitwise_and.reduceat(ones, cuts), np.bitwise_and.reduceat(zeros, cuts)
            self.levels.append((ones | zeros, ones))

    def search(self, queries: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
        """All (query row, place in ``codes``) within ``max_bits``."""
        if not self.levels:
            d = np.bitwise_count(queries ^ self.codes[0])
            hit = np.flatnonzero(d <= max_bits)
            return hit, np.zeros(len(hit), np.int64)
        mask, pattern = self.levels[-1]
        q = np.arange(len(queries))
        node = np.zeros(len(q), np.int64)
        far = np.bitwise_count((queries ^ pattern[0]) & mask[0]).astype(np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            near = far <= max_bits
            q, node, far = q[near], node[near], far[near]
            above = self.levels[depth][0][node]
            if depth:
                masks, patterns = self.levels[depth - 1]
            else:
                masks, patterns = None, self.codes
            child = (node[:, None] * self.fanout + np.arange(self.fanout)).ravel()
            q, above, far = (np.repeat(x, self.fanout) for x in (q, above, far))
            real = child < len(patterns)
            q, above, far, child = q[real], above[real], far[real], child[real]
            own = ~above if masks is None else masks[child] & ~above
            far = far + np.bitwise_count((queries[q] ^ patterns[child]) & own)
            node = child
        near = far <= max_bits
        return q[near], node[near]


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def forest(codes: np.ndarray, max_bits: int, pairs: int = PAIRS) -> Iterator[tuple[int, int]]:
    """Places of linked codes, one link per join of two groups. A step of the
    search compares about ``pairs`` pairs at most."""
    if len(codes) < 2:
        return
    index, groups = GrayIndex(codes), _Forest(len(codes))
    step = max(1, min(QUERY_ROWS, pairs // len(codes)))
    for a in range(0, len(codes), step):
        q, hit = index.search(index.codes[a:a + step], max_bits)
        q = q + a
        later = hit > q
        if not later.any():
            continue
        q, hit = q[later], hit[later]
        # of a row's links into one group, the first joins them all
        seen, at = np.unique(hit, return_inverse=True)
        group = np.fromiter(map(groups.find, seen.tolist()), np.int64, len(seen))
        _, first = np.unique(q * len(codes) + group[at], return_index=True)
        for i, j in zip(q[first].tolist(), hit[first].tolist()):
            if groups.join(i, j):
                yield int(index.order[i]), int(index.order[j])


def block_masks(max_bits: int, fixed: int = 0) -> list[int]:
    """The bits outside ``fixed`` in ``max_bits`` + 1 blocks, each with ``fixed``."""
    free = [1 << b for b in range(64) if not fixed >> b & 1]
    cuts = [len(free) * i // (max_bits + 1) for i in range(max_bits + 2)]
    return [fixed | sum(free[a:b]) for a, b in zip(cuts, cuts[1:])]


def _signed(masks: list[int]) -> list[int]:
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def buckets(fps: DataFrame, max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """(fp, mask, value): fingerprints that agree in the bits of ``mask``.
    Any two within ``max_bits`` share a bucket. A bucket of over ``hot`` is
    dealt again, by blocks of the bits that vary in it: what links in it
    agrees on one of these blocks too. One that varies in ``max_bits`` bits
    or fewer stays, and has 2 ** ``max_bits`` fingerprints at most."""
    rows = fps.select("fp", F.explode(F.array(*map(F.lit, _signed(block_masks(max_bits))))).alias("mask"))
    done = None

    def split(batches):
        for batch in batches:
            blocks = [_signed(block_masks(max_bits, ~v & (1 << 64) - 1)) for v in pylist(batch, "varying")]
            yield pa.RecordBatch.from_arrays([batch.column("mask"), batch.column("value"), pa.array(blocks, pa.list_(pa.int64()))], names=["mask", "value", "blocks"])

    while True:
        level = staged(rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))), "buckets")
        large = level.groupBy("mask", "value").agg(F.count("*").alias("n"), F.bit_or("fp").bitwiseXOR(F.bit_and("fp")).alias("varying"))
        large = large.filter((F.col("n") > hot) & (F.bit_count("varying") > max_bits)).select("mask", "value", "varying")
        large = staged(on_workers(large, split, "mask long, value long, blocks array<long>"), "large")
        if large.isEmpty():
            return level if done is None else done.unionAll(level)
        dealt = staged(salted_left_join(level, large, ["mask", "value"], F.col("fp")), "dealt")
        small = dealt.filter("blocks IS NULL").select("fp", "mask", "value")
        done = small if done is None else done.unionAll(small)
        rows = dealt.filter("blocks IS NOT NULL").select("fp", F.explode("blocks").alias("mask")).distinct()


def links(fps: DataFrame, max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """Links (u, v), u < v, between the fingerprints ``fp``, each there once:
    a spanning forest of each bucket."""
    dealt = buckets(fps, max_bits, hot).repartition("mask", "value").sortWithinPartitions("mask", "value")

    def run(batches):
        key, held = None, []

        def flush():
            codes = np.concatenate(held) if held else np.array([], np.int64)
            if len(codes) < 2:
                return []
            codes = np.unique(codes)
            return [tuple(sorted((int(codes[i]), int(codes[j])))) for i, j in forest(codes.view(np.uint64), max_bits)]

        for batch in batches:
            found = []
            mask, value, fp = (batch.column(c).to_numpy() for c in ("mask", "value", "fp"))
            cuts = [0, *(np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1])) + 1).tolist(), len(fp)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if key != (mask[a], value[a]):
                    found += flush()
                    key, held = (mask[a], value[a]), []
                held.append(fp[a:b].copy())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["u", "v"])
        if found := flush():
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["u", "v"])

    return on_workers(dealt, run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with a link, component the smallest
    node reachable: large and small stars in turn until nothing changes. Each
    round is written to the shared folder."""
    edges = staged(edges.select("u", "v"), "links")
    last = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: the later neighbours of a node move to its smallest one
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").filter("u < v").distinct()
        # small star: a node and its earlier neighbours move to the smallest of them
        small = large.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("m"))
        moved = large.withColumnRenamed("v", "node").join(small, "node")
        edges = staged(moved.select(F.col("m").alias("u"), F.col("u").alias("v")).filter("u < v")
                       .unionAll(small.select(F.col("m").alias("u"), F.col("node").alias("v"))).distinct(), "stars")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == last:
            break
        last = state
    stars = edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))
    return stars.unionAll(edges.select(F.col("u").alias("node")).distinct().join(stars, "node", "left_anti").select("node", F.col("node").alias("component")))


def near_duplicates(docs: DataFrame, words: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row."""
    rows = staged(fingerprints(docs, words), "fingerprints")
    out = labelled(rows, max_bits)
    return out.select(id_or_null("_id").alias("doc_id"), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
                      id_or_null("_component").alias("component_id"))


def grouped(rows: DataFrame, value: Column, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, component, least, n, linked): each fingerprint of ``rows`` once, its
    component's smallest fingerprint, the least ``value`` of its own rows, how
    many these are, and whether another fingerprint is in its component."""
    distinct = staged(rows.groupBy(F.col("_fp").alias("fp")).agg(F.min(value).alias("least"), F.count("*").alias("n")), "distinct")
    found = components(links(distinct.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    return distinct.join(found, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), "least", "n", F.col("component").isNotNull().alias("linked"))


def labelled(rows: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``rows`` (_id, _fp, ...) with _component. Only fingerprints that are
    linked or have several rows are joined; a row alone is its own component."""
    own = staged(grouped(rows, F.col("_id"), max_bits).filter("linked OR n > 1"), "components")
    linked = own.filter("linked")
    least = linked.groupBy("component").agg(F.min("least").alias("_component"))
    named = salted_left_join(linked.select("component", F.col("fp").alias("_fp")), least, ["component"], F.col("_fp")).drop("component")
    named = named.unionByName(own.filter("NOT linked").select(F.col("fp").alias("_fp"), F.col("least").alias("_component")))
    # spread by place, not by identifier: that may be null or the same in all copies
    out = salted_left_join(rows, named, ["_fp"], F.monotonically_increasing_id())
    return out.withColumn("_component", F.coalesce("_component", "_id"))


def representatives(docs: DataFrame, words: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component, with the columns of ``docs``: the one with
    the smallest identifier. Of rows that repeat it, the least by a hash of
    the text stays; of rows equal in both, any one."""
    others = tuple(docs.columns)
    renamed = docs.select("doc_id", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row"),
                          *[F.col(c).alias(f"_c{i}") for i, c in enumerate(others)])
    rows = staged(fingerprints(renamed, words, f"_c{others.index('text')}", ("_hash", "_row", *[f"_c{i}" for i in range(len(others))])), "fingerprints")
    kept = grouped(rows, F.struct("_id", "_hash", "_row"), max_bits).groupBy("component").agg(F.min("least").alias("least"))
    out = rows.join(kept.select(F.col("least._row").alias("_row")), "_row", "left_semi")
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(others)])
