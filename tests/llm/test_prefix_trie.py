import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from covenant.llm import prefix_trie as P, scan

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """The contract's rows from rebuilt texts."""
    stored = {}
    for c, t, r, x in rows:
        if c is not None:
            stored.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    stored = {c: [v[2:] for v in sorted(turns)] for c, turns in stored.items()}
    rebuilt = {}
    for c in stored:
        h, base = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(stored.get(base, [])[:h] + stored[c][h:])
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children, below = {}, {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    for node in sorted(members, key=len, reverse=True):
        leaves, saved = below.get(node, (0, 0))
        leaves += node not in children
        saved += (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        below[node] = (leaves, saved)
        if node:
            a, b = below.get(node[:-1], (0, 0))
            below[node[:-1]] = (a + leaves, b + saved)
    return sorted((min(m), len(node), min(members[node[:-1]]) if node else -1, len(m), len(children.get(node, [])), *below[node],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if rebuilt[c] == node).encode()).hexdigest()) for node, m in members.items())


def got(df):
    out = P.prefix_trie(df).select("conv_id", "depth", F.coalesce("parent_conv_id", F.lit(-1)), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(map(tuple, out.collect()))


ROWS = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {(c * t) % 3}") for c in range(95, 130) for t in range(c % 9)]
ROWS += [(200, None, "system", "first"), (200, 1, None, "a"), (200, 1, "b", None), (200, 2, "", ""), (201, None, "system", "first"), (202, 3, "x" * 70, "y" * 200)]
ROWS += [(-5, 0, "user", "minus"), (-105, 1, "user", "minus"), (None, 0, "user", "nobody"), (300, 0, "user", "same"), (300, 0, "user", "same"), (301, 0, "user", "𝒳é"), (301, 0, "user", "𝒳é")]
ROWS += [(c, t, "user", "again") for c in range(400, 440) for t in range(12)]  # copies of one conversation
ROWS += [(555, t, "user", "long" if t % 7 else "tail") for t in range(700)]


def test_brute_force(spark):
    df = spark.createDataFrame([(*r, "x", "y") for r in ROWS], SCHEMA + ", depth string, conv string").repartition(7)
    assert got(df) == brute(ROWS)


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert got(df) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_collisions_are_found_and_done_again(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, SCHEMA)
    full, seeds = P.ring, []

    def small(seed):
        seeds.append(seed)
        return (13, 2, 5) if seed == 0 else full(seed)

    monkeypatch.setattr(P, "ring", small)
    paths = P.rebuilt_paths(df, 0)
    assert P.disproved(P.grouped(paths), df, 0)
    assert got(df) == brute(ROWS) and 1 in seeds


def test_equal_hashes_of_unequal_texts_are_found(spark, monkeypatch):
    df = spark.createDataFrame([(1, 0, "user", "a"), (2, 0, "user", "b"), (3, 5, "user", "c")], SCHEMA)
    real = P.turns
    monkeypatch.setattr(P, "turns", lambda conversations, seed: real(conversations, seed).withColumn("h1", F.lit(4).cast("long")).withColumn("h2", F.lit(5).cast("long")) if seed == 0 else real(conversations, seed))
    assert got(df) == brute([(1, 0, "user", "a"), (2, 0, "user", "b"), (3, 5, "user", "c")])


def test_empty(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_products_form_a_monoid():
    p = P.Product(0)
    x, y, z = (2, 5, 6), (3, 7, 8), (1, 9, 10)
    assert p.times(p.times(x, y), z) == p.times(x, p.times(y, z)) and p.times(p.unit, x) == x == p.times(x, p.unit)
    assert p.suffix(p.times(x, y), x) == y and p.without_last(p.times(x, z), z[1:]) == x


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_running_over_partitions(spark, parts):
    """One group holds most rows and spans partitions; its products go on."""
    rows = [(g, i) for g, n in ((1, 3), (2, 900), (3, 1), (4, 30)) for i in range(n)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "g long, i long").repartition(3)
        out = scan.running(df, "g", [F.col("i")], lambda r: (r["i"], 1), (0, 0), lambda x, y: (x[0] + y[0], x[1] + y[1]), ("s", "n"), ("i",), "t")
        assert sorted(map(tuple, out.collect())) == [(g, i, i * (i + 1) // 2, i + 1) for g, i in sorted(rows)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
