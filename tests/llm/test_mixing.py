import re
from collections import defaultdict

from pyspark.sql import functions as F

from covenant.llm import mixing as M


def reference_targets(sizes, limit=3.0):
    """Rounds of proportional shares; {source: target}."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= limit * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: limit * sizes[s] for s in over}


def check(df):
    rows = df.collect()
    out = M.mix(df).collect()
    assert len(out) == len(rows)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += count(r["text"])
    assert sorted((r["doc_id"], r["size"]) for r in out if r["doc_id"] is not None) == sorted((r["doc_id"], count(r["text"])) for r in rows if r["doc_id"] is not None)
    targets = reference_targets(sizes)
    taken = defaultdict(int)
    by_size = defaultdict(set)
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by_size[(r["source_size"], round(r["target"], 6))].add(r["doc_id"])
    source = {r["doc_id"]: r["source"] for r in rows}
    for r in out:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        assert r["source_size"] == sizes[s] and abs(r["target"] - targets[s]) < 1e-6
    assert all(abs(taken[s] - targets[s]) <= 0.5 + 1e-6 for s in sizes)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, M.mix(df).collect()), key=str)


def test_documents(documents):
    check(documents)


def test_odd_rows(odd):
    check(odd)
    again = M.repeated(odd)
    assert again.columns == odd.columns
    taken = sum(r["taken"] for r in M.mix(odd).collect())
    assert sum(len(r["text"].split()) for r in again.collect()) == taken


def test_empty(empty):
    assert M.mix(empty).count() == 0
    assert M.repeated(empty).count() == 0


def test_clamped_sources_share_their_excess(spark):
    rows = [(i, "w " * n, s, 0) for i, (s, n) in enumerate([("a", 1), ("b", 2), ("c", 3), ("d", 1000), ("e", 500), ("f", 5)])]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string, x int"))


def test_a_hot_source_runs_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(M, "RANGE_ROWS", 50)
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(id % 7 as int))").alias("text"),
                                    F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 20)).alias("source"))
    check(rows)


def test_given_weights(spark, documents):
    weights = spark.createDataFrame([("src1", 1.0), ("src2", 3.0)], "source string, weight double")
    out = M.mix(documents, weights).groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()
    assert sum(r["target"] > 0 for r in out) == 2


def test_rows_without_identifiers_are_dealt_over_ranges(spark, monkeypatch):
    """40,000 null ids of one source stand in many ranges, and the sums over
    ranges in two steps are those in one."""
    from pyspark.sql import functions as F

    df = spark.range(40_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one").alias("source"), F.concat(F.lit("words "), F.col("id").cast("string")).alias("text"))
    df = df.unionByName(spark.range(10).select(F.col("id").alias("doc_id"), F.lit("two").alias("source"), F.lit("a few words").alias("text")))
    seen = []
    real = M.staged
    monkeypatch.setattr(M, "staged", lambda d, name: seen.append((name, real(d, name))) or seen[-1][1])

    def taken(block):
        seen.clear()
        monkeypatch.setattr(M, "RANGE_BLOCK", block)
        return sorted(r["taken"] for r in M.mix(df).collect())

    whole = taken(4096)
    ranges = next(d for name, d in seen if name == "ranges")
    assert ranges.filter("_range >= 0").count() >= 9
    assert taken(2) == whole
    assert abs(sum(whole) - 80_030) <= 2  # two is taken three times, one has the rest
