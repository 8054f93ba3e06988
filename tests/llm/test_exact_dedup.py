import hashlib
from collections import defaultdict

from hypothesis import given, settings, strategies as st

from covenant.llm import exact_dedup as X


def brute(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[text or ""].append(doc)
    key = lambda d: (d is not None, d or 0)
    out = []
    for doc, text in rows:
        own = groups[text or ""]
        keep = max(own, key=key)
        out.append((doc, keep, len(own), doc == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_documents(documents, corpus):
    assert got(X.membership(documents)) == brute(corpus)


def test_odd_rows(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(X.membership(odd)) == brute(rows)
    kept = X.survivors(odd)
    assert kept.columns == odd.columns
    assert sorted(r["text"] for r in kept.collect()) == sorted({t or "" for _, t in rows})


def test_smallest_may_stay(odd):
    rows = [r for r in X.membership(odd, keep="smallest").collect() if r["doc_id"] in (1, 5)]
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in rows} == {(1, 1, True), (5, 1, False)}


def test_empty(empty):
    assert X.membership(empty).count() == 0
    assert X.survivors(empty).count() == 0


def test_a_text_in_a_third_of_the_rows(spark):
    from pyspark.sql import functions as F

    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    out = {r["doc_id"]: r for r in X.membership(rows).collect()}
    assert out[0]["group_size"] == 1000 and out[0]["keep_id"] == 2997 and out[2997]["kept"] and not out[0]["kept"]
    assert sum(r["kept"] for r in out.values()) == 2001


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=6), max_size=40), st.sampled_from([1, 2000, 1 << 20]))
def test_trie_with_spill(keys, limit):
    trie, exp = X.SpillingTrie(lambda a, b: a + b, limit), defaultdict(int)
    for k in keys:
        trie.insert(k, 1)
        exp[k] += 1
    assert dict(trie.drain()) == dict(exp)


def test_tries_of_a_task_branch_and_spill(corpus):
    """What the query runs, on a task's rows: a trie holds all texts of a
    length, so strings share edges, and a small bound makes it spill."""
    rows = [(len(t.encode()) // 4096, t.encode(), (i, 0, 1, [i])) for i, t in corpus]  # lengths in classes, so that many meet
    rows.sort(key=lambda r: r[0])
    exp = defaultdict(list)
    for i, t in corpus:
        exp[t.encode()].append(i)
    for limit, spills in ((1 << 30, False), (20_000, True)):
        told = X.Told()
        out = dict(X.owned(iter(rows), X._later, limit, told))
        assert {t: (v[0], v[2]) for t, v in out.items()} == {t: (max(i), len(i)) for t, i in exp.items()}
        assert told.branches > 20 and bool(told.spills) == spills


def test_the_query_with_spilling_tries(spark):
    """Texts of one length, many with a long common beginning, tries of 2,000 bytes."""
    rows = [(i, ("common beginning " * 5)[: 30 + i % 40] + f"{(i * 37) % 300:05d}".ljust(70 - i % 40, "x")) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["text"]: (r["keep_id"], r["group_size"]) for r in X.owners(df, with_text=True, spill_bytes=2000).collect()}
    exp = defaultdict(list)
    for i, t in rows:
        exp[t].append(i)
    assert len({len(t) for t in exp}) == 1 and out == {t: (max(i), len(i)) for t, i in exp.items()}


def test_tied_rows_are_decided_by_their_payload(spark):
    rows = [(1, "t", lang, s) for lang, s in (("en", "a"), ("de", "b"), ("fr", "c"), (None, "d"))] + [(2, None, "en", "n"), (2, None, "es", "m")]
    kept = set()
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        for parts in (1, 3):
            df = spark.createDataFrame(order, "doc_id long, text string, lang string, source string").repartition(parts)
            kept.add(tuple(sorted(map(tuple, X.survivors(df).collect()), key=str)))
    assert len(kept) == 1
    assert sorted(r[1] or "null" for r in kept.pop()) == ["null", "t"]  # a null text stays null


def test_hot_texts_fold_in_groups_of_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(X, "FAN_IN", 4)
    monkeypatch.setattr(X, "FOLD_BYTES", 4000)
    rows = spark.range(0, 6000, 1, 24).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.repeat(F.lit("hot"), 50)).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(
        F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    out = {r["doc_id"]: r for r in X.membership(rows).collect()}
    assert len(out) == 6000 and out[0]["group_size"] == 2000 and out[0]["keep_id"] == 5997 and out[1]["keep_id"] == 5998
    assert sum(r["kept"] for r in out.values()) == 2002
