"""Block filters, several writers, compaction during reads, time limits."""
import threading
import time

import pytest
from pyspark.sql import functions as F

from covenant.operators import bloom as B, checks as C, governance as G, results as R
from covenant.plans import pipeline as PL
from covenant.plans.workspace import Workspace
from covenant.sources import registry as RG
from covenant.sources.tables import TableSet


@pytest.mark.parametrize("limit", [B.MAX_BYTES, 0])
def test_large_orphans_equal_the_plain_check(spark, limit):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 != 0, F.col("id")).alias("k"))
    ref = spark.range(100_000).select((F.col("id") * 2 + F.when(F.col("id") % 5 == 0, 0.5).otherwise(0)).alias("r"))
    want = sorted(map(tuple, C.orphan_keys(df, "k", ref, "r").collect()))
    assert sorted(map(tuple, B.large_orphans(df, "k", ref, "r", limit).collect())) == want and len(want) > 1000
    assert B.large_orphans(df.limit(0), "k", ref, "r").count() == 0
    assert B.large_orphans(df, "k", ref.limit(0), "r").count() == df.dropna().distinct().count()


def test_the_filter_cuts_the_reference(spark):
    keys = spark.range(2000).select((F.col("id") * 97).alias("k"))
    blocks = B.blocks_for(2000)
    made = B.block_filter(keys, "k", blocks)
    ref = spark.range(200_000).select(F.col("id").alias("k"))
    kept = B.may_hold(ref, "k", made, blocks).filter("may_hold")
    assert kept.join(keys, "k").count() == 2000  # none is lost
    assert kept.count() < 2000 + 0.03 * 200_000
    assert made.agg(F.max(F.length("bits"))).first()[0] * blocks <= blocks * B.BLOCK_BITS // 8


def rows(spark, names, owner="o"):
    return spark.createDataFrame([(n, "public", owner, "1.0.0") for n in names], "table_name string, schema_name string, owner string, version string")


def test_two_writers_at_a_time(spark, tmp_path):
    root, errors = str(tmp_path / "reg"), []
    RG.commit_snapshot(RG.upsert(rows(spark, []), rows(spark, ["base"]), "2024-01-01").drop("action"), root)

    def writer(i):
        try:
            RG.change_snapshot(spark, root, lambda now: RG.upsert(now, rows(spark, [f"t{i}"]), "2024-01-02").drop("action"))
        except Exception as exc:  # noqa: BLE001
            errors.append(exc)

    threads = [threading.Thread(target=writer, args=(i,)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    assert sorted(r["table_name"] for r in RG.read_snapshot(spark, root).collect()) == ["base", "t0", "t1", "t2"]
    assert RG.snapshot_versions(spark, root) == [1, 2, 3, 4]
    assert RG.read_snapshot(spark, root, 1).count() == 1
    with pytest.raises(RG.Conflict):
        RG.commit_snapshot(rows(spark, ["x"]), root, after=2)
    assert len([p for p in (tmp_path / "reg").iterdir() if p.name.startswith("data-")]) == 4  # the refused one is gone


def test_an_empty_commit_is_passed_over(spark, tmp_path):
    root = str(tmp_path / "reg")
    RG.commit_snapshot(rows(spark, ["a"]), root)
    (tmp_path / "reg" / "_commits" / f"{2:020d}").write_text("")
    assert RG.read_snapshot(spark, root).count() == 1
    assert RG.change_snapshot(spark, root, lambda now: now.unionByName(rows(spark, ["b"]))) == 3
    assert RG.read_snapshot(spark, root).count() == 2


def test_captures_do_not_share_a_write(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path / "ws"), tables={"t": spark.range(1)})
    assert ws.current_metrics("2024-01-01 00:00:00").count() == 1  # no contract, no log: captured
    threads = [threading.Thread(target=ws.capture_snapshot, args=(f"2024-01-0{i} 00:00:00",)) for i in (2, 3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert ws._metrics().count() == 3 and str(ws.current_metrics().first()["captured_at"])[:10] == "2024-01-03"
    assert ws.trends(3650, "2024-02-01 00:00:00").count() == 3


def log_of(spark, run, day, n=2):
    return spark.range(n).select(F.lit(run).alias("run_id"), F.concat(F.lit("t"), "id").alias("table_name"), F.lit("public").alias("schema_name"),
                                 F.lit("passed").alias("overall_status"), F.to_timestamp_ntz(F.lit(f"2024-01-{day:02d} 10:00:00")).alias("executed_at"),
                                 F.lit(None).cast("string").alias("failed_check_names"))


def test_compaction_while_reading(spark, tmp_path):
    path = str(tmp_path / "log")
    for i in range(6):
        R.append_log(log_of(spark, f"r{i}", 1 + i // 2), path)

    def state():
        return sorted((r["run_id"], r["table_name"], str(r["executed_at"]), str(r["run_date"])) for r in R.read_log(spark, path).collect())

    before, reader = state(), R.read_log(spark, path)  # resolved before the switch
    assert R.compact_log(spark, path, "2024-01-03") == 1
    assert state() == before and reader.count() == 12
    assert R.drop_compacted(spark, path) > 0 and state() == before
    files = [f for f in (tmp_path / "log").rglob("*.parquet") if "_compacted" not in str(f)]
    assert {f.parent.parent.name for f in files} == {"run_date=2024-01-03"}
    # a compacted run is written again, and another run comes
    R.append_log(log_of(spark, "r0", 1, 1), path)
    R.append_log(log_of(spark, "r9", 9), path)
    after = state()
    assert [r for r in after if r[0] == "r0"] == [before[0]] and len(after) == 12 - 1 + 2
    assert R.compact_log(spark, path, "2024-01-31") == 2
    assert state() == after
    R.drop_compacted(spark, path)
    assert state() == after and G.latest_per_table(R.read_log(spark, path).withColumns({c: F.lit(0) for c in G.SUMMARY_COLUMNS if c not in R.read_log(spark, path).columns})).count() == 2


def test_compaction_of_a_large_run_is_shared_out(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    R.append_log(log_of(spark, "r0", 1, 4000).coalesce(1), path)
    R.append_log(log_of(spark, "r1", 2, 10), path)

    def state():
        return sorted(map(str, R.read_log(spark, path).select("run_id", "table_name", "executed_at", "run_date").collect()))

    before = state()
    size = max(f.stat().st_size for f in (tmp_path / "log").rglob("*.parquet"))
    monkeypatch.setattr(R, "COMPACTED_FILE_BYTES", size // 3)
    R.compact_log(spark, path, "2024-01-03")
    assert state() == before
    per_file = [spark.read.parquet(str(f)).count() for f in (tmp_path / "log" / "_compacted").rglob("*.parquet")]
    assert sum(per_file) == 4010 and max(per_file) < 2000
    monkeypatch.setattr(R, "COMPACTED_FILE_BYTES", 1 << 30)
    R.drop_compacted(spark, path)
    R.compact_log(spark, path, "2024-01-03")
    R.drop_compacted(spark, path)
    assert state() == before
    assert len(list((tmp_path / "log" / "_compacted").rglob("*.parquet"))) == 1


def test_a_slow_table_is_cut_off_and_the_others_run(spark, tmp_path):
    slow = {"table_name": "slow", "columns": [{"name": "id", "type": "integer"}],
            "quality_rules": [{"rule_type": "custom_sql", "parameters": {"expression": "aggregate(sequence(1, cast(2000000 + id as int)), 0L, (a, x) -> a + x) > 0"}}]}
    quick = [{"table_name": f"quick{i}", "columns": [{"name": "id", "type": "integer"}]} for i in range(3)]
    tables = TableSet({"slow": spark.range(40_000).repartition(8), **{q["table_name"]: spark.range(5) for q in quick}})
    t0 = time.monotonic()
    checks = PL.run_contracts(spark, [slow, *quick], tables, str(tmp_path), concurrent=2, timeout_seconds=8)
    assert time.monotonic() - t0 < 60  # some ten minutes otherwise
    got = {r["table_name"]: (r["check_name"], r["status"], r["message"]) for r in checks.filter("status <> 'passed'").collect()}
    assert got == {"slow": (C.CONTRACT_ERROR, "error", "checks did not end within 8 seconds")}
    runs = {r["table_name"]: r["overall_status"] for r in R.rollup_runs(checks).collect()}
    assert runs == {"slow": "error", "quick0": "passed", "quick1": "passed", "quick2": "passed"}
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None
