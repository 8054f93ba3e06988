"""STR1 across micro-batches: duplicates and orphans of several batches,
replays, late references, horizons."""
import os
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from covenant.operators import checks as C
from covenant.streaming import stateful as S

SCHEMA = "k long, part string, ts timestamp_ntz, v long"
T0 = datetime(2024, 1, 1)


def land(spark, folder, rows, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    newest = max((folder / f for f in os.listdir(folder) if f.endswith(".parquet") and f.startswith("part-")), key=lambda p: p.stat().st_mtime_ns)
    newest.rename(folder / f"{name}.parquet")


def unique(spark, tmp_path, **more):
    schema = spark.createDataFrame([], SCHEMA).schema
    q, sink = S.start_unique_gate(spark, str(tmp_path / "in"), schema, "t", ["k", "part"], base_dir=str(tmp_path / "gate"), max_files_per_trigger=1, **more)
    q.awaitTermination()
    return sink, S.duplicate_totals(spark, sink, ["k", "part"]).first()


ROWS = [[(1, "a", T0, 0), (2, "a", T0, 0), (2, "a", T0, 1), (None, "a", T0, 0)], [(1, "a", T0, 5), (3, None, T0, 0), (3, None, T0, 0)],
        [(4, "b", T0, 0), (1, "a", T0, 7), (5, "c", T0, 0)] + [(9, "hot", T0, i) for i in range(5000)]]


def test_duplicates_across_batches_restart_and_replay(spark, tmp_path):
    (tmp_path / "in").mkdir()
    land(spark, tmp_path / "in", ROWS[0], "f0")
    _, total = unique(spark, tmp_path)
    assert tuple(total) == (1, 2, 0)
    for i in (1, 2):
        land(spark, tmp_path / "in", ROWS[i], f"f{i}")
    sink, total = unique(spark, tmp_path)  # goes on from its checkpoint
    assert tuple(total) == (3, 2 + 3 + 5000, 1)
    whole = C.unique_summary(spark.read.parquet(str(tmp_path / "in")), ["k", "part"]).first()
    assert tuple(total)[:2] == tuple(whole)
    # the last batch runs again: its commit is lost
    commits = next((tmp_path / "gate").glob("*/checkpoint/commits"))
    last = max(int(f.name) for f in commits.iterdir() if f.name.isdigit())
    (commits / str(last)).unlink()
    (commits / f".{last}.crc").unlink(missing_ok=True)
    _, again = unique(spark, tmp_path)
    assert tuple(again) == tuple(total)


def test_horizon_lets_go_of_old_keys(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, (key, minutes) in enumerate([(1, 0), (2, 5), (1, 8), (3, 500), (4, 1000), (2, 1001), (5, 1500)]):
        land(spark, tmp_path / "in", [(key, "a", T0 + timedelta(minutes=minutes), 0)], f"f{i}")
    _, total = unique(spark, tmp_path, time_column="ts", horizon_minutes=60)
    assert tuple(total) == (1, 2, 1)  # key 1 within the hour; key 2 came back after it was let go


def test_state_is_asked_once_a_bucket(spark, tmp_path, monkeypatch):
    """Keys of several types in few buckets: each keeps its own count and its own horizon."""
    monkeypatch.setattr(S, "BUCKETS", 3)
    schema = "k long, part string, day date, amount decimal(12,2), at timestamp, ts timestamp_ntz"
    rows = [[(i, f"p{i % 7}", T0.date(), Decimal(i) / 4, T0, T0 + timedelta(minutes=60 * b + i % 50)) for i in range(b, 400, b + 1)] for b in range(3)]
    for b, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{b}"))
    keys = ["k", "part", "day", "amount", "at"]
    whole = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    flat = str(tmp_path / "flat")
    for b in range(3):
        whole.filter(F.col("_metadata.file_path").contains(f"/b{b}/")).coalesce(1).write.mode("append").parquet(flat)
    state = []
    for name, more in (("all", {}), ("near", {"time_column": "ts", "horizon_minutes": 10_000})):
        q, sink = S.start_unique_gate(spark, flat, whole.schema, "t", keys, base_dir=str(tmp_path / name), max_files_per_trigger=1, **more)
        q.awaitTermination()
        total = S.duplicate_totals(spark, sink, keys).first()
        assert tuple(total)[:2] == tuple(C.unique_summary(whole, keys).first()) and total["keys_across_batches"] == total["duplicate_keys"] > 200
        log = spark.read.parquet(sink)
        assert log.filter("rows_now <= rows_before or rows_now < 2").count() == 0
        state.append(max(p["numRowsTotal"] for x in q.recentProgress for p in x["stateOperators"]))
    assert state[0] == 3


def test_horizon_needs_a_time(spark, tmp_path):
    with pytest.raises(ValueError):
        S.start_unique_gate(spark, str(tmp_path), spark.createDataFrame([], SCHEMA).schema, "t", ["k"], horizon_minutes=5)


def test_orphans_and_late_references(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(ROWS):
        land(spark, tmp_path / "in", rows, f"f{i}")
    ref = spark.createDataFrame([(1,), (9,)], "id long")
    q, sink = S.start_reference_gate(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema, "t", "k", lambda: ref, "id",
                                     base_dir=str(tmp_path / "gate"), max_files_per_trigger=1)
    q.awaitTermination()
    assert sorted(map(tuple, S.open_orphans(spark, sink, "k", ref, "id").collect())) == [(2, 2), (3, 2), (4, 1), (5, 1)]
    late = ref.union(spark.createDataFrame([(3,)], "id long"))
    assert sorted(map(tuple, S.open_orphans(spark, sink, "k", late, "id").collect())) == [(2, 2), (4, 1), (5, 1)]


def test_contract_gates(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(ROWS):
        land(spark, tmp_path / "in", rows, f"f{i}")
    contract = {"table_name": "t", "columns": [{"name": "k", "type": "integer", "primary_key": True}],
                "quality_rules": [{"rule_type": "min_value", "column": "v", "parameters": {"value": 1}},
                                  {"rule_type": "referential_integrity", "column": "k", "parameters": {"reference_table": "r", "reference_column": "id"}}]}
    gates = S.start_contract_gates(spark, contract, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema,
                                   lambda name: spark.range(6), base_dir=str(tmp_path / "gate"))
    for q, _ in gates.values():
        q.awaitTermination()
    assert sorted(gates) == ["referential_integrity_k", "rows", "unique_k"]
    assert tuple(S.duplicate_totals(spark, gates["unique_k"][1], ["k"]).first())[:2] == (4, 3 + 2 + 2 + 5000)
    assert [tuple(r) for r in S.open_orphans(spark, gates["referential_integrity_k"][1], "k", spark.range(6).select(F.col("id")), "id").collect()] == [(9, 5000)]
