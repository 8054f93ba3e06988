"""Checks on new data only, against a full run of the same contract."""
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from covenant.operators import checks as C
from covenant.plans import incremental as I
from covenant.plans.incremental import IncrementalChecks
from covenant.sources.tables import TableSet

T0 = datetime(2024, 1, 1)
SCHEMA = "id long, parent long, kind string, amount decimal(12,2), at timestamp_ntz, path string, length long"
CONTRACT = {
    "table_name": "items", "columns": [{"name": "id", "type": "integer", "primary_key": True, "nullable": False}, {"name": "kind", "type": "string"}],
    "quality_rules": [
        {"rule_type": "accepted_values", "column": "kind", "parameters": {"values": ["a", "b"]}, "severity": "warning"},
        {"rule_type": "min_value", "column": "amount", "parameters": {"value": 0}}, {"rule_type": "max_value", "column": "amount", "parameters": {"value": 50.5}},
        {"rule_type": "row_count_min", "parameters": {"min_count": 9}}, {"rule_type": "regex_match", "column": "path", "parameters": {"pattern": "^/"}},
        {"rule_type": "unique", "parameters": {"columns": ["kind", "parent"]}},
        {"rule_type": "referential_integrity", "column": "parent", "parameters": {"reference_table": "parents", "reference_column": "id"}},
        {"rule_type": "custom_sql", "parameters": {"sql": "SELECT id FROM {table} WHERE length > 5"}},
        {"rule_type": "custom_sql", "parameters": {"expression": "id <> 4"}},
        {"rule_type": "min_value", "column": "no_such", "parameters": {"value": 0}}],
    "freshness": {"timestamp_column": "at", "max_delay_minutes": 60},
}


def row(i, parent=1, kind="a", amount=1, minutes=0, path="/x", length=1):
    return (i, parent, kind, amount, T0 + timedelta(minutes=minutes), path, length)


def land(spark, folder, rows, files=1):
    from decimal import Decimal
    spark.createDataFrame([(r[0], r[1], r[2], Decimal(r[3]), *r[4:]) for r in rows], SCHEMA).repartition(files).write.mode("append").parquet(folder)


def same_as_whole(spark, run, folder, tables):
    whole = C.evaluate_contract(spark, spark.read.parquet(folder), CONTRACT, tables, "2024-01-01 02:00:00")
    assert sorted(map(str, run.checks.collect())) == sorted(map(str, whole.collect()))


@pytest.fixture
def parents(spark):
    return TableSet({"parents": spark.range(3)})


def test_only_new_files_are_read(spark, tmp_path, parents):
    folder, as_of = str(tmp_path / "a b+%41"), "2024-01-01 02:00:00"
    job = IncrementalChecks(spark, CONTRACT, folder, str(tmp_path / "root"), parents)
    land(spark, folder, [row(i, i % 3) for i in range(8)], 3)
    first = job.run(as_of)
    assert (first.files, first.files_read, first.rows_read) == (3, 3, 8)
    same_as_whole(spark, first, folder, parents)
    again = job.run(as_of)
    assert (again.files_read, again.rows_read) == (0, 0)
    same_as_whole(spark, again, folder, parents)
    # a duplicate, orphans and a later time in a file of its own
    land(spark, folder, [row(3, 7, "c", -5, 55), row(100, 7, None, 99, 61, "y", 9), (None, None, None, 0, None, None, None)])
    second = job.run(as_of)
    assert (second.files, second.files_read, second.rows_read) == (4, 1, 3)
    same_as_whole(spark, second, folder, parents)


def test_removed_and_rewritten_files(spark, tmp_path, parents):
    folder, as_of = tmp_path / "in", "2024-01-01 02:00:00"
    job = IncrementalChecks(spark, CONTRACT, str(folder), str(tmp_path / "root"), parents)
    land(spark, str(folder), [row(i, i % 3) for i in range(6)])
    one = next(folder.glob("*.parquet"))
    land(spark, str(folder), [row(3, 9, "z", -1), row(8)])
    two = next(f for f in folder.glob("*.parquet") if f != one)
    assert job.run(as_of).files_read == 2
    two.unlink()
    run = job.run(as_of)
    assert (run.files, run.files_read) == (1, 0)
    same_as_whole(spark, run, str(folder), parents)
    # the same name with other rows
    land(spark, str(tmp_path / "other"), [row(50, 2, "b", 70), row(50, 2, "b", 7)])
    for crc in folder.glob(".*.crc"):
        crc.unlink()
    next((tmp_path / "other").glob("*.parquet")).replace(one)
    run = job.run(as_of)
    assert (run.files, run.files_read, run.rows_read) == (1, 1, 2)
    same_as_whole(spark, run, str(folder), parents)
    assert job.vacuum() == 1
    after = job.run(as_of)
    assert after.files_read == 0
    same_as_whole(spark, after, str(folder), parents)


def test_the_reference_may_change(spark, tmp_path, parents):
    folder = str(tmp_path / "in")
    land(spark, folder, [row(1, 5), row(2, 1)])
    job = IncrementalChecks(spark, CONTRACT, folder, str(tmp_path / "root"), parents)

    def orphans():
        run = job.run(T0)
        return run.files_read, run.checks.filter("check_type = 'referential_integrity'").first()["violations"]

    assert orphans() == (1, 1)
    parents.add("parents", spark.range(9))
    assert orphans() == (0, 0)


def test_another_plan_reads_anew_and_unfinished_runs_do_not_count(spark, tmp_path, parents):
    folder = str(tmp_path / "in")
    land(spark, folder, [row(i, i % 3) for i in range(4)])
    job = IncrementalChecks(spark, CONTRACT, folder, str(tmp_path / "root"), parents)
    assert job.run(T0).files_read == 1
    less = {**CONTRACT, "quality_rules": CONTRACT["quality_rules"][:2]}
    assert IncrementalChecks(spark, less, folder, str(tmp_path / "root"), parents).run(T0).files_read == 1
    # the keys of a run without its rows: the run had not ended
    for rows in (tmp_path / "root" / "states").glob("*/*/rows"):
        for f in rows.rglob("*_SUCCESS*"):
            f.unlink()
    again = job.run("2024-01-01 02:00:00")
    assert again.files_read == 1
    same_as_whole(spark, again, folder, parents)


def test_files_without_rows(spark, tmp_path, parents):
    folder = str(tmp_path / "in")
    land(spark, folder, [])
    job = IncrementalChecks(spark, CONTRACT, folder, str(tmp_path / "root"), parents)
    run = job.run("2024-01-01 02:00:00")
    same_as_whole(spark, run, folder, parents)
    assert job.run(T0).files_read == 0
    assert run.checks.filter(F.col("check_type") == "row_count_min").count() == 2


def test_a_file_of_many_keys_is_not_held_by_the_task_that_reads_it(spark):
    rows = spark.range(0, 30_000, 1, 1).select(F.lit(0).cast("long").alias("__file"), F.when(F.col("id") < 20_000, 7).otherwise(F.col("id")).alias("key0"))
    few = I._folded(rows)
    assert 10_000 < few.count() < 10_100  # the hot key: a row for each record batch
    sums = I._counted(few, ["__file", "key0"])
    plan = sums._jdf.queryExecution().sparkPlan().toString()
    sums.collect()
    executed = sums._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "HashAggregate" in plan and "HashAggregate" not in executed.split("Exchange hashpartitioning")[-1]
    got = {r["key0"]: r["n"] for r in sums.collect()}
    assert len(got) == 10_001 and got[7] == 20_000 and got[20_000] == 1


def test_keys_that_arrow_does_not_group(spark, tmp_path):
    folder = str(tmp_path / "t")
    contract = {"table_name": "t", "columns": [{"name": "pair", "type": "string"}], "quality_rules": [{"rule_type": "unique", "column": "pair"}]}
    job = IncrementalChecks(spark, contract, folder, str(tmp_path / "root"))
    for _ in range(2):
        spark.sql("SELECT struct(id % 5 AS a, 'x' AS b) AS pair FROM range(4)").coalesce(1).write.mode("append").parquet(folder)
        run = job.run(T0)
    found = run.checks.filter("check_type = 'unique'").first()
    assert (run.files_read, found["violations"], found["message"]) == (1, 4, "unique on pair: 4 duplicated values in 8 rows")
