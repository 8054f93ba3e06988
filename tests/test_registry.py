from datetime import datetime

from pyspark.sql import functions as F

from covenant.operators.governance import metrics
from covenant.plans.contracts import contracts_df, sample_contract
from covenant.sources.registry import delete, insert_ignore, lint_contracts, upsert


def test_lint_reports_every_error(spark):
    bad = {"table_name": "bad-name", "owner": "", "version": "1.0",
           "columns": [{"name": "ok"}, {"name": "x y", "type": "varchar2"}],
           "quality_rules": [{"rule_type": "min_value", "column": "ok"},
                             {"rule_type": "nope", "severity": "fatal"}],
           "freshness": {"timestamp_column": "ts", "max_delay_minutes": 0}}
    df = contracts_df(spark, [bad, sample_contract("orders")])
    got = {(r["path"], r["error"]) for r in lint_contracts(df).collect()}
    assert ("table_name", "invalid characters") in got
    assert ("owner", "required") in got
    assert ("version", "invalid version") in got
    assert ("columns[1].name", "invalid characters") in got
    assert ("columns[1].type", "invalid column type varchar2") in got
    assert ("quality_rules[0].parameters.value", "required") in got
    assert ("quality_rules[1].rule_type", "invalid rule type nope") in got
    assert ("quality_rules[1].severity", "invalid severity") in got
    assert ("freshness.max_delay_minutes", "out of range") in got
    assert all(r["table_name"] == "bad-name" for r in lint_contracts(df).collect())


def test_upsert_keeps_created_at(spark):
    t0 = datetime(2024, 1, 1)
    cur = spark.createDataFrame([("a", "public", "1.0.0", t0, t0), ("b", "public", "1.0.0", t0, t0)],
                                "table_name string, schema_name string, version string, "
                                "created_at timestamp_ntz, updated_at timestamp_ntz")
    inc = spark.createDataFrame([("a", "public", "2.0.0"), ("c", "public", "1.0.0")],
                                "table_name string, schema_name string, version string")
    got = {r["table_name"]: r for r in upsert(cur, inc, "2024-02-01 00:00:00").collect()}
    assert got["a"]["created_at"] == t0 and got["a"]["updated_at"] == datetime(2024, 2, 1)
    assert got["a"]["version"] == "2.0.0" and got["a"]["action"] == "updated"
    assert got["b"]["action"] == "kept" and got["b"]["updated_at"] == t0
    assert got["c"]["action"] == "inserted" and got["c"]["created_at"] == datetime(2024, 2, 1)


def test_delete_reports_hits(spark):
    cur = spark.createDataFrame([("a", "public"), ("b", "public")], "table_name string, schema_name string")
    keys = spark.createDataFrame([("a", "public"), ("z", "public")], "table_name string, schema_name string")
    remaining, report = delete(cur, keys)
    assert [r["table_name"] for r in remaining.collect()] == ["b"]
    assert {r["table_name"]: r["deleted"] for r in report.collect()} == {"a": True, "z": False}


def test_insert_ignore_nulls_never_conflict(spark):
    target = spark.createDataFrame([("x@e.com",)], "email string")
    inc = spark.createDataFrame([(1, "x@e.com"), (2, "y@e.com"), (3, "y@e.com"), (4, None), (5, None)],
                                "id int, email string")
    got = sorted(r["id"] for r in insert_ignore(target, inc, "email", F.col("id").asc()).collect())
    assert got == [2, 4, 5]


def test_metric_percentages(spark):
    df = spark.createDataFrame([(3, 2, 0, 0, 0, 0), (0, 0, 3, 2, 1, 8)],
                               "total_tables long, tables_with_contracts long, total_checks_run long, "
                               "total_checks_passed long, tables_within_sla long, tables_with_freshness_sla long")
    rows = metrics(df).collect()
    assert (rows[0]["contract_coverage_pct"], rows[0]["quality_pass_rate_pct"], rows[0]["sla_compliance_pct"]) \
        == (66.67, 0.0, 100.0)
    assert (rows[1]["contract_coverage_pct"], rows[1]["quality_pass_rate_pct"], rows[1]["sla_compliance_pct"]) \
        == (0.0, 66.67, 12.5)


def test_upsert_collapses_duplicate_incoming_keys(spark):
    cur = spark.createDataFrame([("a", "public", "1.0.0")], "table_name string, schema_name string, version string")
    inc = spark.createDataFrame([("a", "public", "1.10.0"), ("a", "public", "1.9.0"), ("a", "public", "next")],
                                "table_name string, schema_name string, version string")
    got = upsert(cur, inc, "2024-02-01 00:00:00").collect()
    assert len(got) == 1 and got[0]["version"] == "1.10.0"


def test_snapshots_are_versioned(spark):
    import tempfile

    from covenant.sources.registry import commit_snapshot, read_snapshot, snapshot_versions
    root = tempfile.mkdtemp(prefix="registry-")
    assert read_snapshot(spark, root) is None
    one = spark.createDataFrame([("a", "public")], "table_name string, schema_name string")
    assert commit_snapshot(one, root) == 1
    cur = read_snapshot(spark, root)
    nxt = cur.unionByName(spark.createDataFrame([("b", "public")], "table_name string, schema_name string"))
    assert commit_snapshot(nxt, root) == 2   # reads v=1 while writing v=2
    assert snapshot_versions(spark, root) == [1, 2]
    assert sorted(r["table_name"] for r in read_snapshot(spark, root).collect()) == ["a", "b"]


def test_generated_ids_fill_a_numeric_key(spark):
    from covenant.sources.registry import insert_defaults
    df = spark.createDataFrame([(1, None), (None, "x")], "id long, s string")
    rows = insert_defaults(df, {"id": F.expr("uuid()"), "s": F.lit("new"), "n": F.lit(0)}).collect()
    assert rows[0]["id"] == "1" and len(rows[1]["id"]) == 36 and rows[0]["s"] == "new" and rows[1]["n"] == 0


def test_staging_refuses_a_missing_tie_break(spark):
    import pytest

    from covenant.operators.models import ORDER_COLUMNS, stg_orders
    df = spark.createDataFrame([], ", ".join(f"{c} string" for c in ORDER_COLUMNS))
    with pytest.raises(ValueError, match="version"):
        stg_orders(df)
    assert stg_orders(df, tie_break=()).count() == 0


def test_tables_are_listed_anew(spark, tmp_path):
    from covenant.sources.tables import read_table, table_exists
    assert not table_exists(spark, "t", str(tmp_path))
    spark.range(10).write.parquet(str(tmp_path / "t.parquet"))
    assert table_exists(spark, "t", str(tmp_path)) and read_table(spark, str(tmp_path), "t").count() == 10
    spark.range(5).write.mode("append").parquet(str(tmp_path / "t.parquet"))
    assert read_table(spark, str(tmp_path), "t").count() == 15
