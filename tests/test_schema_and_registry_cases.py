"""Cases modelled on the reference's own test suites (validator, registry,
planner): type map completeness, missing columns, lookups that find
nothing, plan entries per column and rule."""
from datetime import date, datetime
from decimal import Decimal

from covenant.operators.checks import evaluate_contract, spark_type_name, type_matches
from covenant.plans.checkplan import check_name, plan_contract
from covenant.plans.contracts import ACCEPTED_SPARK_TYPES, COLUMN_TYPES, contracts_df, sample_contract
from covenant.sources.registry import get_contract, missing_columns_many, required_columns, schema_checks_many
from covenant.sources.tables import TableSet

AS_OF = "2024-02-01 00:00:00"


def test_every_contract_type_has_accepted_spark_types():
    assert set(ACCEPTED_SPARK_TYPES) == set(COLUMN_TYPES)
    assert all(ACCEPTED_SPARK_TYPES[t] for t in COLUMN_TYPES)


def test_type_checks_on_every_type(spark):
    df = spark.createDataFrame(
        [("a", "b", 1, 2.0, True, date(2024, 1, 1), datetime(2024, 1, 1), Decimal("1.50"), "u")],
        "s string, t string, i long, f double, b boolean, d date, ts timestamp, dec decimal(12,2), u string")
    cols = [("s", "string"), ("t", "text"), ("i", "integer"), ("f", "float"), ("b", "boolean"),
            ("d", "date"), ("ts", "timestamp"), ("dec", "decimal"), ("u", "uuid")]
    for (name, ctype), field in zip(cols, df.schema.fields):
        assert type_matches(ctype, field.dataType), (ctype, spark_type_name(field.dataType))
    assert not type_matches("integer", df.schema["f"].dataType)
    assert not type_matches("date", df.schema["ts"].dataType)
    contract = {"table_name": "all_types", "owner": "x",
                "columns": [{"name": n, "type": t} for n, t in cols]}
    out = {r["check_name"]: r["status"] for r in evaluate_contract(spark, df, contract, TableSet(), AS_OF).collect()}
    assert all(v == "passed" for k, v in out.items() if k.startswith("column_"))


def test_missing_column_fails_exists_and_skips_type(spark):
    df = spark.createDataFrame([(1,)], "id long")
    contract = {"table_name": "t", "owner": "x",
                "columns": [{"name": "id", "type": "integer"}, {"name": "missing_col", "type": "string"}]}
    out = {r["check_name"]: r for r in evaluate_contract(spark, df, contract, TableSet(), AS_OF).collect()}
    assert out["column_exists_id"]["status"] == "passed"
    assert out["column_exists_missing_col"]["status"] == "failed"
    assert "column_type_missing_col" not in out
    assert "defined in contract but not found" in out["column_exists_missing_col"]["message"]


def test_upper_case_column_is_missing_like_the_reference(spark):
    df = spark.createDataFrame([(1,)], "ID long")
    contract = {"table_name": "t", "owner": "x", "columns": [{"name": "ID", "type": "integer"}]}
    out = {r["check_name"]: r["status"] for r in evaluate_contract(spark, df, contract, TableSet(), AS_OF).collect()}
    assert out["column_exists_id"] == "failed"   # contract names are lower-cased, compared exactly (Q21)


def test_plan_entries_per_column_and_rule():
    plan = plan_contract(sample_contract("orders"))
    names = [check_name(s, plan) for s in plan]
    assert names[:2] == ["column_exists_order_id", "column_type_order_id"]
    assert "unique_order_id" in names and "referential_integrity_customer_id" in names
    merged = [s for s in plan if s.check_type == "not_null" and s.column == "customer_id"][0]
    assert merged.origin == "implicit+rule"
    rc = [s for s in plan if s.check_type == "row_count_min"][0]
    assert rc.severity == "error" and rc.origin == "implicit"
    assert [s.params["min_count"] for s in plan if s.check_type == "row_count_min"] == [1, 25]
    assert [s.check_type for s in plan][-1] == "freshness"


def test_lookups_that_find_nothing_and_required_columns(spark):
    reg = contracts_df(spark, [sample_contract("orders"), sample_contract("customers")])
    assert get_contract(reg, "orders").count() == 1
    assert get_contract(reg, "orders", "other").count() == 0
    rc = {r["table_name"]: r for r in required_columns(reg).collect()}
    assert rc["customers"]["required_columns"] == ["customer_id", "email", "country", "updated_at"]
    assert rc["orders"]["primary_key_columns"] == ["order_id"]


def warehouse(spark):
    """Contracts a and b, an inventory that lacks b, and the columns of a but one."""
    docs = [{"table_name": t, "schema_name": "s", "columns": [{"name": "id", "type": "integer"}, {"name": "note", "type": "string"}]} for t in ("a", "b")]
    inventory = spark.createDataFrame([("s", "a"), ("s", "a")], "table_schema string, table_name string")
    columns = spark.createDataFrame([("s", "a", "id", "double")], "table_schema string, table_name string, column_name string, data_type string")
    return contracts_df(spark, docs), inventory, columns


def broadcasts(df):
    """Broadcasts of the plan before it runs."""
    return df._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin")


def test_inventory_and_catalog_are_not_broadcast_in_schema_checks(spark):
    out = schema_checks_many(spark, *warehouse(spark))
    assert broadcasts(out) == 1  # the accepted types, a fixed table
    assert sorted((r["table_name"], r["check_type"], r["column"], r["status"]) for r in out.fillna("", ["column"]).collect()) == [
        ("a", "column_exists", "id", "passed"), ("a", "column_exists", "note", "failed"), ("a", "column_type", "id", "failed"), ("b", "table_exists", "", "failed")]


def test_catalog_is_not_broadcast_for_missing_columns(spark):
    contracts, _, columns = warehouse(spark)
    out = missing_columns_many(contracts, columns)
    assert broadcasts(out) == 0
    assert [tuple(r) for r in out.collect()] == [("a", "s", "note")]
