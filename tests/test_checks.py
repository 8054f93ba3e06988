from datetime import datetime

import pytest

from covenant.operators.checks import evaluate_contract, evaluate_rules, violations
from covenant.operators.freshness import freshness_result
from covenant.operators.latest import latest_per_key
from covenant.operators.results import rollup_runs
from covenant.plans.checkplan import plan_contract
from covenant.plans.contracts import sample_contract
from covenant.sources.tables import TableSet

AS_OF = "2024-02-01 00:00:00"


@pytest.fixture(scope="module")
def orders(spark):
    rows = [(1, 10, "completed", 5.0, datetime(2024, 1, 31, 23, 30)),
            (2, 11, "pending", -1.0, datetime(2024, 1, 31, 23, 0)),
            (2, 12, "weird", 3.0, None),
            (None, 10, None, 2.0, datetime(2024, 1, 1))]
    return spark.createDataFrame(rows, "order_id long, customer_id long, status string, "
                                       "total_amount double, updated_at timestamp_ntz")


def _by_name(df):
    return {r["check_name"]: r for r in df.collect()}


def test_plan_goldens():
    assert len(plan_contract(sample_contract("orders"))) == 30
    assert len(plan_contract(sample_contract("customers"))) == 30


def test_missing_table_short_circuits(spark):
    out = _by_name(evaluate_contract(spark, None, sample_contract("orders"), TableSet(), AS_OF))
    assert out["table_exists"]["status"] == "failed"
    assert out["freshness_updated_at"]["status"] == "error"
    assert len(out) == 2


def test_rules_on_hand_made_rows(spark, orders):
    customers = spark.createDataFrame([(10,), (11,)], "customer_id long")
    rules = [
        {"rule_type": "not_null", "column": "order_id"},
        {"rule_type": "unique", "column": "order_id"},
        {"rule_type": "accepted_values", "column": "status",
         "parameters": {"values": ["completed", "pending", None]}},
        {"rule_type": "min_value", "column": "total_amount", "parameters": {"value": 0}},
        {"rule_type": "max_value", "column": "total_amount", "parameters": {"value": 4}, "severity": "warning"},
        {"rule_type": "regex_match", "column": "status", "parameters": {"pattern": "^[a-z]+$"}},
        {"rule_type": "custom_sql", "parameters": {"expression": "customer_id < 12"}},
        {"rule_type": "custom_sql", "parameters": {"sql": "SELECT * FROM {table} WHERE total_amount < 0"}},
        {"rule_type": "row_count_min", "parameters": {"min_count": 5}},
        {"rule_type": "referential_integrity", "column": "customer_id",
         "parameters": {"reference_table": "customers", "reference_column": "customer_id"}},
    ]
    out = evaluate_rules(spark, orders, "orders", rules, TableSet({"customers": customers}))
    got = {(r["check_type"], r["seq"]): (r["status"], r["violations"]) for r in out.collect()}
    assert got[("not_null", 1)] == ("failed", 1)
    assert got[("unique", 2)] == ("failed", 1)
    assert got[("accepted_values", 3)] == ("failed", 1)       # NULL status is not a violation
    assert got[("min_value", 4)] == ("failed", 1)
    assert got[("max_value", 5)] == ("warning", 1)            # severity warning
    assert got[("regex_match", 6)] == ("passed", 0)
    assert got[("custom_sql", 7)] == ("failed", 1)
    assert got[("custom_sql", 8)] == ("failed", 1)
    assert got[("row_count_min", 9)] == ("failed", 1)
    assert got[("referential_integrity", 10)] == ("failed", 1)


def test_missing_column_is_error_not_crash(spark, orders):
    out = evaluate_rules(spark, orders, "orders", [{"rule_type": "not_null", "column": "nope"}])
    assert out.first()["status"] == "error"


def test_violation_rows(spark, orders):
    v = violations(orders, {"rule_type": "min_value", "column": "total_amount", "parameters": {"value": 0}},
                   key_columns=["order_id"])
    assert [tuple(r) for r in v.collect()] == [(2, -1.0)]
    d = violations(orders, {"rule_type": "unique", "column": "order_id"})
    assert [tuple(r) for r in d.collect()] == [(2, 2)]


def test_freshness_states(spark, orders):
    c = {"table_name": "orders", "columns": [{"name": "updated_at"}],
         "freshness": {"timestamp_column": "updated_at", "max_delay_minutes": 60}}
    r = freshness_result(spark, orders, c, AS_OF).first()
    assert r["status"] == "passed" and r["actual_delay_minutes"] == 30.0 and r["is_within_sla"]
    c["freshness"]["max_delay_minutes"] = 15
    assert freshness_result(spark, orders, c, AS_OF).first()["status"] == "failed"
    empty = orders.filter("false")
    assert freshness_result(spark, empty, c, AS_OF).first()["status"] == "failed"
    c["freshness"]["timestamp_column"] = "updated at; drop"
    assert freshness_result(spark, orders, c, AS_OF).first()["status"] == "error"
    assert freshness_result(spark, orders, {"table_name": "x", "columns": []}, AS_OF).first()["status"] == "skipped"


def test_rollup_counts_like_reference(spark):
    rows = [("r", "t", "s", "a", "passed"), ("r", "t", "s", "b", "error"), ("r", "t", "s", "freshness", "passed"),
            ("q", "t", "s", "a", "warning"), ("q", "t", "s", "b", "failed")]
    df = spark.createDataFrame(rows, "run_id string, table_name string, schema_name string, "
                                     "check_type string, status string")
    got = {r["run_id"]: r for r in rollup_runs(df).collect()}
    assert got["r"]["overall_status"] == "passed" and got["r"]["total_checks"] == 3
    assert got["r"]["error_checks"] == 1
    assert got["q"]["overall_status"] == "failed"
    strict = {r["run_id"]: r for r in rollup_runs(df, strict=True).collect()}
    assert strict["r"]["overall_status"] == "error"


def test_latest_per_key_nulls_first_and_tie_break(spark):
    df = spark.createDataFrame([(1, None, 0), (1, datetime(2024, 1, 2), 1), (2, datetime(2024, 1, 1), 0),
                                (2, datetime(2024, 1, 1), 1)], "k int, ts timestamp_ntz, v int")
    out = latest_per_key(df, ["k"], [("ts", "desc", "first")], [("v", "desc", "last")])
    assert sorted((r["k"], r["v"]) for r in out.collect()) == [(1, 0), (2, 1)]


def test_registry_plan_equals_single_contract_plan(spark):
    from covenant.plans.checkplan import plan_many
    from covenant.plans.contracts import contracts_df
    odd = {"table_name": "odd", "columns": [{"name": "a"}], "quality_rules": [
        {"rule_type": "unique", "parameters": {"columns": ["a", "b"]}},
        {"rule_type": "min_value", "column": "a", "parameters": {"value": 0}},
        {"rule_type": "min_value", "column": "a", "parameters": {"value": 0.5}, "severity": "warning"},
        {"rule_type": "min_value", "column": "a", "parameters": {"value": "0"}},
        {"rule_type": "referential_integrity", "column": "a", "parameters": {"reference_table": "t", "reference_column": "größe"}},
        {"rule_type": "referential_integrity", "column": "a", "parameters": {"reference_column": "größe", "reference_table": "t"}, "severity": "warning"},
        {"rule_type": "accepted_values", "column": "a", "parameters": {"values": [1, "x", None, True]}},
        {"rule_type": "row_count_min"}]}
    docs = [sample_contract("orders"), sample_contract("customers"), odd]
    many = plan_many(contracts_df(spark, docs))
    got = {(r["table_name"], r["seq"]): (r["check_type"], r["column"], r["params"], r["severity"], r["origin"]) for r in many.collect()}
    want = {(d["table_name"], s.seq): (s.check_type, s.column, s.params_json, s.severity, s.origin)
            for d in docs for s in plan_contract(d)}
    assert got == want
    # the grouping and the numbering run on the one exchange of the registry
    plan = plan_many(contracts_df(spark, docs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_bad_custom_rule_is_one_error_row(spark, orders):
    rules = [{"rule_type": "not_null", "column": "order_id"},
             {"rule_type": "custom_sql", "parameters": {"expression": "no_such_fn(status)"}},
             {"rule_type": "custom_sql", "parameters": {"sql": "SELECT * FROM {table} WHERE nope > 1"}}]
    got = {r["seq"]: r["status"] for r in evaluate_rules(spark, orders, "orders", rules).collect()}
    assert got == {1: "failed", 2: "error", 3: "error"}


def test_checks_on_random_tables(spark):
    """Against plain Python; some of the tables are empty."""
    import random
    from collections import Counter
    rnd = random.Random(7)
    for n in (0, 1, 30, 60):
        rows = [(rnd.choice([None, 1, 2, 3, 4, 5, 6]), rnd.choice([None, "a", "b", "c", "zz"]),
                 rnd.choice([None, -1.0, 0.5, 3.0]), rnd.choice([None, 10, 11, 99])) for _ in range(n)]
        df = spark.createDataFrame(rows, "k long, s string, x double, fk long")
        # reference keys as text, with NULLs and a malformed value that matches nothing
        ref = spark.createDataFrame([("10",), (None,), ("x1",)], "rk string")
        rules = [{"rule_type": "not_null", "column": "k"},
                 {"rule_type": "unique", "column": "k"},
                 {"rule_type": "unique", "parameters": {"columns": ["k", "fk"]}},
                 {"rule_type": "accepted_values", "column": "s", "parameters": {"values": ["a", "b"]}},
                 {"rule_type": "min_value", "column": "x", "parameters": {"value": 0}},
                 {"rule_type": "referential_integrity", "column": "fk",
                  "parameters": {"reference_table": "ref", "reference_column": "rk"}},
                 {"rule_type": "row_count_min", "parameters": {"min_count": 5}}]
        repeated = lambda keys: sum(c > 1 for c in Counter(x for x in keys if None not in x).values())
        want = [sum(r[0] is None for r in rows), repeated((r[0],) for r in rows), repeated((r[0], r[3]) for r in rows),
                sum(r[1] not in (None, "a", "b") for r in rows), sum(r[2] is not None and r[2] < 0 for r in rows),
                sum(r[3] not in (None, 10) for r in rows), max(0, 5 - n)]
        got = {r["seq"]: (r["violations"], r["status"], r["message"]) for r in evaluate_rules(spark, df, "t", rules, TableSet({"ref": ref})).collect()}
        assert [got[i][0] for i in range(1, 8)] == want
        assert all((s == "failed") == (v > 0) for v, s, _ in got.values())
        assert got[1][2] == f"not_null on k: {want[0]} violating rows"


def test_parameters_that_do_not_fit_the_column(spark, orders):
    rules = [{"rule_type": "accepted_values", "column": "order_id", "parameters": {"values": ["1", "x"]}},
             {"rule_type": "min_value", "column": "updated_at", "parameters": {"value": "2024-13-45"}},
             {"rule_type": "max_value", "column": "total_amount", "parameters": {"value": 4}},
             {"rule_type": "min_value", "column": "order_id", "parameters": {"value": 1.5}},
             {"rule_type": "max_value", "column": "order_id", "parameters": {"value": "abc"}},
             {"rule_type": "accepted_values", "column": "status", "parameters": {"values": [1, 2]}},
             {"rule_type": "min_value", "column": "status", "parameters": {"value": 1}},
             {"rule_type": "min_value", "column": "order_id"},
             {"rule_type": "max_value", "column": "updated_at", "parameters": {"value": "2024-01-31 23:15:00"}}]
    got = {r["seq"]: (r["status"], r["violations"]) for r in evaluate_rules(spark, orders, "orders", rules).collect()}
    assert got[1] == ("failed", 2)      # order_id 2 twice is not in {'1', 'x'}; NULL is not judged
    assert got[2] == ("error", None)    # a bound that is no time
    assert got[3] == ("failed", 1)
    assert got[4] == ("failed", 1)      # 1 lies below 1.5
    assert got[5] == ("error", None)
    assert got[6] == ("failed", 3)      # no text is 1 or 2
    assert got[7] == ("failed", 3)      # text that is no number
    assert got[8] == ("error", None)    # no bound at all
    assert got[9] == ("failed", 1)


def test_freshness_column_has_to_be_a_time(spark, orders):
    c = {"table_name": "orders", "columns": [], "freshness": {"timestamp_column": "status", "max_delay_minutes": 5}}
    assert freshness_result(spark, orders, c, AS_OF).first()["status"] == "error"
    out = _by_name(evaluate_contract(spark, orders, c, TableSet(), AS_OF))
    assert out["freshness_status"]["status"] == "error" and out["row_count_min"]["status"] == "passed"
    named = orders.withColumnRenamed("updated_at", "größe_am")
    c["freshness"]["timestamp_column"] = "größe_am"
    assert freshness_result(spark, named, c, AS_OF).first()["status"] == "failed"


def test_many_freshness_results_in_groups(spark, orders, monkeypatch):
    from covenant.operators import freshness as FR
    monkeypatch.setattr(FR, "TABLES_PER_PLAN", 3)
    c = {"table_name": "orders", "columns": [], "freshness": {"timestamp_column": "updated_at", "max_delay_minutes": 60}}
    items = [({**c, "table_name": f"t{i}"}, orders if i % 2 else None) for i in range(8)]
    out = {r["table_name"]: r["status"] for r in FR.freshness_many(spark, iter(items), AS_OF).collect()}
    assert out == {f"t{i}": "passed" if i % 2 else "error" for i in range(8)}
    assert FR.freshness_many(spark, [], AS_OF).count() == 0


def test_tables_are_found_by_schema(spark, orders):
    t = TableSet({"orders": orders, "sales.orders": orders.limit(1)})
    assert t.get("orders").count() == 4 and t.get("orders", "sales").count() == 1
    assert t.get("orders", "other") is None and t.reference("orders", "other").count() == 4
    assert t.reference("orders", "sales").count() == 1 and t.reference("sales.orders").count() == 1
    assert TableSet(find=lambda s, n: orders if s == "x" else None).get("any", "x") is orders


def test_bad_regex_is_one_error_row(spark, orders):
    rules = [{"rule_type": "regex_match", "column": "status", "parameters": {"pattern": "([a-z"}},
             {"rule_type": "regex_match", "column": "status", "parameters": {"pattern": "^[a-z]+$"}}]
    got = {r["seq"]: r["status"] for r in evaluate_rules(spark, orders, "orders", rules).collect()}
    assert got == {1: "error", 2: "passed"}
