import json
import os
import tempfile

from covenant.plans.contracts import read_contract_dir, sample_contract, CONTRACTS_DIR
from covenant.plans.pipeline import governance_run
from covenant.sources import fixtures as FX
from covenant.sources import registry as RG
from covenant.sources.tables import TableSet, read_table
from covenant.streaming.gate import gate_totals, start_rule_gate
from tests.conftest import SF_SMALL


def test_read_contract_dir_applies_defaults(spark):
    d = tempfile.mkdtemp(prefix="contracts-")
    with open(os.path.join(d, "a.json"), "w") as fh:
        json.dump({"table_name": "Events", "owner": "x", "columns": [{"name": "TS"}]}, fh)
    df = read_contract_dir(spark, d)
    r = df.first()
    assert r["table_name"] == "events" and r["schema_name"] == "public" and r["version"] == "1.0.0"
    assert r["columns"][0]["name"] == "ts" and r["columns"][0]["type"] == "string"
    assert r["columns"][0]["nullable"] is True
    both = read_contract_dir(spark, CONTRACTS_DIR)
    assert sorted(x["table_name"] for x in both.collect()) == ["customers", "orders"]


def test_pipeline_logs_every_table_and_survives_a_bad_contract(spark):
    customers = FX.raw_customers(spark, SF_SMALL)
    t = TableSet({"orders": FX.raw_orders(spark, SF_SMALL), "customers": customers, "s2.customers": customers})
    broken = {"table_name": "customers", "schema_name": "s2", "owner": "x", "columns": [{"name": "email"}],
              "quality_rules": [{"rule_type": "custom_sql", "parameters": {"expression": "no_such_fn(email)"}}]}
    out = governance_run(spark, [sample_contract("orders"), sample_contract("customers"), broken], t,
                         RG.inventory_from_data(spark, SF_SMALL), RG.contracts_from_part(spark, SF_SMALL),
                         "2024-02-01 00:00:00", out_dir=tempfile.mkdtemp(prefix="gov-"))
    runs = {(r["table_name"], r["schema_name"]): r for r in out["runs"].collect()}
    assert set(runs) == {("orders", "public"), ("customers", "public"), ("customers", "s2")}
    assert runs[("orders", "public")]["overall_status"] == "failed"
    assert runs[("customers", "s2")]["overall_status"] == "passed"  # ERROR does not fail (Q1)
    assert out["report"].first()["total_tables"] == 3
    assert out["snapshot"].first()["tables_with_contracts"] == read_table(spark, SF_SMALL, "part").count()
    alerts = out["alerts"].collect()
    assert all(a["status"] in ("failed", "error") for a in alerts)
    assert all(len(a["failed_check_names"]) <= 10 for a in alerts)


def test_stream_gate_matches_batch_and_replays_idempotently(spark):
    events = read_table(spark, SF_SMALL, "events")
    rules = [{"rule_type": "min_value", "column": "value", "parameters": {"value": 1}}]
    base = tempfile.mkdtemp(prefix="gate-")
    q, sink = start_rule_gate(spark, SF_SMALL, events.schema, "events", rules, glob="events.parquet",
                              base_dir=base)
    q.awaitTermination(300)
    totals = {r["check_type"]: r["violations"] for r in gate_totals(spark, sink).collect()}
    assert totals["min_value"] == events.filter("value < 1").count()
    assert totals["rows_checked"] == events.count()
    # a replay of batch 0 overwrites its own folder: totals unchanged
    first = os.path.join(sink, "batch_id=0")
    copy = os.path.join(tempfile.mkdtemp(prefix="replay-"), "b0")
    spark.read.parquet(first).write.mode("overwrite").parquet(copy)
    spark.read.parquet(copy).write.mode("overwrite").parquet(first)
    again = {r["check_type"]: r["violations"] for r in gate_totals(spark, sink).collect()}
    assert again == totals


def test_a_check_that_fails_at_run_time_is_one_error(spark):
    from covenant.plans.pipeline import run_contracts
    orders = FX.raw_orders(spark, SF_SMALL)
    t = TableSet({"s9.orders": orders, "customers": FX.raw_customers(spark, SF_SMALL)})
    # analyses fine, fails at run time
    bad = {"table_name": "orders", "schema_name": "s9", "owner": "x", "columns": [{"name": "status"}],
           "quality_rules": [{"rule_type": "custom_sql", "parameters": {"expression": "cast(raise_error(status) AS boolean)"}},
                             {"rule_type": "not_null", "column": "order_id"},
                             {"rule_type": "unique", "column": "order_id"}]}
    checks = run_contracts(spark, [bad, sample_contract("customers")], t, tempfile.mkdtemp(prefix="rt-"), "2024-02-01 00:00:00")
    rows = checks.collect()
    mine = {r["check_name"]: r for r in rows if r["schema_name"] == "s9"}
    assert mine["custom_sql"]["status"] == "error" and "check failed" in mine["custom_sql"]["message"]
    assert mine["not_null_order_id"]["status"] == "failed" and mine["unique_order_id"]["status"] == "failed"
    assert mine["row_count_min"]["status"] == "passed" and len(mine) == 6
    assert len([r for r in rows if r["table_name"] == "customers"]) == 30
    assert all(r["duration_seconds"] > 0 for r in rows)


def test_a_contract_that_cannot_be_planned_is_an_error_run(spark):
    out = governance_run(spark, [{"table_name": "orders", "columns": [], "quality_rules": [{"column": "x"}]}],
                         TableSet({"orders": FX.raw_orders(spark, SF_SMALL)}), RG.inventory_from_data(spark, SF_SMALL),
                         RG.contracts_from_part(spark, SF_SMALL), "2024-02-01 00:00:00", out_dir=tempfile.mkdtemp(prefix="gov-"))
    run = out["runs"].first()
    assert run["overall_status"] == "error" and run["total_checks"] == 1
    assert [a["status"] for a in out["alerts"].collect()] == ["error"]


def test_log_rows_are_truthful_and_written_once(spark):
    from covenant.operators import governance as G
    from covenant.operators import results as R
    root = tempfile.mkdtemp(prefix="gov-")
    plain = {"table_name": "customers", "version": "0.5.0", "columns": [{"name": "email"}]}
    args = ([sample_contract("orders"), plain], TableSet({"orders": FX.raw_orders(spark, SF_SMALL), "customers": FX.raw_customers(spark, SF_SMALL)}),
            RG.inventory_from_data(spark, SF_SMALL), RG.contracts_from_part(spark, SF_SMALL), "2024-02-01 00:00:00")
    out = governance_run(spark, *args, out_dir=root, run_id="one")
    R.append_log(R.log_rows(out["checks"], args[-1]), f"{root}/quality_results")  # again: replaced, not doubled
    assert R.read_log(spark, f"{root}/quality_results").count() == 2
    rows = {r["table_name"]: r for r in R.read_log(spark, f"{root}/quality_results").collect()}
    stored = json.loads(rows["orders"]["result_data"])
    assert stored["contract_version"] == rows["orders"]["contract_version"] == "3.2.1"
    assert stored["duration_seconds"] == rows["orders"]["duration_seconds"] > 0
    assert stored["freshness_result"]["status"] == "failed" and stored["freshness_result"]["max_delay_minutes"] == 720
    assert "freshness_result" in json.loads(rows["customers"]["result_data"])
    assert json.loads(rows["customers"]["result_data"])["freshness_result"] is None
    again = governance_run(spark, *args, out_dir=root, run_id="two")
    assert again["log"].count() == 4 and again["runs"].count() == 2
    assert {a["run_id"] for a in again["alerts"].collect()} == {"two"}
    assert all(a["failed_check_names"] for a in again["alerts"].collect())
    assert G.sla_compliance_by_freshness(again["log"]).first()["tables_with_freshness_sla"] == 1
    assert G.run_detail(again["log"], "two").filter("table_name = 'orders'").first()["freshness_status"] == "failed"


def test_gate_goes_on_where_it_stopped(spark):
    from covenant.streaming.gate import gate_runs
    events = read_table(spark, SF_SMALL, "events")
    landing, base = tempfile.mkdtemp(prefix="land-"), tempfile.mkdtemp(prefix="gate-")
    events.filter("event_id % 2 = 0").write.mode("append").parquet(landing)
    rules = [{"rule_type": "min_value", "column": "value", "parameters": {"value": 1}}]
    counts = []
    for step in range(3):
        if step == 2:
            events.filter("event_id % 2 = 1").write.mode("append").parquet(landing)
        q, sink = start_rule_gate(spark, landing, events.schema, "events", rules, base_dir=base)
        q.awaitTermination()
        counts.append(gate_totals(spark, sink).filter("check_type = 'rows_checked'").first()["violations"])
    assert counts == [events.filter("event_id % 2 = 0").count()] * 2 + [events.count()]
    runs = gate_runs(spark, sink).collect()
    assert {r["run_id"] for r in runs} == {"events-0", "events-1"} and all(r["overall_status"] == "failed" for r in runs)


def test_contract_gate_uses_streamable_rules(spark):
    from covenant.streaming.gate import start_contract_gate
    events = read_table(spark, SF_SMALL, "events")
    contract = {"table_name": "events", "owner": "x", "columns": [{"name": "value"}],
                "quality_rules": [{"rule_type": "min_value", "column": "value", "parameters": {"value": 1}},
                                  {"rule_type": "unique", "column": "event_id"}],
                "freshness": {"timestamp_column": "ts", "max_delay_minutes": 60, "check_interval_minutes": 5}}
    q, sink = start_contract_gate(spark, contract, SF_SMALL, events.schema, glob="events.parquet",
                                  base_dir=tempfile.mkdtemp(prefix="gate-"))
    q.awaitTermination(300)
    totals = {r["check_type"]: r["violations"] for r in gate_totals(spark, sink).collect()}
    assert set(totals) == {"min_value", "rows_checked"}   # uniqueness spans batches: batch job only
    assert totals["min_value"] == events.filter("value < 1").count()


def test_yaml_and_json_contract_files(spark):
    import yaml

    from covenant.plans.contracts import read_contract_files
    d = tempfile.mkdtemp(prefix="yaml-contracts-")
    orders = sample_contract("orders")
    with open(os.path.join(d, "orders.yml"), "w") as fh:
        yaml.safe_dump({k: v for k, v in orders.items() if k not in ("description",)}, fh)
    with open(os.path.join(d, "extra.json"), "w") as fh:
        json.dump({"table_name": "Extra", "owner": "x", "columns": [{"name": "A"}]}, fh)
    rows = {r["table_name"]: r for r in read_contract_files(spark, d).collect()}
    assert set(rows) == {"orders", "extra"}
    assert len(rows["orders"]["quality_rules"]) == 8 and rows["orders"]["freshness"]["max_delay_minutes"] == 720
    assert json.loads(rows["orders"]["quality_rules"][1]["parameters"]) == {"value": 250000.5}
    assert rows["extra"]["columns"][0]["name"] == "a" and rows["extra"]["schema_name"] == "public"
