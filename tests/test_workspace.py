import tempfile

from covenant.plans.contracts import CONTRACTS_DIR
from covenant.plans.workspace import Workspace
from covenant.sources import fixtures as FX
from tests.conftest import SF_SMALL

AS_OF = "2024-02-01 00:00:00"


def test_workspace_day_in_the_life(spark):
    tables = {"orders": FX.raw_orders(spark, SF_SMALL), "customers": FX.raw_customers(spark, SF_SMALL)}
    ws = Workspace(spark, tempfile.mkdtemp(prefix="ws-"), tables)

    acts = {r["table_name"]: r["action"] for r in ws.sync_directory(CONTRACTS_DIR, AS_OF).collect()}
    assert acts == {"orders": "inserted", "customers": "inserted"}
    again = {r["table_name"]: r["action"] for r in ws.sync_directory(CONTRACTS_DIR, AS_OF).collect()}
    assert again == {"orders": "updated", "customers": "updated"}
    assert ws.contracts().count() == 2

    one = ws.run_checks_for_table("orders", as_of=AS_OF)
    r = one["runs"].collect()
    assert len(r) == 1 and r[0]["table_name"] == "orders" and r[0]["overall_status"] == "failed"
    both = ws.run_checks(as_of=AS_OF)
    assert both["runs"].count() == 2
    assert ws.log().count() == 3
    rep = ws.summary_report().first()
    assert (rep["total_tables"], rep["tables_failed"]) == (2, 2)
    assert ws.failing_tables(current=True).count() == 2
    assert ws.table_history("orders").count() == 2
    assert ws.recent_results(1).count() == 1

    fresh = {x["table_name"]: x["status"] for x in ws.check_freshness(AS_OF).collect()}
    assert fresh == {"orders": "failed", "customers": "failed"}
    assert ws.check_freshness(AS_OF, stale_only=True).count() == 2
    rid = r[0]["run_id"]
    fresh_start = Workspace(spark, tempfile.mkdtemp(prefix="ws-"), tables, definitions=CONTRACTS_DIR)
    first = fresh_start.run_checks_for_table("orders", as_of=AS_OF)   # the definition file is used and registered
    assert first["runs"].count() == 1 and fresh_start.contracts().count() == 1
    try:
        fresh_start.run_checks_for_table("nothing")
        raise AssertionError("a table without a contract was checked")
    except LookupError:
        pass
    detail = ws.result_detail(rid).collect()      # the orders-only run
    assert len(detail) == 1 and detail[0]["table_name"] == "orders"
    assert '"checks"' in detail[0]["result_data"]

    snap = ws.capture_snapshot(AS_OF).first()
    assert snap["tables_with_contracts"] == 2 and snap["total_tables"] == 2
    assert ws.current_metrics().count() == 1
    assert ws.trends(30, AS_OF).count() == 1

    gone = ws.delete("customers").first()
    assert gone["deleted"] is True
    assert [x["table_name"] for x in ws.contracts().collect()] == ["orders"]
    assert ws.delete("nope").first()["deleted"] is False


def test_trend_prunes_snapshot_partitions(spark, tmp_path):
    from covenant.operators.governance import trend
    rows = [("2024-01-01 10:00:00", 1), ("2024-01-20 10:00:00", 2), ("2024-01-31 10:00:00", 3)]
    df = spark.createDataFrame(rows, "t string, v int").selectExpr(
        "to_timestamp_ntz(t) AS captured_at", "v", "to_date(t) AS capture_date")
    df.write.partitionBy("capture_date").parquet(str(tmp_path / "m"))
    snaps = spark.read.parquet(str(tmp_path / "m"))
    out = trend(snaps, 14, "2024-02-01 00:00:00")
    assert [r["v"] for r in out.collect()] == [2, 3]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(capture_date" in plan
