"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and the DuckDB
oracle SQL for each. Every query reads the driver's tables (or tables
Spark derives from them) in full."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from covenant.operators import models as M
from covenant.plans import oracle as O
from covenant.sources import fixtures as FX

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- models

@register("stg_orders", O.with_ctes(O.RAW_ORDERS, O.STG_ORDERS,
                                    body="SELECT * FROM stg_orders"))
def q_stg_orders(spark, sf):
    return M.stg_orders(FX.raw_orders(spark, sf))


@register("stg_customers", O.with_ctes(O.RAW_CUSTOMERS, O.STG_CUSTOMERS,
                                       body="SELECT * FROM stg_customers"))
def q_stg_customers(spark, sf):
    return M.stg_customers(FX.raw_customers(spark, sf))


@register("fct_order_summary", O.with_ctes(
    O.RAW_ORDERS, O.RAW_CUSTOMERS, O.STG_ORDERS, O.STG_CUSTOMERS, O.FCT_ORDER_SUMMARY,
    body="SELECT * FROM fct_order_summary"))
def q_fct_order_summary(spark, sf):
    out = M.fct_order_summary(M.stg_orders(FX.raw_orders(spark, sf)),
                              M.stg_customers(FX.raw_customers(spark, sf)))
    return out.drop("generated_at")  # wall-clock column, not comparable


@register("assert_total_positive", O.with_ctes(
    O.RAW_ORDERS, O.STG_ORDERS,
    body="SELECT order_id, CAST(total_amount AS DOUBLE) AS total_amount "
         "FROM stg_orders WHERE total_amount < 0"))
def q_assert_total_positive(spark, sf):
    return M.assert_total_positive(M.stg_orders(FX.raw_orders(spark, sf)))


# ----------------------------------------------------------------- rules
from covenant.operators import checks as C  # noqa: E402
from covenant.sources.tables import TableSet  # noqa: E402

RULE_OUT = ["check_type", "column", "status", "severity", "violations", "actual_value", "expected_value", "message"]
EMAIL_PATTERN = "^[^@ ]+@[^@ ]+[.][a-z]+$"
STATUS_VALUES = ["cancelled", "completed", "pending", "refunded"]

RULES = {
    # name: (table, rule, key columns for the violation rows)
    "not_null": ("orders", {"rule_type": "not_null", "column": "order_id"},
                 ["customer_id", "order_date", "version"]),
    "unique": ("orders", {"rule_type": "unique", "column": "order_id"}, []),
    "accepted_values": ("orders", {"rule_type": "accepted_values", "column": "status",
                                   "parameters": {"values": STATUS_VALUES}}, ["order_id"]),
    "min_value": ("orders", {"rule_type": "min_value", "column": "total_amount",
                             "parameters": {"value": 0}}, ["order_id"]),
    "max_value": ("orders", {"rule_type": "max_value", "column": "total_amount",
                             "parameters": {"value": 400000}}, ["order_id"]),
    "regex_match": ("customers", {"rule_type": "regex_match", "column": "email",
                                  "parameters": {"pattern": EMAIL_PATTERN}, "severity": "warning"},
                    ["customer_id"]),
    "custom_sql": ("orders", {"rule_type": "custom_sql",
                              "parameters": {"expression": "abs(total_amount) < 450000"}},
                   ["order_id", "total_amount"]),
    "row_count_min": ("customers", {"rule_type": "row_count_min",
                                    "parameters": {"min_count": 1000000}}, []),
    "referential_integrity": ("orders", {"rule_type": "referential_integrity", "column": "customer_id",
                                         "parameters": {"reference_table": "customers",
                                                        "reference_column": "customer_id"}}, []),
}


def governed(spark, sf) -> TableSet:
    return TableSet({"orders": FX.raw_orders(spark, sf), "customers": FX.raw_customers(spark, sf)})


def _rule_query(rule_name):
    def q(spark, sf):
        tables = governed(spark, sf)
        table, rule, _ = RULES[rule_name]
        out = C.evaluate_rules(spark, tables.get(table), table, [rule], tables)
        return out.select(*RULE_OUT)
    return q


def _violation_query(rule_name):
    def q(spark, sf):
        tables = governed(spark, sf)
        table, rule, keys = RULES[rule_name]
        out = C.violations(tables.get(table), rule, tables, keys)
        if "total_amount" in out.columns:
            out = out.withColumn("total_amount", out["total_amount"].cast("double"))
        return out
    return q


_RAW = {"orders": ("raw_orders", O.RAW_ORDERS), "customers": ("raw_customers", O.RAW_CUSTOMERS)}

_RULE_SQL = {
    "not_null": ("SUM(CASE WHEN order_id IS NULL THEN 1 ELSE 0 END)", None, "error"),
    "unique": ("(SELECT count(*) FROM (SELECT order_id FROM raw_orders WHERE order_id IS NOT NULL "
               "GROUP BY order_id HAVING count(*) > 1))", None, "error"),
    "accepted_values": ("SUM(CASE WHEN status IS NOT NULL AND status NOT IN "
                        "('cancelled','completed','pending','refunded') THEN 1 ELSE 0 END)",
                        None, "error"),
    "min_value": ("SUM(CASE WHEN total_amount < 0 THEN 1 ELSE 0 END)", "min(total_amount)", "error"),
    "max_value": ("SUM(CASE WHEN total_amount > 400000 THEN 1 ELSE 0 END)", "max(total_amount)", "error"),
    "regex_match": ("SUM(CASE WHEN email IS NOT NULL AND NOT regexp_matches(email, "
                    "'^[^@ ]+@[^@ ]+[.][a-z]+$') THEN 1 ELSE 0 END)",
                    None, "warning"),
    "custom_sql": ("SUM(CASE WHEN NOT (abs(total_amount) < 450000) THEN 1 ELSE 0 END)", None, "error"),
    "row_count_min": ("GREATEST(1000000 - count(*), 0)", "count(*)", "error"),
    "referential_integrity": (
        "(SELECT count(*) FROM raw_orders o WHERE o.customer_id IS NOT NULL AND NOT EXISTS "
        "(SELECT 1 FROM raw_customers c WHERE c.customer_id = o.customer_id))",
        "(SELECT count(DISTINCT o.customer_id) FROM raw_orders o WHERE o.customer_id IS NOT NULL AND NOT EXISTS "
        "(SELECT 1 FROM raw_customers c WHERE c.customer_id = o.customer_id))", "error"),
}

# expected value and message of each rule's check (None: the plain message)
_ORPHANS = ("FROM raw_orders o WHERE o.customer_id IS NOT NULL AND NOT EXISTS "
            "(SELECT 1 FROM raw_customers c WHERE c.customer_id = o.customer_id)")
_RULE_TEXT = {
    "not_null": ("'0'", None),
    "unique": ("'0'", "concat('unique on order_id: ', violations, ' duplicated values in ', (SELECT coalesce(sum(n), 0) FROM "
               "(SELECT count(*) AS n FROM raw_orders WHERE order_id IS NOT NULL GROUP BY order_id HAVING count(*) > 1)), ' rows')"),
    "accepted_values": ("'[\"cancelled\", \"completed\", \"pending\", \"refunded\"]'", None),
    "min_value": ("'0'", None),
    "max_value": ("'400000'", None),
    "regex_match": ("'^[^@ ]+@[^@ ]+[.][a-z]+$'", None),
    "custom_sql": ("'abs(total_amount) < 450000'", None),
    "row_count_min": ("'1000000'", "concat('row count ', actual, ' (minimum 1000000)')"),
    "referential_integrity": ("'customers.customer_id'", "concat('customer_id -> customers.customer_id: ', violations, ' orphan rows, ', "
                              f"(SELECT count(DISTINCT o.customer_id) {_ORPHANS}), ' keys')"),
}

_VIOLATION_SQL = {
    "not_null": "SELECT customer_id, order_date, version, order_id FROM raw_orders WHERE order_id IS NULL",
    "unique": "SELECT order_id, count(*) AS n_rows FROM raw_orders WHERE order_id IS NOT NULL "
              "GROUP BY order_id HAVING count(*) > 1",
    "accepted_values": "SELECT order_id, status FROM raw_orders WHERE status IS NOT NULL AND status NOT IN "
                       "('cancelled','completed','pending','refunded')",
    "min_value": "SELECT order_id, CAST(total_amount AS DOUBLE) AS total_amount FROM raw_orders "
                 "WHERE total_amount < 0",
    "max_value": "SELECT order_id, CAST(total_amount AS DOUBLE) AS total_amount FROM raw_orders "
                 "WHERE total_amount > 400000",
    "regex_match": "SELECT customer_id, email FROM raw_customers WHERE email IS NOT NULL AND NOT "
                   "regexp_matches(email, '^[^@ ]+@[^@ ]+[.][a-z]+$')",
    "custom_sql": "SELECT order_id, CAST(total_amount AS DOUBLE) AS total_amount FROM raw_orders "
                  "WHERE NOT (abs(total_amount) < 450000)",
    "row_count_min": "SELECT row_count, CAST(1000000 AS BIGINT) AS min_count FROM "
                     "(SELECT count(*) AS row_count FROM raw_customers) WHERE row_count < 1000000",
    "referential_integrity": "SELECT customer_id, count(*) AS n_rows FROM raw_orders o "
                             "WHERE customer_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM raw_customers c "
                             "WHERE c.customer_id = o.customer_id) GROUP BY customer_id",
}

for _name, (_table, _rule, _keys) in RULES.items():
    _viol, _actual, _sev = _RULE_SQL[_name]
    _view, _cte = _RAW[_table]
    _src = "(SELECT 1 AS one) d" if _name in ("unique", "referential_integrity") else _view
    _ctes = [O.RAW_ORDERS, O.RAW_CUSTOMERS] if _name == "referential_integrity" else [_cte]
    _actual = _actual or "violations_placeholder"
    _failed = "actual < 1000000" if _name == "row_count_min" else None
    _sql = O.rule_row(_name, _rule.get("column"), _viol,
                      _actual if _actual != "violations_placeholder" else _viol, _src, _sev, _failed, *_RULE_TEXT[_name])
    register(f"rule_{_name}", O.with_ctes(*_ctes, body=_sql))(_rule_query(_name))
    register(f"rule_violations_{_name}", O.with_ctes(*_ctes, body=_VIOLATION_SQL[_name]))(
        _violation_query(_name))


# ------------------------------------------------------------ full contract
from covenant.plans.contracts import sample_contract  # noqa: E402

AS_OF = "2024-02-01 00:00:00"
CHECK_OUT = ["seq", "check_name", "check_type", "column", "status", "severity", "violations", "expected_value", "message"]


def _contract_query(table):
    def q(spark, sf):
        tables = governed(spark, sf)
        out = C.evaluate_contract(spark, tables.get(table), sample_contract(table), tables, AS_OF)
        return out.select(*CHECK_OUT)
    return q


for _t in ("orders", "customers"):
    register(f"fused_checks_{_t}", O.with_ctes(
        O.RAW_ORDERS, O.RAW_CUSTOMERS, body=O.contract_oracle(_t, AS_OF)))(_contract_query(_t))


# rules whose parameters do not fit the column's type: bounds between whole
# numbers, bounds that cannot be read, numbers for text, and the query form
_ODD_RULES = [
    {"rule_type": "min_value", "column": "version", "parameters": {"value": 0.5}},
    {"rule_type": "max_value", "column": "order_id", "parameters": {"value": "100.5"}, "severity": "warning"},
    {"rule_type": "min_value", "column": "order_id", "parameters": {"value": "abc"}},
    {"rule_type": "max_value", "column": "order_date", "parameters": {"value": "2024-13-45"}},
    {"rule_type": "max_value", "column": "order_date", "parameters": {"value": "1995-06-17"}},
    {"rule_type": "min_value", "column": "status", "parameters": {"value": 3}},
    {"rule_type": "accepted_values", "column": "status", "parameters": {"values": [1, 2]}},
    {"rule_type": "accepted_values", "column": "order_id", "parameters": {"values": [1, 2.0, "3"]}},
    {"rule_type": "custom_sql", "parameters": {"sql": "SELECT order_id FROM {table} WHERE total_amount < 0"}},
    {"rule_type": "custom_sql", "parameters": {}},
    {"rule_type": "min_value", "column": "order_id", "parameters": {}},
]


@register("rule_odd_parameters", O.with_ctes(O.RAW_ORDERS, body="""
SELECT seq, check_type, status, CASE WHEN status = 'error' THEN NULL ELSE v END AS violations FROM (
  SELECT seq, check_type, v, CASE WHEN v < 0 THEN 'error' WHEN v > 0 THEN bad ELSE 'passed' END AS status FROM (
    SELECT 1 AS seq, 'min_value' AS check_type, (SELECT count(*) FROM raw_orders WHERE version < 0.5) AS v, 'failed' AS bad
    UNION ALL SELECT 2, 'max_value', (SELECT count(*) FROM raw_orders WHERE order_id > 100.5), 'warning'
    UNION ALL SELECT 3, 'min_value', -1, 'failed'
    UNION ALL SELECT 4, 'max_value', -1, 'failed'
    UNION ALL SELECT 5, 'max_value', (SELECT count(*) FROM raw_orders WHERE order_date > TIMESTAMP '1995-06-17'), 'failed'
    UNION ALL SELECT 6, 'min_value', (SELECT count(*) FROM raw_orders WHERE status IS NOT NULL), 'failed'
    UNION ALL SELECT 7, 'accepted_values', (SELECT count(*) FROM raw_orders WHERE status IS NOT NULL), 'failed'
    UNION ALL SELECT 8, 'accepted_values', (SELECT count(*) FROM raw_orders WHERE order_id NOT IN (1, 2, 3)), 'failed'
    UNION ALL SELECT 9, 'custom_sql', (SELECT count(*) FROM raw_orders WHERE total_amount < 0), 'failed'
    UNION ALL SELECT 10, 'custom_sql', -1, 'failed'
    UNION ALL SELECT 11, 'min_value', -1, 'failed'))"""))
def q_rule_odd_parameters(spark, sf):
    out = C.evaluate_rules(spark, FX.raw_orders(spark, sf), "orders", _ODD_RULES)
    return out.select("seq", "check_type", "status", "violations")


# ------------------------------------------------------------- freshness
from covenant.operators import freshness as FR  # noqa: E402
from covenant.operators import results as R  # noqa: E402
from covenant.sources.tables import BASE_TABLES, read_table, table_path  # noqa: E402

FRESH_OUT = ["table_name", "schema_name", "timestamp_column", "last_updated_at",
             "max_delay_minutes", "actual_delay_minutes", "status", "is_within_sla", "message"]


def _freshness_items(spark, sf):
    t = governed(spark, sf)
    return [
        (sample_contract("orders"), t.get("orders")),
        (sample_contract("customers"), t.get("customers")),
        ({"table_name": "events", "columns": [{"name": "ts"}],
          "freshness": {"timestamp_column": "ts", "max_delay_minutes": 10080}},
         read_table(spark, sf, "events")),
        ({"table_name": "lineitem", "columns": [{"name": "l_shipdate"}],
          "freshness": {"timestamp_column": "l_shipdate", "max_delay_minutes": 1440}},
         read_table(spark, sf, "lineitem")),
        ({"table_name": "shipments", "columns": [{"name": "shipped_at"}],
          "freshness": {"timestamp_column": "shipped_at", "max_delay_minutes": 60}}, None),
        ({"table_name": "nation", "columns": [{"name": "n_name"}]}, read_table(spark, sf, "nation")),
        ({"table_name": "region", "columns": [{"name": "r_name"}],
          "freshness": {"timestamp_column": "r_name", "max_delay_minutes": 30}}, read_table(spark, sf, "region")),
        ({"table_name": "part", "columns": [{"name": "p_name"}],
          "freshness": {"timestamp_column": "größe_am", "max_delay_minutes": 30}}, read_table(spark, sf, "part")),
    ]


def _fresh_sql(view, col, mx, table):
    delay = f"((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(m)) / 60000000.0)"
    return (f"SELECT '{table}' AS table_name, 'public' AS schema_name, '{col}' AS timestamp_column, "
            f"m AS last_updated_at, CAST({mx} AS BIGINT) AS max_delay_minutes, "
            f"{delay} AS actual_delay_minutes, "
            f"CASE WHEN m IS NOT NULL AND {delay} <= {mx} THEN 'passed' ELSE 'failed' END AS status, "
            f"(m IS NOT NULL AND {delay} <= {mx}) AS is_within_sla, "
            f"CASE WHEN m IS NULL THEN 'Table public.{table} has no data or null timestamps' ELSE "
            f"concat('Data is ', CAST(round({delay}, 1) AS DECIMAL(24, 1)), ' min old (SLA: {mx} min) - ', "
            f"CASE WHEN {delay} <= {mx} THEN 'WITHIN' ELSE 'OUTSIDE' END, ' SLA') END AS message "
            f"FROM (SELECT max({col}) AS m FROM {view})")


_FRESH_MANY_SQL = O.with_ctes(O.RAW_ORDERS, O.RAW_CUSTOMERS, body="\nUNION ALL\n".join([
    _fresh_sql("raw_orders", "updated_at", 720, "orders"),
    _fresh_sql("raw_customers", "updated_at", 10080, "customers"),
    _fresh_sql("events", "ts", 10080, "events"),
    _fresh_sql("lineitem", "l_shipdate", 1440, "lineitem"),
    "SELECT 'shipments', 'public', 'shipped_at', NULL, 60, NULL, 'error', false, 'Table public.shipments does not exist'",
    "SELECT 'nation', 'public', '', NULL, 0, NULL, 'skipped', false, 'No freshness SLA defined in contract'",
    "SELECT 'region', 'public', 'r_name', NULL, 30, NULL, 'error', false, "
    "'Freshness query failed: column r_name is string, not a date or timestamp'",
    "SELECT 'part', 'public', 'größe_am', NULL, 30, NULL, 'error', false, 'Freshness query failed: column größe_am not found'",
]))


@register("freshness_check", O.with_ctes(O.RAW_ORDERS, body=_fresh_sql("raw_orders", "updated_at", 720, "orders")))
def q_freshness_check(spark, sf):
    return FR.freshness_result(spark, FX.raw_orders(spark, sf), sample_contract("orders"), AS_OF).select(*FRESH_OUT)


@register("freshness_many", _FRESH_MANY_SQL)
def q_freshness_many(spark, sf):
    return FR.freshness_many(spark, _freshness_items(spark, sf), AS_OF).select(*FRESH_OUT)


@register("stale_tables", f"SELECT * FROM ({_FRESH_MANY_SQL}) WHERE status = 'failed'")
def q_stale_tables(spark, sf):
    return FR.stale_tables(FR.freshness_many(spark, _freshness_items(spark, sf), AS_OF)).select(*FRESH_OUT)


@register("freshness_alerts_many",
          "SELECT 'freshness_sla_breach' AS alert_type, 'critical' AS severity, "
          "concat_ws('.', schema_name, table_name) AS \"table\", timestamp_column, actual_delay_minutes, "
          f"max_delay_minutes FROM ({_FRESH_MANY_SQL}) WHERE status = 'failed'")
def q_freshness_alerts_many(spark, sf):
    a = FR.freshness_alerts(FR.freshness_many(spark, _freshness_items(spark, sf), AS_OF))
    return a.select("alert_type", "severity", "table", "timestamp_column", "actual_delay_minutes",
                    "max_delay_minutes")


# ------------------------------------------------------------ run roll-up

def _both_contract_checks(spark, sf):
    tables = governed(spark, sf)
    parts = [C.evaluate_contract(spark, tables.get(t), sample_contract(t), tables, AS_OF)
             for t in ("orders", "customers")]
    return parts[0].unionByName(parts[1])


def _oracle_checks_cte():
    return "all_checks AS (" + "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, 'public' AS schema_name, * FROM ({O.contract_oracle(t, AS_OF)})" for t in ("orders", "customers")) + ")"


# run roll-up over the oracle's check rows (Q1-Q3 counting rules)
_ROLLUP_BODY = """
SELECT table_name, schema_name, total_checks, passed_checks, failed_checks, warning_checks, error_checks,
       CASE WHEN failed_checks > 0 THEN 'failed' WHEN warning_checks > 0 THEN 'warning'
            ELSE 'passed' END AS overall_status
FROM (SELECT table_name, schema_name, count(*) AS total_checks,
             count(*) FILTER (WHERE status = 'passed') AS passed_checks,
             count(*) FILTER (WHERE status = 'failed') AS failed_checks,
             count(*) FILTER (WHERE status = 'warning' AND check_type <> 'freshness') AS warning_checks,
             count(*) FILTER (WHERE status = 'error') AS error_checks
      FROM all_checks GROUP BY table_name, schema_name)"""
_ROLLUP_SQL = O.with_ctes(O.RAW_ORDERS, O.RAW_CUSTOMERS, _oracle_checks_cte(), body=_ROLLUP_BODY)


@register("run_rollup", _ROLLUP_SQL)
def q_run_rollup(spark, sf):
    return R.rollup_runs(_both_contract_checks(spark, sf))


@register("run_alerts", O.with_ctes(O.RAW_ORDERS, O.RAW_CUSTOMERS, _oracle_checks_cte(), body=f"""
SELECT 'quality_check_failure' AS alert_type,
       CASE WHEN r.failed_checks > 3 THEN 'critical' ELSE 'warning' END AS severity,
       concat_ws('.', r.schema_name, r.table_name) AS "table", r.overall_status AS status,
       r.total_checks, r.failed_checks,
       array_to_string(list_slice(n.names, 1, 10), ',') AS failed_check_names
FROM ({_ROLLUP_BODY}) r
LEFT JOIN (SELECT table_name, schema_name, list(check_name ORDER BY seq) AS names
           FROM all_checks WHERE status = 'failed' GROUP BY table_name, schema_name) n
  ON r.table_name = n.table_name AND r.schema_name = n.schema_name
WHERE r.overall_status IN ('failed', 'error')"""))
def q_run_alerts(spark, sf):
    from covenant.operators import governance as G
    checks = _both_contract_checks(spark, sf)
    runs = R.rollup_runs(checks, ["table_name", "schema_name"], with_failed_names=G.V.ALERT_FAILED_NAMES)
    a = G.quality_alerts(runs)
    from pyspark.sql import functions as F
    return a.select("alert_type", "severity", "table", "status", "total_checks", "failed_checks",
                    F.array_join("failed_check_names", ",").alias("failed_check_names"))


# ------------------------------------------------------------ result log
from covenant.operators import governance as G  # noqa: E402

_LOG = O.RUN_LOG
_SUMMARY = ("run_id, table_name, schema_name, contract_version, overall_status, total_checks, "
            "passed_checks, failed_checks, warning_checks, duration_seconds, executed_at")
_LATEST = ("SELECT * FROM run_log QUALIFY row_number() OVER (PARTITION BY table_name, schema_name "
           "ORDER BY executed_at DESC, run_id DESC) = 1")
HISTORY_TABLE = "click"
DETAIL_RUN = 1


def _log(spark, sf):
    return FX.run_log(spark, sf)


@register("latest_per_table", O.with_ctes(_LOG, body=f"SELECT {_SUMMARY} FROM ({_LATEST})"))
def q_latest_per_table(spark, sf):
    return G.latest_per_table(_log(spark, sf)).select(*G.SUMMARY_COLUMNS)


@register("recent_results", O.with_ctes(_LOG, body=f"SELECT {_SUMMARY} FROM run_log "
                                        "ORDER BY executed_at DESC, run_id DESC LIMIT 50"))
def q_recent_results(spark, sf):
    return G.recent_results(_log(spark, sf), 50)


@register("recent_results_for_table", O.with_ctes(
    _LOG, body=f"SELECT {_SUMMARY} FROM run_log WHERE table_name = '{HISTORY_TABLE}' "
               "ORDER BY executed_at DESC, run_id DESC LIMIT 50"))
def q_recent_results_for_table(spark, sf):
    return G.recent_results(_log(spark, sf), 50, HISTORY_TABLE)


@register("table_history", O.with_ctes(
    _LOG, body="SELECT run_id, overall_status, total_checks, passed_checks, failed_checks, "
               f"duration_seconds, executed_at FROM run_log WHERE table_name = '{HISTORY_TABLE}' "
               "ORDER BY executed_at DESC, run_id DESC LIMIT 30"))
def q_table_history(spark, sf):
    return G.table_history(_log(spark, sf), HISTORY_TABLE, 30)


@register("run_detail", O.with_ctes(
    _LOG, body="SELECT run_id, table_name, schema_name, executed_at, "
               "json_extract_string(result_data, '$.overall_status') AS overall_status, "
               "CAST(json_extract_string(result_data, '$.total_checks') AS BIGINT) AS total_checks, "
               "json_extract_string(result_data, '$.freshness_result.status') AS freshness_status, "
               "CAST(json_extract_string(result_data, '$.freshness_result.actual_delay_minutes') AS DOUBLE) "
               f"AS actual_delay_minutes FROM run_log WHERE run_id = {DETAIL_RUN}"))
def q_run_detail(spark, sf):
    return G.run_detail(_log(spark, sf), DETAIL_RUN)


_FAIL_COLS = "run_id, table_name, schema_name, contract_version, overall_status, failed_checks, executed_at"


@register("last_failure_per_table", O.with_ctes(
    _LOG, body=f"SELECT {_FAIL_COLS} FROM run_log WHERE overall_status = 'failed' "
               "QUALIFY row_number() OVER (PARTITION BY table_name, schema_name "
               "ORDER BY executed_at DESC, run_id DESC) = 1"))
def q_last_failure_per_table(spark, sf):
    return G.last_failure_per_table(_log(spark, sf))


@register("currently_failing", O.with_ctes(
    _LOG, body=f"SELECT {_FAIL_COLS} FROM ({_LATEST}) WHERE overall_status = 'failed'"))
def q_currently_failing(spark, sf):
    return G.currently_failing(_log(spark, sf))


@register("report_rollup", O.with_ctes(
    _LOG, body="SELECT count(*) AS total_tables, count(*) FILTER (WHERE overall_status = 'passed') "
               "AS tables_passed, count(*) FILTER (WHERE overall_status = 'failed') AS tables_failed "
               f"FROM ({_LATEST})"))
def q_report_rollup(spark, sf):
    return G.summary_report(_log(spark, sf))


@register("check_totals_latest", O.with_ctes(
    _LOG, body="SELECT CAST(coalesce(sum(total_checks), 0) AS BIGINT) AS total_checks_run, "
               "CAST(coalesce(sum(passed_checks), 0) AS BIGINT) AS total_checks_passed "
               f"FROM ({_LATEST})"))
def q_check_totals_latest(spark, sf):
    return G.check_totals_latest(_log(spark, sf))


@register("freshness_compliance", O.with_ctes(
    _LOG, body="SELECT count(*) FILTER (WHERE overall_status = 'passed') AS tables_within_sla, "
               "count(*) AS tables_with_freshness_sla FROM (SELECT * FROM run_log "
               "WHERE result_data LIKE '%freshness%' QUALIFY row_number() OVER "
               "(PARTITION BY table_name, schema_name ORDER BY executed_at DESC, run_id DESC) = 1)"))
def q_freshness_compliance(spark, sf):
    return G.freshness_compliance(_log(spark, sf))


@register("sla_compliance_by_freshness", O.with_ctes(
    _LOG, body="SELECT count(*) FILTER (WHERE fs = 'passed') AS tables_within_sla, "
               "count(*) AS tables_with_freshness_sla FROM (SELECT *, "
               "json_extract_string(result_data, '$.freshness_result.status') AS fs FROM run_log "
               "WHERE json_extract_string(result_data, '$.freshness_result.status') IS NOT NULL "
               "QUALIFY row_number() OVER (PARTITION BY table_name, schema_name "
               "ORDER BY executed_at DESC, run_id DESC) = 1)"))
def q_sla_compliance_by_freshness(spark, sf):
    return G.sla_compliance_by_freshness(_log(spark, sf))


@register("quality_alerts", O.with_ctes(
    _LOG, body="SELECT 'quality_check_failure' AS alert_type, "
               "CASE WHEN failed_checks > 3 THEN 'critical' ELSE 'warning' END AS severity, "
               "concat_ws('.', schema_name, table_name) AS \"table\", overall_status AS status, "
               "total_checks, failed_checks, run_id, contract_version, duration_seconds, "
               "executed_at AS \"timestamp\" "
               "FROM run_log WHERE overall_status IN ('failed', 'error')"))
def q_quality_alerts(spark, sf):
    return G.quality_alerts(_log(spark, sf))


@register("freshness_alerts", O.with_ctes(
    _LOG, body="SELECT 'freshness_sla_breach' AS alert_type, 'critical' AS severity, "
               "concat_ws('.', schema_name, table_name) AS \"table\", run_id, "
               "CAST(json_extract_string(result_data, '$.freshness_result.actual_delay_minutes') AS DOUBLE) "
               "AS actual_delay_minutes, "
               "CAST(json_extract_string(result_data, '$.freshness_result.max_delay_minutes') AS BIGINT) "
               "AS max_delay_minutes, executed_at AS \"timestamp\" FROM run_log "
               "WHERE json_extract_string(result_data, '$.freshness_result.status') = 'failed'"))
def q_freshness_alerts(spark, sf):
    return G.log_freshness_alerts(_log(spark, sf))


@register("run_summaries", O.with_ctes(
    _LOG, body="SELECT table_name, schema_name, overall_status, total_checks, passed_checks, "
               "failed_checks, CAST(round(CAST(duration_seconds AS DECIMAL(18, 6)), 3) AS DOUBLE) AS duration_seconds "
               "FROM run_log"))
def q_run_summaries(spark, sf):
    return G.run_summaries(_log(spark, sf))


# ------------------------------------------------------------ registry
from pyspark.sql import functions as F  # noqa: E402

from covenant.functions.text import stable_id, to_utc_timestamp_ntz  # noqa: E402
from covenant.plans import checkplan as P  # noqa: E402
from covenant.functions.literals import local_rows  # noqa: E402
from covenant.plans.contracts import contracts_df, read_contract_dir  # noqa: E402
from covenant.sources import registry as RG  # noqa: E402


@register("contract_lint", O.with_ctes(O.REGISTRY, body=O.LINT_BODY))
def q_contract_lint(spark, sf):
    return RG.lint_contracts(RG.contracts_from_part(spark, sf))


@register("check_plan", O.with_ctes(O.REGISTRY, body=O.PLAN_BODY))
def q_check_plan(spark, sf):
    return P.plan_many(RG.contracts_from_part(spark, sf)).select(
        "table_name", "schema_name", "check_type", "column", "params", "severity", "origin", "seq", "check_name")


@register("contract_summary", O.with_ctes(O.REGISTRY, body="""
SELECT table_name, schema_name, owner, version, 4 AS column_count, 4 AS rule_count,
       has_freshness AS has_freshness_sla, tags FROM reg_top"""))
def q_contract_summary(spark, sf):
    return RG.contract_summary(RG.contracts_from_part(spark, sf)).withColumn(
        "column_count", F.col("column_count").cast("int")).withColumn("rule_count", F.col("rule_count").cast("int"))


@register("required_columns", O.with_ctes(O.REGISTRY, body="""
SELECT table_name, schema_name,
       string_agg(name, ',' ORDER BY pos) FILTER (WHERE NOT nullable) AS required_columns,
       string_agg(name, ',' ORDER BY pos) FILTER (WHERE primary_key) AS primary_key_columns
FROM reg_cols GROUP BY table_name, schema_name"""))
def q_required_columns(spark, sf):
    r = RG.required_columns(RG.contracts_from_part(spark, sf))
    return r.select("table_name", "schema_name",
                    F.array_join("required_columns", ",").alias("required_columns"),
                    F.array_join("primary_key_columns", ",").alias("primary_key_columns"))


T0 = "2024-01-01 00:00:00"


def _legacy(spark, sf):
    n = read_table(spark, sf, "nation")
    return n.select(F.concat(F.lit("n_"), F.lower("n_name")).alias("table_name"),
                    F.lit("legacy").alias("schema_name"), F.lit("archive").alias("owner"),
                    F.lit("0.9.0").alias("version"))


def _new_from_supplier(spark, sf):
    s = read_table(spark, sf, "supplier")
    return s.select(F.concat(F.lit("s_"), F.col("s_suppkey").cast("string")).alias("table_name"),
                    F.lit("staging").alias("schema_name"), F.col("s_name").alias("owner"),
                    F.lit("1.0.0").alias("version"))


_REG_SMALL = "table_name, schema_name, owner, version"


@register("contract_upsert", O.with_ctes(O.REGISTRY, body=f"""
, cur AS (SELECT {_REG_SMALL} FROM reg_top
          UNION ALL SELECT concat('n_', lower(n_name)), 'legacy', 'archive', '0.9.0' FROM nation),
inc AS (SELECT table_name, schema_name, owner, '1.10.0' AS version FROM reg_top
        UNION ALL SELECT concat('s_', CAST(s_suppkey AS VARCHAR)), 'staging', s_name, '1.0.0' FROM supplier)
SELECT coalesce(i.table_name, c.table_name) AS table_name, coalesce(i.schema_name, c.schema_name) AS schema_name,
       CASE WHEN i.table_name IS NOT NULL THEN i.owner ELSE c.owner END AS owner,
       CASE WHEN i.table_name IS NOT NULL THEN i.version ELSE c.version END AS version,
       CASE WHEN c.table_name IS NOT NULL THEN TIMESTAMP '{T0}' ELSE TIMESTAMP '{AS_OF}' END AS created_at,
       CASE WHEN i.table_name IS NOT NULL THEN TIMESTAMP '{AS_OF}' ELSE TIMESTAMP '{T0}' END AS updated_at,
       CASE WHEN i.table_name IS NOT NULL AND c.table_name IS NOT NULL THEN 'updated'
            WHEN i.table_name IS NOT NULL THEN 'inserted' ELSE 'kept' END AS action
FROM cur c FULL OUTER JOIN inc i ON c.table_name = i.table_name AND c.schema_name = i.schema_name""".replace(
    "\n, cur AS", ", cur AS", 1).replace("WITH", "WITH", 1)))
def q_contract_upsert(spark, sf):
    reg = RG.contracts_from_part(spark, sf).select("table_name", "schema_name", "owner", "version")
    cur = reg.unionByName(_legacy(spark, sf)) \
        .withColumn("created_at", F.to_timestamp_ntz(F.lit(T0))) \
        .withColumn("updated_at", F.to_timestamp_ntz(F.lit(T0)))
    # each key twice in the batch: 1.10.0 is the later of the two
    twice = reg.withColumn("version", F.lit("1.9.0")).unionByName(reg.withColumn("version", F.lit("1.10.0")))
    return RG.upsert(cur, twice.unionByName(_new_from_supplier(spark, sf)), AS_OF)


@register("contract_delete", O.with_ctes(O.REGISTRY, body="""
, cur AS (SELECT table_name, schema_name FROM reg_top
          UNION ALL SELECT concat('n_', lower(n_name)), 'legacy' FROM nation),
req AS (SELECT DISTINCT * FROM (SELECT concat('n_', lower(n_name)) AS table_name, 'legacy' AS schema_name FROM nation
        UNION ALL SELECT concat('s_', CAST(s_suppkey AS VARCHAR)), 'staging' FROM supplier))
SELECT r.table_name, r.schema_name,
       EXISTS (SELECT 1 FROM cur c WHERE c.table_name = r.table_name AND c.schema_name = r.schema_name) AS deleted
FROM req r"""))
def q_contract_delete(spark, sf):
    reg = RG.contracts_from_part(spark, sf).select("table_name", "schema_name")
    cur = reg.unionByName(_legacy(spark, sf).select("table_name", "schema_name"))
    req = _legacy(spark, sf).select("table_name", "schema_name").unionByName(
        _new_from_supplier(spark, sf).select("table_name", "schema_name"))
    _, report = RG.delete(cur, req)
    return report


@register("contract_registry_after_delete", O.with_ctes(O.REGISTRY, body="""
SELECT table_name, schema_name FROM reg_top"""))
def q_contract_registry_after_delete(spark, sf):
    reg = RG.contracts_from_part(spark, sf).select("table_name", "schema_name")
    cur = reg.unionByName(_legacy(spark, sf).select("table_name", "schema_name"))
    remaining, _ = RG.delete(cur, _legacy(spark, sf).select("table_name", "schema_name"))
    return remaining


@register("insert_ignore", O.with_ctes(O.RAW_CUSTOMERS, O.STG_CUSTOMERS, body="""
SELECT c_custkey AS customer_id,
       concat(lower(replace(c_name, '#', '.')), CASE WHEN c_custkey % 2 = 0 THEN '@example.com' ELSE '@example.org' END) AS email
FROM customer
WHERE concat(lower(replace(c_name, '#', '.')), CASE WHEN c_custkey % 2 = 0 THEN '@example.com' ELSE '@example.org' END)
      NOT IN (SELECT email FROM stg_customers WHERE email IS NOT NULL)"""))
def q_insert_ignore(spark, sf):
    target = M.stg_customers(FX.raw_customers(spark, sf))
    c = read_table(spark, sf, "customer")
    incoming = c.select(F.col("c_custkey").alias("customer_id"), F.concat(
        F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))),
        F.when(F.col("c_custkey") % 2 == 0, F.lit("@example.com")).otherwise(F.lit("@example.org"))).alias("email"))
    return RG.insert_ignore(target, incoming, "email", F.col("customer_id").asc())


@register("insert_defaults", O.with_ctes(O.RAW_ORDERS, body=f"""
SELECT coalesce(CAST(order_id AS VARCHAR), sha256(concat_ws(chr(1), CAST(customer_id AS VARCHAR), CAST(version AS VARCHAR)))) AS order_id,
       order_id IS NULL AS order_id_generated, customer_id, coalesce(status, 'pending') AS status,
       coalesce(updated_at, TIMESTAMP '{AS_OF}') AS updated_at, version FROM raw_orders"""))
def q_insert_defaults(spark, sf):
    raw = FX.raw_orders(spark, sf).withColumn("order_id_generated", F.col("order_id").isNull())
    out = RG.insert_defaults(raw, {"order_id": stable_id("customer_id", "version"), "status": F.lit("pending"),
                                   "updated_at": F.to_timestamp_ntz(F.lit(AS_OF))})
    return out.select("order_id", "order_id_generated", "customer_id", "status", "updated_at", "version")


@register("insert_generated_ids", O.with_ctes(O.RAW_ORDERS, body="""
SELECT count(*) AS n_rows, count(*) AS n_ids, count(*) FILTER (WHERE order_id IS NULL) AS n_generated FROM raw_orders"""))
def q_insert_generated_ids(spark, sf):
    """A fresh id for each null key: none is null, and all are well formed."""
    raw = FX.raw_orders(spark, sf)
    out = RG.insert_defaults(raw, {"order_id": F.expr("uuid()")})
    new = F.col("order_id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    return out.agg(F.count("*").alias("n_rows"), F.count("order_id").alias("n_ids"), F.count_if(new).alias("n_generated"))


# ------------------------------------------------------- schema conformance

def _contracts_with_samples(spark, sf):
    samples = contracts_df(spark, [sample_contract("orders"), sample_contract("customers")])
    return RG.contracts_from_part(spark, sf).unionByName(samples)


@register("schema_checks", O.with_ctes(O.REGISTRY, O.CATALOG, O.SAMPLE_CONTRACT_COLUMNS,
                                       body=O.SCHEMA_MANY_BODY))
def q_schema_checks(spark, sf):
    return RG.schema_checks_many(spark, _contracts_with_samples(spark, sf),
                                 RG.inventory_from_data(spark, sf), RG.catalog_columns_from_part(spark, sf))


@register("schema_contract_missing", O.with_ctes(O.REGISTRY, O.CATALOG, body="""
SELECT lower(r.table_name) AS table_name, r.schema_name, lower(r.name) AS missing_column FROM reg_cols r
WHERE EXISTS (SELECT 1 FROM cat_cols c WHERE c.table_schema = r.schema_name AND c.table_name = lower(r.table_name))
  AND NOT EXISTS (SELECT 1 FROM cat_cols c WHERE c.table_schema = r.schema_name
                  AND c.table_name = lower(r.table_name) AND c.column_name = lower(r.name))"""))
def q_schema_contract_missing(spark, sf):
    return RG.missing_columns_many(RG.contracts_from_part(spark, sf), RG.catalog_columns_from_part(spark, sf))


@register("freshness_sla_breach", O.with_ctes(O.RAW_ORDERS, O.STG_ORDERS, body=f"""
SELECT last_updated, TIMESTAMP '{AS_OF}' AS check_time, delay_minutes, 120 AS max_allowed_minutes
FROM (SELECT max(updated_at) AS last_updated,
             (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(updated_at))) / 60000000.0 AS delay_minutes
      FROM stg_orders)
WHERE delay_minutes > 120 OR last_updated IS NULL"""))
def q_freshness_sla_breach(spark, sf):
    return M.freshness_sla_breach(M.stg_orders(FX.raw_orders(spark, sf)), "updated_at", 120, AS_OF)


# ------------------------------------------------------------ governance

def _total_tables_sql():
    return ("(SELECT count(*) FROM inventory WHERE table_schema NOT IN ('pg_catalog', 'information_schema') "
            "AND table_type = 'BASE TABLE')")


def _pct_sql(n, d, empty):
    return (f"CASE WHEN ({d}) > 0 THEN CAST(((({n}) * 20000 + ({d})) // (2 * ({d}))) AS DOUBLE) / 100.0 "
            f"ELSE {empty} END")


@register("governance_snapshot", O.with_ctes(O.REGISTRY, O.CATALOG, _LOG, body=f"""
SELECT {_pct_sql('tables_with_contracts', 'total_tables', '0.0')} AS contract_coverage_pct,
       {_pct_sql('total_checks_passed', 'total_checks_run', '0.0')} AS quality_pass_rate_pct,
       {_pct_sql('tables_within_sla', 'tables_with_freshness_sla', '100.0')} AS sla_compliance_pct,
       total_tables, tables_with_contracts, total_checks_run, total_checks_passed,
       tables_within_sla, tables_with_freshness_sla, TIMESTAMP '{AS_OF}' AS captured_at
FROM (SELECT {_total_tables_sql()} AS total_tables,
             (SELECT count(*) FROM reg_top) AS tables_with_contracts,
             (SELECT CAST(coalesce(sum(total_checks), 0) AS BIGINT) FROM ({_LATEST})) AS total_checks_run,
             (SELECT CAST(coalesce(sum(passed_checks), 0) AS BIGINT) FROM ({_LATEST})) AS total_checks_passed,
             (SELECT count(*) FILTER (WHERE overall_status = 'passed') FROM (SELECT * FROM run_log
                WHERE result_data LIKE '%freshness%' QUALIFY row_number() OVER (PARTITION BY table_name,
                schema_name ORDER BY executed_at DESC, run_id DESC) = 1)) AS tables_within_sla,
             (SELECT count(*) FROM (SELECT * FROM run_log WHERE result_data LIKE '%freshness%'
                QUALIFY row_number() OVER (PARTITION BY table_name, schema_name
                ORDER BY executed_at DESC, run_id DESC) = 1)) AS tables_with_freshness_sla)"""))
def q_governance_snapshot(spark, sf):
    return G.governance_snapshot(RG.inventory_from_data(spark, sf), RG.contracts_from_part(spark, sf),
                                 _log(spark, sf), AS_OF)


_DAILY = f"""
daily AS (
  SELECT {_pct_sql('tables_with_contracts', 'total_tables', '0.0')} AS contract_coverage_pct,
         {_pct_sql('total_checks_passed', 'total_checks_run', '0.0')} AS quality_pass_rate_pct,
         {_pct_sql('tables_within_sla', 'tables_with_freshness_sla', '100.0')} AS sla_compliance_pct,
         total_tables, tables_with_contracts, total_checks_run, total_checks_passed,
         tables_within_sla, tables_with_freshness_sla, captured_at
  FROM (SELECT CAST(executed_at AS DATE) + INTERVAL '23:59:59' AS captured_at,
               {_total_tables_sql()} AS total_tables,
               count(DISTINCT concat_ws('.', schema_name, table_name)) AS tables_with_contracts,
               CAST(sum(total_checks) AS BIGINT) AS total_checks_run,
               CAST(sum(passed_checks) AS BIGINT) AS total_checks_passed,
               count(DISTINCT CASE WHEN json_extract_string(result_data, '$.freshness_result.status') IS NOT NULL
                     THEN concat_ws('.', schema_name, table_name) END) AS tables_with_freshness_sla,
               count(DISTINCT CASE WHEN json_extract_string(result_data, '$.freshness_result.status') = 'passed'
                     THEN concat_ws('.', schema_name, table_name) END) AS tables_within_sla
        FROM run_log GROUP BY CAST(executed_at AS DATE)))"""
TREND_DAYS = 14


def _daily(spark, sf):
    return G.daily_snapshots(_log(spark, sf), G.count_user_tables(RG.inventory_from_data(spark, sf)))


@register("governance_trend", O.with_ctes(O.CATALOG, _LOG, _DAILY, body=f"""
SELECT * FROM daily WHERE captured_at >= TIMESTAMP '{AS_OF}' - INTERVAL '{TREND_DAYS}' DAY"""))
def q_governance_trend(spark, sf):
    return G.trend(_daily(spark, sf), TREND_DAYS, AS_OF)


@register("trend_bounds", O.with_ctes(O.CATALOG, _LOG, _DAILY, body=f"""
SELECT min(captured_at) AS period_start, max(captured_at) AS period_end, count(*) AS snapshots
FROM daily WHERE captured_at >= TIMESTAMP '{AS_OF}' - INTERVAL '{TREND_DAYS}' DAY"""))
def q_trend_bounds(spark, sf):
    return G.trend_bounds(_daily(spark, sf), TREND_DAYS, AS_OF)


@register("latest_snapshot", O.with_ctes(O.CATALOG, _LOG, _DAILY, body="""
SELECT * FROM daily ORDER BY captured_at DESC LIMIT 1"""))
def q_latest_snapshot(spark, sf):
    return G.latest_snapshot(_daily(spark, sf))


# ------------------------------------------------------------ streaming
from covenant.streaming import gate as SG  # noqa: E402

EVENT_RULES = [
    {"rule_type": "not_null", "column": "user_id"},
    {"rule_type": "accepted_values", "column": "event_type",
     "parameters": {"values": ["view", "click", "purchase", "signup"]}},
    {"rule_type": "min_value", "column": "value", "parameters": {"value": 1}},
    {"rule_type": "max_value", "column": "value", "parameters": {"value": 300}},
    {"rule_type": "regex_match", "column": "props", "parameters": {"pattern": '^\\{"k": [0-9]+\\}$'}},
]


@register("stream_rule_gate", """
SELECT 'not_null' AS check_type, 'user_id' AS "column", CAST(count(*) FILTER (WHERE user_id IS NULL) AS BIGINT) AS violations FROM events
UNION ALL SELECT 'accepted_values', 'event_type', count(*) FILTER (WHERE event_type IS NOT NULL
  AND event_type NOT IN ('view', 'click', 'purchase', 'signup')) FROM events
UNION ALL SELECT 'min_value', 'value', count(*) FILTER (WHERE value < 1) FROM events
UNION ALL SELECT 'max_value', 'value', count(*) FILTER (WHERE value > 300) FROM events
UNION ALL SELECT 'regex_match', 'props', count(*) FILTER (WHERE props IS NOT NULL
  AND NOT regexp_matches(props, '^\\{"k": [0-9]+\\}$')) FROM events
UNION ALL SELECT 'rows_checked', NULL, count(*) FROM events""")
def q_stream_rule_gate(spark, sf):
    schema = read_table(spark, sf, "events").schema
    return SG.run_rule_gate(spark, sf, schema, "events", EVENT_RULES, glob="events.parquet")


# ------------------------------------------------------------ pipeline
from covenant.plans import pipeline as PL  # noqa: E402


def _pipeline(spark, sf, extra=()):
    """The governed tables under the sample contracts, and more contracts."""
    tables = governed(spark, sf).add("good", read_table(spark, sf, "events"), "sales")
    return PL.governance_run(spark, [sample_contract("orders"), sample_contract("customers"), *extra], tables,
                             RG.inventory_from_data(spark, sf), RG.contracts_from_part(spark, sf), AS_OF)


#: contracts with parts that cannot run: a table of another schema only, a
#: freshness column of text, a query that fails on the data, and no SLA
_EVENT_TYPES = ["view", "click", "purchase", "signup"]
_ROUGH = [
    {"table_name": "good", "schema_name": "public", "version": "0.1.0", "columns": [{"name": "ts", "type": "timestamp"}]},
    {"table_name": "good", "schema_name": "sales", "version": "0.2.0", "columns": [{"name": "ts", "type": "timestamp"}],
     "quality_rules": [{"rule_type": "accepted_values", "column": "event_type", "parameters": {"values": _EVENT_TYPES}},
                       {"rule_type": "custom_sql", "parameters": {"expression": "cast(raise_error(event_type) AS boolean)"}},
                       {"rule_type": "min_value", "column": "value", "parameters": {"value": 1}}],
     "freshness": {"timestamp_column": "event_type", "max_delay_minutes": 5}},
]


@register("governance_pipeline", O.with_ctes(O.RAW_ORDERS, O.RAW_CUSTOMERS, _oracle_checks_cte(), body=(
    "SELECT table_name, schema_name, CASE WHEN table_name = 'orders' THEN '3.2.1' ELSE '1.4.0' END AS contract_version, "
    "overall_status, total_checks, passed_checks, failed_checks, "
    "warning_checks FROM (" + _ROLLUP_BODY
    + ")")))
def q_governance_pipeline(spark, sf):
    out = _pipeline(spark, sf)
    return out["runs"].select("table_name", "schema_name", "contract_version", "overall_status", "total_checks",
                              "passed_checks", "failed_checks", "warning_checks")


@register("pipeline_error_run", """
SELECT 'good' AS table_name, 'public' AS schema_name, 0 AS seq, 'table_exists' AS check_name, 'failed' AS status, CAST(1 AS BIGINT) AS violations
UNION ALL SELECT 'good', 'sales', 1, 'column_exists_ts', 'passed', 0
UNION ALL SELECT 'good', 'sales', 2, 'column_type_ts', 'passed', 0
UNION ALL SELECT 'good', 'sales', 3, 'row_count_min', 'passed', 0
UNION ALL SELECT 'good', 'sales', 4, 'accepted_values_event_type', CASE WHEN v > 0 THEN 'failed' ELSE 'passed' END, v FROM
  (SELECT count(*) FILTER (WHERE event_type NOT IN ('view', 'click', 'purchase', 'signup')) AS v FROM events)
UNION ALL SELECT 'good', 'sales', 5, 'custom_sql', 'error', NULL
UNION ALL SELECT 'good', 'sales', 6, 'min_value_value', CASE WHEN v > 0 THEN 'failed' ELSE 'passed' END, v FROM
  (SELECT count(*) FILTER (WHERE value < 1) AS v FROM events)
UNION ALL SELECT 'good', 'sales', 7, 'freshness_event_type', 'error', NULL""")
def q_pipeline_error_run(spark, sf):
    """GOV2/GOV3: what fails at run time is one ERROR check; the other checks of its table stay."""
    out = PL.governance_run(spark, _ROUGH, governed(spark, sf).add("good", read_table(spark, sf, "events"), "sales"),
                            RG.inventory_from_data(spark, sf), RG.contracts_from_part(spark, sf), AS_OF)
    return out["checks"].select("table_name", "schema_name", "seq", "check_name", "status", "violations")


@register("pipeline_sla_compliance", O.with_ctes(O.RAW_ORDERS, O.RAW_CUSTOMERS, _oracle_checks_cte(), body="""
SELECT count(*) FILTER (WHERE status = 'passed') AS tables_within_sla, count(*) + 1 AS tables_with_freshness_sla
FROM all_checks WHERE check_type = 'freshness'"""))
def q_pipeline_sla_compliance(spark, sf):
    """AGG6 over the log that the engine wrote; the table with an unreadable freshness column is one more."""
    return G.sla_compliance_by_freshness(_pipeline(spark, sf, _ROUGH)["log"])


@register("pipeline_freshness_alerts", O.with_ctes(O.RAW_ORDERS, O.RAW_CUSTOMERS, _oracle_checks_cte(), body=f"""
SELECT concat_ws('.', schema_name, table_name) AS "table", CAST(expected_value AS BIGINT) AS max_delay_minutes,
       CASE table_name WHEN 'orders' THEN round({O._delay('raw_orders', AS_OF)}, 2) ELSE round({O._delay('raw_customers', AS_OF)}, 2) END AS actual_delay_minutes
FROM all_checks WHERE check_type = 'freshness' AND status = 'failed'"""))
def q_pipeline_freshness_alerts(spark, sf):
    return G.log_freshness_alerts(_pipeline(spark, sf)["log"]).select("table", "max_delay_minutes", "actual_delay_minutes")


@register("pipeline_alerts", O.with_ctes(O.RAW_ORDERS, O.RAW_CUSTOMERS, _oracle_checks_cte(), body=f"""
SELECT CASE WHEN r.failed_checks > 3 THEN 'critical' ELSE 'warning' END AS severity,
       concat_ws('.', r.schema_name, r.table_name) AS "table", r.overall_status AS status, r.failed_checks,
       array_to_string(list_slice(n.names, 1, 10), ',') AS failed_check_names
FROM ({_ROLLUP_BODY}) r JOIN (SELECT table_name, list(check_name ORDER BY seq) AS names
     FROM all_checks WHERE status = 'failed' GROUP BY table_name) n ON r.table_name = n.table_name
WHERE r.overall_status IN ('failed', 'error')"""))
def q_pipeline_alerts(spark, sf):
    """GOV9/GOV11: a second run on the same log alerts for its own tables only."""
    tables, registry = governed(spark, sf), RG.contracts_from_part(spark, sf)
    root = PL.new_folder(spark)
    for _ in range(2):
        out = PL.governance_run(spark, [sample_contract("orders"), sample_contract("customers")], tables,
                                RG.inventory_from_data(spark, sf), registry, AS_OF, out_dir=root)
    return out["alerts"].select("severity", "table", "status", "failed_checks",
                                F.array_join("failed_check_names", ",").alias("failed_check_names"))


@register("pipeline_snapshot", O.with_ctes(O.REGISTRY, O.CATALOG, O.RAW_ORDERS, O.RAW_CUSTOMERS, _oracle_checks_cte(), body=f"""
SELECT {_pct_sql('c', 't', '0.0')} AS contract_coverage_pct, {_pct_sql('p', 'n', '0.0')} AS quality_pass_rate_pct,
       {_pct_sql('w', '2', '100.0')} AS sla_compliance_pct, n AS total_checks_run, p AS total_checks_passed
FROM (SELECT {_total_tables_sql()} AS t, (SELECT count(*) FROM reg_top) AS c, count(*) AS n,
             count(*) FILTER (WHERE status = 'passed') AS p,
             (SELECT count(*) FROM ({_ROLLUP_BODY}) WHERE overall_status = 'passed') AS w FROM all_checks)"""))
def q_pipeline_snapshot(spark, sf):
    """GOV4 over the engine's own log, captured and read back (SINK4)."""
    out = _pipeline(spark, sf)
    kept = RG.materialise(out["snapshot"], PL.new_folder(spark))
    return kept.select("contract_coverage_pct", "quality_pass_rate_pct", "sla_compliance_pct", "total_checks_run", "total_checks_passed")


# ------------------------------------------------------------ more registry / rules

@register("contract_resolve", O.with_ctes(O.REGISTRY, body="""
, files(table_name, schema_name, version) AS (VALUES ('orders', 'public', '3.2.1'),
    ('customers', 'public', '1.4.0'), ('t_1', 'public', '3.2.1'))
SELECT table_name, schema_name, version, 'registry' AS source FROM reg_top
UNION ALL
SELECT f.table_name, f.schema_name, f.version, 'file' FROM files f
WHERE NOT EXISTS (SELECT 1 FROM reg_top r WHERE r.table_name = f.table_name AND r.schema_name = f.schema_name)"""))
def q_contract_resolve(spark, sf):
    files = contracts_df(spark, [sample_contract("orders"), sample_contract("customers"),
                                 {**sample_contract("orders"), "table_name": "t_1", "schema_name": "public"}])
    out = RG.resolve_contracts(RG.contracts_from_part(spark, sf), files)
    return out.select("table_name", "schema_name", "version", "source")


@register("contract_list", O.with_ctes(O.REGISTRY, body="SELECT table_name, schema_name, owner, version FROM reg_top"))
def q_contract_list(spark, sf):
    """SRC8 over a registry snapshot that was committed and read back."""
    root = PL.new_folder(spark)
    RG.commit_snapshot(RG.contracts_from_part(spark, sf), root)
    return RG.list_contracts(RG.read_snapshot(spark, root)).select("table_name", "schema_name", "owner", "version")


@register("contract_directory", O.with_ctes(O.REGISTRY, body="""
SELECT lower(table_name) AS table_name, schema_name, version, 4 AS column_count, 4 AS rule_count FROM reg_top"""))
def q_contract_directory(spark, sf):
    """SRC9: the registry as a folder of JSON documents, read as definition files."""
    folder = PL.new_folder(spark)
    RG.contracts_from_part(spark, sf).write.json(folder)
    return read_contract_dir(spark, folder, multi_line=False).select(
        "table_name", "schema_name", "version", F.size("columns").alias("column_count"), F.size("quality_rules").alias("rule_count"))


@register("materialised_summary", O.with_ctes(
    O.RAW_ORDERS, O.RAW_CUSTOMERS, O.STG_ORDERS, O.STG_CUSTOMERS, O.FCT_ORDER_SUMMARY,
    body="SELECT country, count(*) AS customers, CAST(sum(total_orders) AS BIGINT) AS orders FROM fct_order_summary GROUP BY country"))
def q_materialised_summary(spark, sf):
    """SINK5: the summary written as a table; SQL over the read-back."""
    out = M.fct_order_summary(M.stg_orders(FX.raw_orders(spark, sf)), M.stg_customers(FX.raw_customers(spark, sf)))
    kept = RG.materialise(out, PL.new_folder(spark))
    return spark.sql("SELECT country, count(*) AS customers, sum(total_orders) AS orders FROM {t} GROUP BY country", t=kept)


@register("utc_times", """
SELECT event_id, ts AS naive, ts - INTERVAL '90' MINUTE AS zoned, CAST(NULL AS TIMESTAMP) AS unreadable FROM events""")
def q_utc_times(spark, sf):
    """FN7: text with and without a zone."""
    e = read_table(spark, sf, "events")
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return e.select("event_id", to_utc_timestamp_ntz(text).alias("naive"),
                    to_utc_timestamp_ntz(F.concat(text, F.lit("+01:30"))).alias("zoned"),
                    to_utc_timestamp_ntz(F.lit("soon")).alias("unreadable"))


@register("rule_unique_composite", O.with_ctes(O.RAW_ORDERS, body="""
SELECT 'unique' AS check_type, 'customer_id,order_date' AS "column",
       CASE WHEN count(*) > 0 THEN 'failed' ELSE 'passed' END AS status, 'error' AS severity,
       CAST(count(*) AS BIGINT) AS violations, CAST(count(*) AS VARCHAR) AS actual_value, '0' AS expected_value,
       concat('unique on customer_id,order_date: ', count(*), ' duplicated values in ', coalesce(sum(n), 0), ' rows') AS message
FROM (SELECT count(*) AS n FROM raw_orders WHERE customer_id IS NOT NULL AND order_date IS NOT NULL
      GROUP BY customer_id, order_date HAVING count(*) > 1)"""))
def q_rule_unique_composite(spark, sf):
    rule = {"rule_type": "unique", "parameters": {"columns": ["customer_id", "order_date"]}}
    return C.evaluate_rules(spark, FX.raw_orders(spark, sf), "orders", [rule]).select(*RULE_OUT)


@register("run_payload_checks", O.with_ctes(O.RAW_ORDERS, O.RAW_CUSTOMERS, _oracle_checks_cte(), body="""
SELECT table_name, schema_name, check_name, check_type, "column", status, severity, violations, seq
FROM all_checks"""))
def q_run_payload_checks(spark, sf):
    return G.payload_checks(_pipeline(spark, sf)["runs"]).drop("run_id")


# ------------------------------------------------------------ keys, columns, queries

_FRACTIONAL = "customer_id + CASE WHEN customer_id % 3 = 0 THEN 0.6 ELSE 0 END"


def _fractional_references(spark, sf) -> TableSet:
    """Customers whose every third key has a fraction, as double, decimal and text."""
    key = FX.raw_customers(spark, sf).select((F.col("customer_id") + F.when(F.col("customer_id") % 3 == 0, F.lit(0.6)).otherwise(F.lit(0))).alias("k"))
    return TableSet({"by_double": key.select(F.col("k").cast("double").alias("customer_id")),
                     "by_decimal": key.select(F.col("k").cast("decimal(20,2)").alias("customer_id")),
                     "by_text": key.select(F.col("k").cast("string").alias("customer_id"))})


@register("rule_fk_key_types", O.with_ctes(O.RAW_ORDERS, O.RAW_CUSTOMERS, body="""
, gone AS (SELECT customer_id, count(*) AS n FROM raw_orders o WHERE customer_id IS NOT NULL AND NOT EXISTS
             (SELECT 1 FROM raw_customers c WHERE c.customer_id = o.customer_id AND c.customer_id % 3 <> 0) GROUP BY customer_id)
SELECT r.t AS expected_value, CAST((SELECT sum(n) FROM gone) AS BIGINT) AS violations, CAST((SELECT count(*) FROM gone) AS VARCHAR) AS actual_value
FROM (VALUES ('by_double.customer_id'), ('by_decimal.customer_id'), ('by_text.customer_id')) AS r(t)"""))
def q_rule_fk_key_types(spark, sf):
    """JOIN4/RUL9: 3.6 is no match for 3, whatever the type that holds it."""
    rules = [{"rule_type": "referential_integrity", "column": "customer_id", "parameters": {"reference_table": t, "reference_column": "customer_id"}}
             for t in ("by_double", "by_decimal", "by_text")]
    out = C.evaluate_rules(spark, FX.raw_orders(spark, sf), "orders", rules, _fractional_references(spark, sf))
    return out.select("expected_value", "violations", "actual_value")


@register("contract_upsert_columns", O.with_ctes(O.REGISTRY, body=f"""
, cur AS (SELECT table_name, schema_name, owner, concat('kept for ', table_name) AS note FROM reg_top
          UNION ALL SELECT concat('n_', lower(n_name)), 'legacy', 'archive', 'old' FROM nation),
inc AS (SELECT table_name, schema_name, concat(owner, '!') AS owner, 'data' AS team FROM reg_top
        UNION ALL SELECT concat('s_', CAST(s_suppkey AS VARCHAR)), 'staging', s_name, 'supply' FROM supplier)
SELECT coalesce(i.table_name, c.table_name) AS table_name, coalesce(i.schema_name, c.schema_name) AS schema_name,
       CASE WHEN i.table_name IS NOT NULL THEN i.owner ELSE c.owner END AS owner, c.note, i.team,
       CASE WHEN i.table_name IS NOT NULL AND c.table_name IS NOT NULL THEN 'updated'
            WHEN i.table_name IS NOT NULL THEN 'inserted' ELSE 'kept' END AS action
FROM cur c FULL OUTER JOIN inc i ON c.table_name = i.table_name AND c.schema_name = i.schema_name"""))
def q_contract_upsert_columns(spark, sf):
    """SINK1: the store has a column that the batch lacks, and the other way round."""
    reg = RG.contracts_from_part(spark, sf).select("table_name", "schema_name", "owner")
    cur = reg.withColumn("note", F.concat(F.lit("kept for "), "table_name")).unionByName(
        _legacy(spark, sf).select("table_name", "schema_name", "owner", F.lit("old").alias("note")))
    inc = reg.withColumn("owner", F.concat("owner", F.lit("!"))).withColumn("team", F.lit("data")).unionByName(
        _new_from_supplier(spark, sf).select("table_name", "schema_name", "owner", F.lit("supply").alias("team")))
    return RG.upsert(cur, inc, AS_OF).select("table_name", "schema_name", "owner", "note", "team", "action")


@register("registry_two_writers", O.with_ctes(O.REGISTRY, body="""
SELECT table_name, schema_name, owner, '1.10.0' AS version FROM reg_top
UNION ALL SELECT concat('n_', lower(n_name)), 'legacy', 'archive', '0.9.0' FROM nation
UNION ALL SELECT concat('s_', CAST(s_suppkey AS VARCHAR)), 'staging', s_name, '1.0.0' FROM supplier"""))
def q_registry_two_writers(spark, sf):
    """SINK1/SINK4: a writer commits while another makes its version; the
    second one's commit fails, it goes again on the new version, and both stay."""
    root = PL.new_folder(spark)
    reg = RG.contracts_from_part(spark, sf).select("table_name", "schema_name", "owner", "version")
    RG.change_snapshot(spark, root, lambda _: RG.upsert(reg.limit(0), reg.unionByName(_legacy(spark, sf)), T0).drop("action"))
    seen = []

    def slow(stored):
        if not seen:  # the other writer is quicker, once
            RG.change_snapshot(spark, root, lambda now: RG.upsert(now, _new_from_supplier(spark, sf), AS_OF).drop("action"))
        seen.append(1)
        return RG.upsert(stored, reg.withColumn("version", F.lit("1.10.0")), AS_OF).drop("action")

    RG.change_snapshot(spark, root, slow)
    return RG.read_snapshot(spark, root).select("table_name", "schema_name", "owner", "version")


_TABLE_QUERIES = [
    "SELECT o.order_id FROM {table} o JOIN {sales.customers} c ON o.customer_id = c.customer_id WHERE o.order_date < c.created_at",
    "SELECT c.customer_id FROM {sales.customers} c LEFT ANTI JOIN {table} o ON o.customer_id = c.customer_id",
    "SELECT e.event_id FROM {events} e LEFT ANTI JOIN {sales.customers} c ON e.user_id = c.customer_id WHERE e.props <> '{\"k\": 1}'",
    "SELECT 1 FROM {table} t JOIN {warehouse.stock} s ON t.order_id = s.order_id",
]


@register("rule_custom_sql_tables", O.with_ctes(O.RAW_ORDERS, O.RAW_CUSTOMERS, body="""
SELECT 1 AS seq, CAST(count(*) AS BIGINT) AS violations, CASE WHEN count(*) > 0 THEN 'failed' ELSE 'passed' END AS status,
       concat('custom query returned ', count(*), ' failing rows') AS message
FROM raw_orders o JOIN raw_customers c ON o.customer_id = c.customer_id WHERE o.order_date < c.created_at
UNION ALL SELECT 2, count(*), CASE WHEN count(*) > 0 THEN 'failed' ELSE 'passed' END, concat('custom query returned ', count(*), ' failing rows')
FROM raw_customers c WHERE NOT EXISTS (SELECT 1 FROM raw_orders o WHERE o.customer_id = c.customer_id)
UNION ALL SELECT 3, count(*), CASE WHEN count(*) > 0 THEN 'failed' ELSE 'passed' END, concat('custom query returned ', count(*), ' failing rows')
FROM events e WHERE props <> '{"k": 1}' AND NOT EXISTS (SELECT 1 FROM raw_customers c WHERE c.customer_id = e.user_id)
UNION ALL SELECT 4, NULL, 'error', 'custom_sql names warehouse.stock, which is no governed table'"""))
def q_rule_custom_sql_tables(spark, sf):
    """RUL7 over several governed tables, by schema and name; an unknown one is one ERROR check."""
    tables = TableSet({"sales.customers": FX.raw_customers(spark, sf), "events": read_table(spark, sf, "events")})
    rules = [{"rule_type": "custom_sql", "parameters": {"sql": q}} for q in _TABLE_QUERIES]
    return C.evaluate_rules(spark, FX.raw_orders(spark, sf), "orders", rules, tables).select("seq", "violations", "status", "message")


@register("metrics_capture_if_none", f"SELECT *, CAST(1 AS BIGINT) AS captures FROM ({ORACLE_SQL['governance_snapshot']})")
def q_metrics_capture_if_none(spark, sf):
    """TOP3: asked twice of an empty metrics folder; the first captures."""
    from covenant.plans.workspace import Workspace
    ws = Workspace(spark, PL.new_folder(spark), inventory=RG.inventory_from_data(spark, sf))
    RG.commit_snapshot(RG.contracts_from_part(spark, sf), ws.registry_root)
    _log(spark, sf).withColumn("run_date", F.to_date("executed_at")).write.partitionBy("run_date").parquet(ws.log_path)
    ws.current_metrics(AS_OF)
    return ws.current_metrics(AS_OF).withColumn("captures", F.lit(ws._metrics().count()))


# ------------------------------------------------------------ new data only, footers, quarantine
from covenant.operators import quarantine as QU  # noqa: E402
from covenant.plans.incremental import IncrementalChecks  # noqa: E402
from covenant.sources import footers as FT  # noqa: E402
from covenant.streaming import stateful as SS  # noqa: E402


@register("incremental_checks", O.with_ctes(O.RAW_ORDERS, O.RAW_CUSTOMERS, body=f"""
SELECT *, CAST(1 AS BIGINT) AS files_read FROM ({O.contract_oracle("orders", AS_OF)})"""))
def q_incremental_checks(spark, sf):
    """RUL1-9/GOV11 on new data only: a first run reads the first versions of
    all orders; the second reads the one file that came since, and its checks
    are those of the whole table."""
    orders, folder = FX.raw_orders(spark, sf), PL.new_folder(spark)
    run = IncrementalChecks(spark, sample_contract("orders"), folder, PL.new_folder(spark), governed(spark, sf))
    orders.filter("version = 1").write.parquet(folder)
    run.run(AS_OF)
    orders.filter("version <> 1").coalesce(1).write.mode("append").parquet(folder)
    second = run.run(AS_OF)
    return second.checks.select(*CHECK_OUT).withColumn("files_read", F.lit(second.files_read).cast("long"))


@register("freshness_from_statistics", O.with_ctes(O.RAW_ORDERS, body="SELECT *, CAST(0 AS BIGINT) AS files_scanned FROM (" + "\nUNION ALL\n".join([
    _fresh_sql("raw_orders", "updated_at", 720, "orders"), _fresh_sql("events", "ts", 10080, "events"),
    _fresh_sql("lineitem", "l_shipdate", 1440, "lineitem")]) + ")"))
def q_freshness_from_statistics(spark, sf):
    """AGG3/CHK3 from Parquet footers: no file is scanned."""
    folder = PL.new_folder(spark)
    FX.raw_orders(spark, sf).write.parquet(folder)
    items = [(folder, sample_contract("orders"))] + [
        (table_path(sf, t), {"table_name": t, "columns": [{"name": c}], "freshness": {"timestamp_column": c, "max_delay_minutes": m}})
        for t, c, m in (("events", "ts", 10080), ("lineitem", "l_shipdate", 1440))]
    parts = [FT.freshness_from_footers(spark, path, c, AS_OF).select(*FRESH_OUT, "files_scanned") for path, c in items]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _given(spark, sf):
    """The given tables and two that do not exist, with their paths."""
    return local_rows(spark, [("main", t, table_path(sf, t)) for t in (*BASE_TABLES, "shipments", "stock")], "table_schema string, table_name string, path string")


@register("catalog_scan", O.with_ctes(O.GIVEN_COLUMNS, body="""
SELECT table_schema, table_name, true AS found, ordinal_position, column_name, data_type FROM given_cols
UNION ALL SELECT 'main', t, false, NULL, NULL, NULL FROM (VALUES ('shipments'), ('stock')) AS v(t)"""))
def q_catalog_scan(spark, sf):
    """SRC4/SRC5: existence and columns of all tables of a registry from their footers."""
    return FT.catalog_scan(spark, _given(spark, sf)).select("table_schema", "table_name", "found", "ordinal_position", "column_name", "data_type")


#: (table, columns with their contract types) of the given tables; some do not hold
_GIVEN_CONTRACTS = {
    "orders": [("o_orderkey", "integer"), ("o_totalprice", "decimal"), ("o_orderdate", "timestamp"), ("o_clerk", "string")],
    "events": [("event_id", "integer"), ("ts", "timestamp"), ("event_type", "string"), ("value", "float")],
    "documents": [("doc_id", "integer"), ("text", "text"), ("lang", "uuid")],
    "shipments": [("shipped_at", "timestamp")],
}


@register("catalog_contract_checks", O.with_ctes(O.REGISTRY, O.CATALOG, O.GIVEN_COLUMNS, body="""
, exp(table_name, "column", contract_type) AS (VALUES """ + ", ".join(f"('{t}', '{c}', '{k}')" for t, cs in _GIVEN_CONTRACTS.items() for c, k in cs) + """),
j AS (SELECT e.*, g.data_type FROM exp e LEFT JOIN given_cols g ON g.table_name = e.table_name AND g.column_name = e."column" WHERE e.table_name <> 'shipments')
SELECT 'shipments' AS table_name, 'main' AS schema_name, 'table_exists' AS check_type, NULL AS "column", 'failed' AS status, NULL AS expected_value, NULL AS actual_value
UNION ALL SELECT table_name, 'main', 'column_exists', "column", CASE WHEN data_type IS NULL THEN 'failed' ELSE 'passed' END, NULL, NULL FROM j
UNION ALL SELECT table_name, 'main', 'column_type', "column",
  CASE WHEN EXISTS (SELECT 1 FROM accepted a WHERE a.contract_type = j.contract_type AND a.data_type = j.data_type) THEN 'passed' ELSE 'failed' END,
  contract_type, data_type FROM j WHERE data_type IS NOT NULL"""))
def q_catalog_contract_checks(spark, sf):
    """CHK1/CHK2/CHK5/SRC6: contracts against the catalog that the footers give."""
    docs = [{"table_name": t, "schema_name": "main", "columns": [{"name": c, "type": k} for c, k in cs]} for t, cs in _GIVEN_CONTRACTS.items()]
    scan = RG.materialise(FT.catalog_scan(spark, _given(spark, sf)), PL.new_folder(spark))
    return RG.schema_checks_many(spark, contracts_df(spark, docs), scan.filter("found"), scan.filter("found"))


_ORDER_RULES = [RULES[n][1] for n in ("not_null", "unique", "accepted_values", "min_value", "max_value", "custom_sql", "referential_integrity")]
_BROKEN = """
marked AS (
  SELECT o.*, concat_ws(',', CASE WHEN order_id IS NULL THEN 'not_null_order_id' END,
    CASE WHEN order_id IN (SELECT order_id FROM raw_orders WHERE order_id IS NOT NULL GROUP BY order_id HAVING count(*) > 1) THEN 'unique_order_id' END,
    CASE WHEN status NOT IN ('cancelled', 'completed', 'pending', 'refunded') THEN 'accepted_values_status' END,
    CASE WHEN total_amount < 0 THEN 'min_value_total_amount' END, CASE WHEN total_amount > 400000 THEN 'max_value_total_amount' END,
    CASE WHEN NOT (abs(total_amount) < 450000) THEN 'custom_sql' END,
    CASE WHEN customer_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM raw_customers c WHERE c.customer_id = o.customer_id) THEN 'referential_integrity_customer_id' END) AS rules
  FROM raw_orders o)"""


def _quarantined(spark, sf) -> str:
    path = PL.new_folder(spark)
    QU.write_split(QU.tag(FX.raw_orders(spark, sf), _ORDER_RULES, governed(spark, sf)), path)
    return path


@register("quarantine_rows", O.with_ctes(O.RAW_ORDERS, O.RAW_CUSTOMERS, _BROKEN, body="SELECT order_id, customer_id, version, status, rules FROM marked WHERE rules <> ''"))
def q_quarantine_rows(spark, sf):
    """VIO1: the failed rows of all rules in one pass, each with the rules that it breaks."""
    rows = QU.read_split(spark, _quarantined(spark, sf), passed=False)
    return rows.select("order_id", "customer_id", "version", "status", F.array_join(QU.BROKEN, ",").alias("rules"))


@register("quarantine_counts", O.with_ctes(O.RAW_ORDERS, O.RAW_CUSTOMERS, _BROKEN, body="""
SELECT rule, count(*) AS n_rows FROM (SELECT unnest(string_split(rules, ',')) AS rule FROM marked WHERE rules <> '') GROUP BY rule
UNION ALL SELECT 'passed', count(*) FROM marked WHERE rules = '' UNION ALL SELECT 'failed', count(*) FROM marked WHERE rules <> ''"""))
def q_quarantine_counts(spark, sf):
    """Rows per broken rule, and passed and failed rows (together: all rows)."""
    path = _quarantined(spark, sf)
    failed, passed = QU.read_split(spark, path, False), QU.read_split(spark, path, True)
    total = [d.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("rule"), "n_rows") for n, d in (("failed", failed), ("passed", passed))]
    return QU.broken_counts(failed).unionByName(total[0]).unionByName(total[1])


def _landed(spark, sf, files: int) -> str:
    """The events as they land: one file after the other."""
    folder = PL.new_folder(spark)
    read_table(spark, sf, "events").repartition(files, "event_id").write.parquet(folder)
    return folder


@register("stream_unique_gate", """
SELECT CAST(count(*) AS BIGINT) AS duplicate_keys, CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS n FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY user_id, event_type HAVING count(*) > 1)""")
def q_stream_unique_gate(spark, sf):
    """STR1/RUL2 across micro-batches: keyed state finds duplicates in different files."""
    folder = _landed(spark, sf, 4)
    q, sink = SS.start_unique_gate(spark, folder, read_table(spark, sf, "events").schema, "events", ["user_id", "event_type"],
                                   base_dir=PL.new_folder(spark), max_files_per_trigger=2)
    q.awaitTermination()
    return SS.duplicate_totals(spark, sink, ["user_id", "event_type"]).select("duplicate_keys", "duplicate_rows")


@register("stream_reference_gate", """
SELECT user_id, count(*) AS n_rows FROM events WHERE user_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 0 AND c_custkey = user_id) GROUP BY user_id""")
def q_stream_reference_gate(spark, sf):
    """STR1/RUL9 on a stream: events of users who are no customers in credit."""
    folder = _landed(spark, sf, 4)
    customers = read_table(spark, sf, "customer").filter("c_acctbal > 0")
    q, sink = SS.start_reference_gate(spark, folder, read_table(spark, sf, "events").schema, "events", "user_id", lambda: customers, "c_custkey",
                                      base_dir=PL.new_folder(spark), max_files_per_trigger=2)
    q.awaitTermination()
    return SS.open_orphans(spark, sink, "user_id", customers, "c_custkey")


from covenant.operators.bloom import large_orphans  # noqa: E402


@register("rule_fk_large_reference", """
SELECT o_orderkey, count(*) AS n_rows FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 30) GROUP BY o_orderkey""")
def q_rule_fk_large_reference(spark, sf):
    """JOIN4/RUL9 against a table larger than the one that refers to it, block
    filters before the shuffle: orders without a line of more than 30 pieces."""
    return large_orphans(read_table(spark, sf, "orders"), "o_orderkey", read_table(spark, sf, "lineitem").filter("l_quantity > 30"), "l_orderkey")


@register("log_compaction", O.with_ctes(_LOG, body=f"SELECT {_SUMMARY} FROM ({_LATEST})"))
def q_log_compaction(spark, sf):
    """SINK3: the latest runs of a log whose older run folders were compacted and dropped."""
    path = PL.new_folder(spark)
    rows = _log(spark, sf).withColumn("run_date", F.to_date("executed_at")).withColumn("run", F.format_string("run-%d", F.pmod("run_id", F.lit(3))))
    rows.repartition("run_date", "run").write.partitionBy("run_date", "run").parquet(path)
    R.compact_log(spark, path, "2024-01-20")
    R.drop_compacted(spark, path)
    return G.latest_per_table(R.read_log(spark, path)).select(*G.SUMMARY_COLUMNS)
