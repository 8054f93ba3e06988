"""DuckDB SQL for the correctness gate.

The oracle restates each query in plain SQL over the driver's tables so an
independent engine can check our Spark results. The governed tables are
CTEs with the same derivation rules as ``covenant.sources.fixtures``.
"""

from __future__ import annotations

RAW_ORDERS = """
raw_orders AS (
  WITH b AS (
    SELECT o_orderkey AS k, o_custkey, o_totalprice, o_orderstatus, o_orderdate, 0 AS version
    FROM orders
    UNION ALL
    SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderdate + INTERVAL '1' DAY, 1
    FROM orders WHERE o_orderkey % 50 = 0)
  SELECT CASE WHEN k % 97 = 0 THEN NULL ELSE k END AS order_id,
         CASE WHEN k % 101 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS customer_id,
         o_orderdate AS order_date,
         CAST(CASE WHEN k % 89 = 0 THEN -o_totalprice ELSE o_totalprice END AS DECIMAL(18,2)) AS total_amount,
         CASE WHEN k % 211 = 0 THEN 'lost' WHEN o_orderstatus = 'F' THEN ' Completed '
              WHEN o_orderstatus = 'O' THEN 'PENDING' WHEN k % 7 = 0 THEN 'refunded'
              ELSE 'cancelled' END AS status,
         o_orderdate AS created_at,
         CASE WHEN k % 77 = 0 AND version = 0 THEN NULL ELSE o_orderdate END AS updated_at,
         version
  FROM b)"""

RAW_CUSTOMERS = """
raw_customers AS (
  WITH c AS (
    SELECT c_custkey AS customer_id,
           CASE WHEN c_custkey % 53 = 0 THEN 'bad' WHEN c_custkey % 71 = 0 THEN NULL
                ELSE concat('  ', upper(replace(c_name, '#', '.')), '@Example.com ') END AS email,
           concat(' ', lower(c_mktsegment)) AS first_name,
           CASE WHEN c_custkey % 2 = 0 THEN 'o''brien-smith' ELSE 'mcDONALD jr' END AS last_name,
           concat(' ', lower(n_name)) AS country,
           TIMESTAMP '2023-01-01 00:00:00' + to_minutes(CAST(c_custkey AS BIGINT)) AS created_at,
           CASE WHEN c_custkey % 89 = 0 THEN NULL
                ELSE TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(c_custkey % 1000 AS BIGINT)) END AS updated_at,
           0 AS version
    FROM customer JOIN nation ON c_nationkey = n_nationkey)
  SELECT * FROM c
  UNION ALL
  SELECT customer_id, email, first_name, last_name, ' unknown ' AS country, created_at,
         TIMESTAMP '2024-01-20 00:00:00' + to_minutes(CAST(customer_id % 1000 AS BIGINT)) AS updated_at,
         1 AS version
  FROM c WHERE customer_id % 40 = 0
  UNION ALL
  SELECT -(s_suppkey + 1) AS customer_id,
         concat(lower(replace(s_name, '#', '.')), '@example.com') AS email,
         'prospect' AS first_name, 'van der berg' AS last_name,
         CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE n_name END AS country,
         TIMESTAMP '2023-06-01 00:00:00' + to_minutes(CAST(s_suppkey AS BIGINT)) AS created_at,
         TIMESTAMP '2024-01-15 00:00:00' + to_minutes(CAST(s_suppkey % 1000 AS BIGINT)) AS updated_at,
         0 AS version
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

RUN_LOG = """
run_log AS (
  WITH r AS (
    SELECT event_id AS run_id, event_type AS table_name,
           concat('s', CAST(user_id % 3 AS VARCHAR)) AS schema_name,
           '1.0.0' AS contract_version,
           CASE WHEN value < 10 THEN 'failed' WHEN value < 12 THEN 'warning'
                WHEN value < 13 THEN 'error' ELSE 'passed' END AS overall_status,
           10 + event_id % 5 AS total_checks, 8 + event_id % 3 AS passed_checks,
           value, ts AS executed_at
    FROM events)
  SELECT run_id, table_name, schema_name, contract_version, overall_status,
         total_checks, passed_checks,
         CASE WHEN overall_status = 'failed' THEN total_checks - passed_checks ELSE 0 END AS failed_checks,
         CASE WHEN overall_status = 'warning' THEN total_checks - passed_checks ELSE 0 END AS warning_checks,
         value / 100.0 AS duration_seconds,
         CAST(json_object(
           'run_id', run_id, 'table_name', table_name, 'schema_name', schema_name,
           'overall_status', overall_status, 'total_checks', total_checks,
           'passed_checks', passed_checks,
           'failed_checks', CASE WHEN overall_status = 'failed' THEN total_checks - passed_checks ELSE 0 END,
           'freshness_result', CASE WHEN run_id % 4 = 0 THEN NULL ELSE json_object(
               'status', CASE WHEN value < 50 THEN 'passed' ELSE 'failed' END,
               'actual_delay_minutes', value, 'max_delay_minutes', 60) END) AS VARCHAR) AS result_data,
         executed_at
  FROM r)"""

STG_ORDERS = """
stg_orders AS (
  SELECT order_id, customer_id, order_date, total_amount, status, created_at, updated_at FROM (
    SELECT order_id, customer_id, order_date, total_amount, lower(trim(status)) AS status,
           created_at, updated_at,
           row_number() OVER (PARTITION BY order_id
                              ORDER BY updated_at DESC NULLS FIRST, version DESC) AS rn
    FROM raw_orders WHERE order_id IS NOT NULL) WHERE rn = 1)"""

# PostgreSQL INITCAP: first letter of every alphanumeric run upper-cased
_INITCAP = ("array_to_string(list_transform(regexp_extract_all(lower(trim({x})), "
            "'([[:alnum:]]+|[^[:alnum:]]+)'), lambda w: concat(upper(w[1]), w[2:])), '')")

STG_CUSTOMERS = f"""
stg_customers AS (
  SELECT customer_id, email, first_name, last_name, country, created_at, updated_at FROM (
    SELECT customer_id, lower(trim(email)) AS email,
           {_INITCAP.format(x='first_name')} AS first_name,
           {_INITCAP.format(x='last_name')} AS last_name,
           upper(trim(country)) AS country, created_at, updated_at,
           row_number() OVER (PARTITION BY customer_id
                              ORDER BY updated_at DESC NULLS FIRST, version DESC) AS rn
    FROM raw_customers WHERE customer_id IS NOT NULL) WHERE rn = 1)"""

FCT_ORDER_SUMMARY = """
fct_order_summary AS (
  WITH oa AS (
    SELECT customer_id, count(order_id) AS total_orders,
           CAST(sum(total_amount) AS DOUBLE) AS total_revenue,
           CAST(sum(total_amount) AS DOUBLE) / count(total_amount) AS avg_order_value,
           min(order_date) AS first_order_date, max(order_date) AS last_order_date,
           sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) AS completed_orders,
           sum(CASE WHEN status = 'cancelled' THEN 1 ELSE 0 END) AS cancelled_orders,
           sum(CASE WHEN status = 'refunded' THEN 1 ELSE 0 END) AS refunded_orders
    FROM stg_orders GROUP BY customer_id)
  SELECT c.customer_id, c.email, c.first_name, c.last_name, c.country,
         CAST(coalesce(oa.total_orders, 0) AS BIGINT) AS total_orders,
         coalesce(oa.total_revenue, 0.0) AS total_revenue,
         coalesce(oa.avg_order_value, 0.0) AS avg_order_value,
         oa.first_order_date, oa.last_order_date,
         CAST(coalesce(oa.completed_orders, 0) AS BIGINT) AS completed_orders,
         CAST(coalesce(oa.cancelled_orders, 0) AS BIGINT) AS cancelled_orders,
         CAST(coalesce(oa.refunded_orders, 0) AS BIGINT) AS refunded_orders
  FROM stg_customers c LEFT JOIN oa ON c.customer_id = oa.customer_id)"""


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + body


def rule_row(check_type: str, column: str | None, violations_sql: str, actual_sql: str,
             table_cte: str, severity: str = "error", failed_sql: str | None = None,
             expected_sql: str = "NULL", message_sql: str | None = None) -> str:
    """One check row: check_type, column, status, severity, violations,
    actual_value, expected_value, message."""
    col = "NULL" if column is None else f"'{column}'"
    bad = "'warning'" if severity == "warning" else "'failed'"
    failed = failed_sql or "violations > 0"
    on = f"{check_type} on {column}" if column else check_type
    message = message_sql or f"concat('{on}: ', violations, ' violating rows')"
    return (f"SELECT '{check_type}' AS check_type, CAST({col} AS VARCHAR) AS \"column\", "
            f"CASE WHEN {failed} THEN {bad} ELSE 'passed' END AS status, '{severity}' AS severity, "
            f"CAST(violations AS BIGINT) AS violations, CAST(actual AS VARCHAR) AS actual_value, "
            f"CAST({expected_sql} AS VARCHAR) AS expected_value, {message} AS message "
            f"FROM (SELECT {violations_sql} AS violations, {actual_sql} AS actual FROM {table_cte}) x")


# ---- what the sample contracts ask for, check by check -----------------------
# (seq, name, type, column, severity, violations, expected value, message);
# written out, not taken from the planner. v is the violations.

def _schema(seq, column, kind, got=None):
    """A column that is there: its existence, and its type (``got`` where it differs)."""
    ok = got is None
    return [
        (seq, f"column_exists_{column}", "column_exists", column, "error", "0", None, f"'Column ''{column}'' exists'"),
        (seq + 1, f"column_type_{column}", "column_type", column, "error", "0" if ok else "1", f"'{kind}'",
         f"'Column ''{column}'' type matches contract'" if ok else f"'Column ''{column}'' type mismatch: expected {kind}, got {got}'"),
    ]


def _null_count(view, column):
    return f"(SELECT count(*) FROM {view} WHERE {column} IS NULL)"


def _repeated(view, columns, what="count(*)"):
    some = " AND ".join(f"{c} IS NOT NULL" for c in columns.split(", "))
    return f"(SELECT {what} FROM (SELECT count(*) AS n FROM {view} WHERE {some} GROUP BY {columns} HAVING count(*) > 1))"


def _unique_message(view, columns):
    return (f"concat('unique on {columns.replace(', ', ',')}: ', v, ' duplicated values in ', "
            f"{_repeated(view, columns, 'coalesce(sum(n), 0)')}, ' rows')")


def _delay(view, as_of):
    return f"((epoch_us(TIMESTAMP '{as_of}') - epoch_us((SELECT max(updated_at) FROM {view}))) / 60000000.0)"


def _freshness(view, seq, as_of, limit):
    delay = _delay(view, as_of)
    late = f"(CASE WHEN {delay} IS NULL OR {delay} > {limit} THEN 1 ELSE 0 END)"
    return (seq, "freshness_updated_at", "freshness", "updated_at", "error", late, f"'{limit}'",
            f"concat('Data is ', CAST(round({delay}, 1) AS DECIMAL(24, 1)), ' min old (SLA: {limit} min) - ', "
            f"CASE WHEN v = 1 THEN 'OUTSIDE' ELSE 'WITHIN' END, ' SLA')")


def _plain(check, column):
    on = f"{check} on {column}" if column else check
    return f"concat('{on}: ', v, ' violating rows')"


def orders_checks(as_of):
    t = "raw_orders"
    rows = f"(SELECT count(*) FROM {t})"
    orphans = f"FROM {t} o WHERE o.customer_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM raw_customers r WHERE r.customer_id = o.customer_id)"
    return [
        *_schema(1, "order_id", "integer"), *_schema(3, "customer_id", "integer"),
        *_schema(5, "order_date", "date", "timestamp_ntz"), *_schema(7, "total_amount", "decimal"),
        *_schema(9, "status", "string"), *_schema(11, "created_at", "timestamp"), *_schema(13, "updated_at", "timestamp"),
        (15, "column_exists_channel", "column_exists", "channel", "error", "1", None, "'Column ''channel'' defined in contract but not found in table'"),
        (17, "not_null_order_id", "not_null", "order_id", "error", _null_count(t, "order_id"), "'0'", _plain("not_null", "order_id")),
        (18, "unique_order_id", "unique", "order_id", "error", _repeated(t, "order_id"), "'0'", _unique_message(t, "order_id")),
        (19, "not_null_customer_id", "not_null", "customer_id", "error", _null_count(t, "customer_id"), "'0'", _plain("not_null", "customer_id")),
        (20, "not_null_total_amount", "not_null", "total_amount", "error", _null_count(t, "total_amount"), "'0'", _plain("not_null", "total_amount")),
        (21, "not_null_updated_at", "not_null", "updated_at", "error", _null_count(t, "updated_at"), "'0'", _plain("not_null", "updated_at")),
        (22, "row_count_min_22", "row_count_min", None, "error", f"greatest(1 - {rows}, 0)", "'1'", f"concat('row count ', {rows}, ' (minimum 1)')"),
        (23, "accepted_values_status", "accepted_values", "status", "warning",
         f"(SELECT count(*) FROM {t} WHERE status NOT IN ('cancelled', 'completed', 'pending', 'refunded'))",
         "'[\"cancelled\", \"completed\", \"pending\", \"refunded\"]'", _plain("accepted_values", "status")),
        (24, "max_value_total_amount", "max_value", "total_amount", "warning", f"(SELECT count(*) FROM {t} WHERE total_amount > 250000.5)", "'250000.5'", _plain("max_value", "total_amount")),
        (25, "min_value_total_amount", "min_value", "total_amount", "error", f"(SELECT count(*) FROM {t} WHERE total_amount < 0)", "'0'", _plain("min_value", "total_amount")),
        (26, "unique_order_id_version", "unique", "order_id,version", "error", _repeated(t, "order_id, version"), "'0'", _unique_message(t, "order_id, version")),
        (27, "referential_integrity_customer_id", "referential_integrity", "customer_id", "error", f"(SELECT count(*) {orphans})", "'customers.customer_id'",
         f"concat('customer_id -> customers.customer_id: ', v, ' orphan rows, ', (SELECT count(DISTINCT o.customer_id) {orphans}), ' keys')"),
        (28, "custom_sql", "custom_sql", None, "warning", f"(SELECT count(*) FROM {t} WHERE NOT (created_at <= updated_at))", "'created_at <= updated_at'", _plain("custom_sql", None)),
        (29, "row_count_min_29", "row_count_min", None, "warning", f"greatest(25 - {rows}, 0)", "'25'", f"concat('row count ', {rows}, ' (minimum 25)')"),
        _freshness(t, 30, as_of, 720),
    ]


def customers_checks(as_of):
    t = "raw_customers"
    rows = f"(SELECT count(*) FROM {t})"
    return [
        *_schema(1, "customer_id", "integer"), *_schema(3, "email", "string"), *_schema(5, "first_name", "string"), *_schema(7, "last_name", "string"),
        *_schema(9, "country", "string"), *_schema(11, "created_at", "timestamp"), *_schema(13, "updated_at", "timestamp"),
        *_schema(15, "version", "float", "int"),
        (17, "not_null_customer_id", "not_null", "customer_id", "error", _null_count(t, "customer_id"), "'0'", _plain("not_null", "customer_id")),
        (18, "unique_customer_id", "unique", "customer_id", "error", _repeated(t, "customer_id"), "'0'", _unique_message(t, "customer_id")),
        (19, "not_null_email", "not_null", "email", "error", _null_count(t, "email"), "'0'", _plain("not_null", "email")),
        (20, "not_null_country", "not_null", "country", "error", _null_count(t, "country"), "'0'", _plain("not_null", "country")),
        (21, "not_null_updated_at", "not_null", "updated_at", "error", _null_count(t, "updated_at"), "'0'", _plain("not_null", "updated_at")),
        (22, "row_count_min_22", "row_count_min", None, "error", f"greatest(1 - {rows}, 0)", "'1'", f"concat('row count ', {rows}, ' (minimum 1)')"),
        (23, "regex_match_email", "regex_match", "email", "warning", f"(SELECT count(*) FROM {t} WHERE email IS NOT NULL AND NOT regexp_matches(email, '^[^@ ]+@[^@ ]+[.][a-z]+$'))",
         "'^[^@ ]+@[^@ ]+[.][a-z]+$'", _plain("regex_match", "email")),
        (24, "unique_email", "unique", "email", "error", _repeated(t, "email"), "'0'", _unique_message(t, "email")),
        (25, "custom_sql", "custom_sql", None, "error", f"(SELECT count(*) FROM {t} WHERE created_at > updated_at)", "'0'", "concat('custom query returned ', v, ' failing rows')"),
        (26, "accepted_values_version", "accepted_values", "version", "error", f"(SELECT count(*) FROM {t} WHERE version NOT IN (0, 1))", "'[0, 1]'", _plain("accepted_values", "version")),
        (27, "min_value_version", "min_value", "version", "warning", f"(SELECT count(*) FROM {t} WHERE version < 0.5)", "'0.5'", _plain("min_value", "version")),
        (28, "max_value_created_at", "max_value", "created_at", "error", f"(SELECT count(*) FROM {t} WHERE created_at > TIMESTAMP '2023-12-31')", "'2023-12-31'", _plain("max_value", "created_at")),
        (29, "row_count_min_29", "row_count_min", None, "error", f"greatest(10 - {rows}, 0)", "'10'", f"concat('row count ', {rows}, ' (minimum 10)')"),
        _freshness(t, 30, as_of, 10080),
    ]


SAMPLE_CHECKS = {"orders": orders_checks, "customers": customers_checks}


def contract_oracle(table: str, as_of: str) -> str:
    """UNION ALL of one row per check of a sample contract, each computed by
    DuckDB: seq, check_name, check_type, column, status, severity, violations,
    expected_value, message."""
    out = []
    for seq, name, kind, column, severity, violations, expected, message in SAMPLE_CHECKS[table](as_of):
        col = "NULL" if column is None else f"'{column}'"
        bad = "'warning'" if severity == "warning" else "'failed'"
        out.append(f"SELECT {seq} AS seq, '{name}' AS check_name, '{kind}' AS check_type, CAST({col} AS VARCHAR) AS \"column\", "
                   f"CASE WHEN v > 0 THEN {bad} ELSE 'passed' END AS status, '{severity}' AS severity, v AS violations, "
                   f"CAST({expected or 'NULL'} AS VARCHAR) AS expected_value, {message} AS message "
                   f"FROM (SELECT CAST({violations} AS BIGINT) AS v) x")
    return "\nUNION ALL\n".join(out)


_TYPES = "['string','integer','float','boolean','date','timestamp','decimal','text','uuid']"
_TNAME = "CASE WHEN p_partkey % 13 = 0 THEN concat('T-', p_partkey) ELSE concat('t_', p_partkey) END"
_SNAME = "CASE WHEN p_size % 2 = 0 THEN 'public' ELSE 'sales' END"

REGISTRY = f"""
reg_top AS (
  SELECT p_partkey AS pk, {_TNAME} AS table_name, {_SNAME} AS schema_name,
         CASE WHEN p_partkey % 17 = 0 THEN '' ELSE p_brand END AS owner,
         CASE WHEN p_partkey % 19 = 0 THEN '1.0' ELSE concat('1.', p_size, '.0') END AS version,
         p_size % 3 <> 0 AS has_freshness,
         CASE WHEN p_partkey % 41 = 0 THEN 0 ELSE p_size * 60 END AS max_delay_minutes,
         60 AS check_interval_minutes, lower(p_type) AS tags,
         string_split(p_name, ' ')[1] AS w0, string_split(p_name, ' ')[2] AS w1, p_size, p_type
  FROM part),
reg_cols AS (
  SELECT table_name, schema_name, pk, 0 AS pos, 'id' AS name, 'integer' AS type, false AS nullable, true AS primary_key FROM reg_top
  UNION ALL SELECT table_name, schema_name, pk, 1, w0, {_TYPES}[pk % 9 + 1], true, false FROM reg_top
  UNION ALL SELECT table_name, schema_name, pk, 2, CASE WHEN pk % 29 = 0 THEN concat(w1, '-x') ELSE w1 END,
                   CASE WHEN pk % 23 = 0 THEN 'varchar2' ELSE {_TYPES}[(pk + 1) % 9 + 1] END,
                   pk % 2 = 0, false FROM reg_top
  UNION ALL SELECT table_name, schema_name, pk, 3, 'updated_at', 'timestamp', false, false FROM reg_top),
reg_rules AS (
  SELECT table_name, schema_name, pk, 0 AS pos, 'not_null' AS rule_type, 'id' AS "column",
         'error' AS severity, true AS has_value, '{{}}' AS params FROM reg_top
  UNION ALL SELECT table_name, schema_name, pk, 1, 'min_value', w0, 'warning', pk % 43 <> 0,
                   CASE WHEN pk % 43 = 0 THEN '{{}}' ELSE concat('{{"value":', p_size, '}}') END FROM reg_top
  UNION ALL SELECT table_name, schema_name, pk, 2, 'accepted_values', w1, 'error', true, concat('{{"values":["', lower(p_type), '","other"]}}') FROM reg_top
  UNION ALL SELECT table_name, schema_name, pk, 3,
                   CASE WHEN pk % 31 = 0 THEN 'not_a_rule' ELSE 'row_count_min' END, NULL,
                   CASE WHEN pk % 37 = 0 THEN 'fatal' ELSE 'warning' END, true, '{{"min_count":1}}' FROM reg_top)"""

_IDENT = "regexp_matches({x}, '^_*[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}_]*$')"

LINT_BODY = f"""
SELECT table_name, schema_name, 'table_name' AS path, 'invalid characters' AS error FROM reg_top
  WHERE length(table_name) > 0 AND NOT {_IDENT.format(x='table_name')}
UNION ALL SELECT table_name, schema_name, 'owner', 'required' FROM reg_top WHERE coalesce(length(owner), 0) = 0
UNION ALL SELECT table_name, schema_name, 'version', 'invalid version' FROM reg_top
  WHERE NOT regexp_matches(version, '^\\d+\\.\\d+\\.\\d+$')
UNION ALL SELECT table_name, schema_name, 'freshness.max_delay_minutes', 'out of range' FROM reg_top
  WHERE has_freshness AND NOT (max_delay_minutes BETWEEN 1 AND 10080)
UNION ALL SELECT table_name, schema_name, concat('columns[', pos, '].name'), 'invalid characters' FROM reg_cols
  WHERE NOT {_IDENT.format(x='name')}
UNION ALL SELECT table_name, schema_name, concat('columns[', pos, '].type'), concat('invalid column type ', type)
  FROM reg_cols WHERE type NOT IN ('string','integer','float','boolean','date','timestamp','decimal','text','uuid')
UNION ALL SELECT table_name, schema_name, concat('quality_rules[', pos, '].rule_type'), concat('invalid rule type ', rule_type)
  FROM reg_rules WHERE rule_type NOT IN ('not_null','unique','accepted_values','min_value','max_value',
                                          'regex_match','custom_sql','row_count_min','referential_integrity')
UNION ALL SELECT table_name, schema_name, concat('quality_rules[', pos, '].severity'), 'invalid severity'
  FROM reg_rules WHERE severity NOT IN ('error', 'warning')
UNION ALL SELECT table_name, schema_name, concat('quality_rules[', pos, '].parameters.value'), 'required'
  FROM reg_rules WHERE rule_type IN ('min_value', 'max_value') AND NOT has_value"""

PLAN_BODY = """
SELECT * FROM (
WITH plan_rows AS (
  SELECT table_name, schema_name, 0 AS grp, pos, 0 AS sub, 'column_exists' AS check_type, name AS "column",
         '{}' AS params, 'error' AS severity, 'schema' AS origin FROM reg_cols
  UNION ALL SELECT table_name, schema_name, 0, pos, 1, 'column_type', name, concat('{"type":"', type, '"}'), 'error', 'schema' FROM reg_cols
  UNION ALL SELECT table_name, schema_name, 1, pos, 0, 'not_null', name, '{}', 'error', 'implicit'
    FROM reg_cols WHERE NOT nullable
  UNION ALL SELECT table_name, schema_name, 1, pos, 1, 'unique', name, '{}', 'error', 'implicit'
    FROM reg_cols WHERE primary_key
  UNION ALL SELECT table_name, schema_name, 2, 0, 0, 'row_count_min', NULL, '{"min_count":1}', 'error', 'implicit'
    FROM reg_top
  UNION ALL SELECT table_name, schema_name, 3, pos, 0, rule_type, "column", params, severity, 'rule' FROM reg_rules
  UNION ALL SELECT table_name, schema_name, 4, 0, 0, 'freshness', 'updated_at', concat('{"max_delay_minutes":', max_delay_minutes, '}'),
                   'error', 'freshness' FROM reg_top WHERE has_freshness),
merged AS (
  SELECT table_name, schema_name, check_type, "column", params,
         min(grp * 1000000 + pos * 10 + sub) AS first_key,
         CASE WHEN count(*) FILTER (WHERE severity = 'error') > 0 THEN 'error' ELSE 'warning' END AS severity,
         string_agg(origin, '+' ORDER BY grp, pos, sub) AS origin
  FROM plan_rows GROUP BY table_name, schema_name, check_type, "column", params)
SELECT table_name, schema_name, check_type, "column", params, severity, origin, seq,
       concat(base, CASE WHEN count(*) OVER (PARTITION BY table_name, schema_name, base) > 1 THEN concat('_', seq) ELSE '' END) AS check_name
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY table_name, schema_name ORDER BY first_key) AS INTEGER) AS seq,
             lower(replace(concat_ws('_', check_type, "column"), ' ', '_')) AS base FROM merged))"""


CATALOG = f"""
inventory AS (
  SELECT {_SNAME} AS table_schema, lower({_TNAME}) AS table_name,
         CASE WHEN p_partkey % 5 = 0 THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type FROM part
  UNION ALL SELECT 'staging', concat('s_', CAST(s_suppkey AS VARCHAR)), 'BASE TABLE' FROM supplier
  UNION ALL SELECT 'pg_catalog', concat('pg_', lower(n_name)), 'BASE TABLE' FROM nation),
conform(contract_type, data_type) AS (VALUES ('string','string'), ('integer','bigint'), ('float','double'),
  ('boolean','boolean'), ('date','date'), ('timestamp','timestamp'), ('decimal','decimal'),
  ('text','string'), ('uuid','string')),
cat_cols AS (
  SELECT {_SNAME} AS table_schema, lower({_TNAME}) AS table_name, 1 AS ordinal_position,
         'id' AS column_name, 'bigint' AS data_type FROM part
  UNION ALL
  SELECT {_SNAME}, lower({_TNAME}), 2, string_split(p_name, ' ')[1],
         CASE WHEN p_partkey % 7 = 0 THEN
                CASE WHEN {_TYPES}[p_partkey % 9 + 1] = 'integer' THEN 'string' ELSE 'int' END
              ELSE (SELECT data_type FROM conform WHERE contract_type = {_TYPES}[p_partkey % 9 + 1]) END
  FROM part
  UNION ALL
  SELECT {_SNAME}, lower({_TNAME}), 3, string_split(p_name, ' ')[2],
         (SELECT data_type FROM conform WHERE contract_type = {_TYPES}[(p_partkey + 1) % 9 + 1])
  FROM part WHERE p_partkey % 11 <> 0
  UNION ALL
  SELECT {_SNAME}, lower({_TNAME}), 4, 'updated_at', 'timestamp' FROM part),
accepted(contract_type, data_type) AS (VALUES ('string','string'), ('string','varchar'), ('string','char'),
  ('text','string'), ('text','varchar'), ('integer','tinyint'), ('integer','smallint'), ('integer','int'),
  ('integer','bigint'), ('float','float'), ('float','double'), ('boolean','boolean'), ('date','date'),
  ('timestamp','timestamp'), ('timestamp','timestamp_ntz'), ('decimal','decimal'), ('uuid','string'))"""

SAMPLE_CONTRACT_COLUMNS = """
sample_cols(table_name, schema_name, pos, name, type) AS (VALUES
  ('orders','public',0,'order_id','integer'), ('orders','public',1,'customer_id','integer'),
  ('orders','public',2,'order_date','date'), ('orders','public',3,'total_amount','decimal'),
  ('orders','public',4,'status','string'), ('orders','public',5,'created_at','timestamp'),
  ('orders','public',6,'updated_at','timestamp'), ('orders','public',7,'channel','string'),
  ('customers','public',0,'customer_id','integer'), ('customers','public',1,'email','string'),
  ('customers','public',2,'first_name','string'), ('customers','public',3,'last_name','string'),
  ('customers','public',4,'country','string'), ('customers','public',5,'created_at','timestamp'),
  ('customers','public',6,'updated_at','timestamp'), ('customers','public',7,'version','float'))"""

SCHEMA_MANY_BODY = """
SELECT * FROM (
WITH exp AS (
  SELECT lower(table_name) AS table_name, schema_name, lower(name) AS "column", type AS contract_type FROM reg_cols
  UNION ALL SELECT table_name, schema_name, name, type FROM sample_cols),
present AS (SELECT DISTINCT e.table_name, e.schema_name FROM exp e
            WHERE EXISTS (SELECT 1 FROM inventory i WHERE i.table_schema = e.schema_name AND i.table_name = e.table_name)),
j AS (SELECT e.*, c.data_type FROM exp e JOIN present p ON e.table_name = p.table_name AND e.schema_name = p.schema_name
      LEFT JOIN cat_cols c ON c.table_schema = e.schema_name AND c.table_name = e.table_name AND c.column_name = e."column")
SELECT DISTINCT table_name, schema_name, 'table_exists' AS check_type, CAST(NULL AS VARCHAR) AS "column",
       'failed' AS status, CAST(NULL AS VARCHAR) AS expected_value, CAST(NULL AS VARCHAR) AS actual_value
FROM exp e WHERE NOT EXISTS (SELECT 1 FROM inventory i WHERE i.table_schema = e.schema_name AND i.table_name = e.table_name)
UNION ALL
SELECT table_name, schema_name, 'column_exists', "column",
       CASE WHEN data_type IS NOT NULL THEN 'passed' ELSE 'failed' END, NULL, NULL FROM j
UNION ALL
SELECT table_name, schema_name, 'column_type', "column",
       CASE WHEN EXISTS (SELECT 1 FROM accepted a WHERE a.contract_type = j.contract_type AND a.data_type = j.data_type)
            THEN 'passed' ELSE 'failed' END, contract_type, data_type FROM j WHERE data_type IS NOT NULL)"""


#: the columns of the given tables as the engine names their types, from the database's own catalog
GIVEN_COLUMNS = """
given_cols AS (
  SELECT 'main' AS table_schema, table_name, CAST(column_index AS INTEGER) AS ordinal_position, column_name,
         CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT' THEN 'float'
              WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DATE' THEN 'date' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' ELSE data_type END AS data_type
  FROM duckdb_columns() WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events',
                                             'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations'))"""
