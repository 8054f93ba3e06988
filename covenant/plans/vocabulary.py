"""Fixed values shared with the reference application.

These strings and numbers must equal the reference's for results (messages,
alert rows, report defaults) to read the same; they are kept together here
and used by the operators.
"""

# ---- fixed values: check and freshness messages ----------------------------
MSG_COLUMN_EXISTS = "Column '{column}' exists"
MSG_COLUMN_MISSING = "Column '{column}' defined in contract but not found in table"
MSG_TYPE_MATCHES = "Column '{column}' type matches contract"
MSG_TYPE_MISMATCH = "Column '{column}' type mismatch: expected {expected}, got {actual}"
MSG_TABLE_MISSING = "Table {schema}.{table} does not exist"
MSG_NO_FRESHNESS_SLA = "No freshness SLA defined in contract"
MSG_INVALID_TS_COLUMN = "Invalid timestamp column name: '{column}'"
MSG_NO_DATA = "Table {schema}.{table} has no data or null timestamps"
MSG_FRESHNESS = "Data is %s min old (SLA: {max_delay} min) - %s SLA"   # delay, WITHIN/OUTSIDE
MSG_FRESHNESS_QUERY_FAILED = "Freshness query failed: {error}"

# ---- fixed values: alerts ----------------------------------------------------
ALERT_QUALITY = "quality_check_failure"
ALERT_FRESHNESS = "freshness_sla_breach"
SEVERITY_CRITICAL = "critical"
SEVERITY_WARNING = "warning"
CRITICAL_FAILED_CHECKS = 3          # more failed checks than this -> critical
ALERT_FAILED_NAMES = 10             # failed check names listed per alert
ALERT_STATUSES = ("failed", "error")

# ---- fixed values: reports and metrics ---------------------------------------
RECENT_RESULTS_LIMIT = 50
TABLE_HISTORY_LIMIT = 30
TREND_DAYS = 30
SYSTEM_SCHEMAS = ("pg_catalog", "information_schema")
BASE_TABLE = "BASE TABLE"
EMPTY_SLA_COMPLIANCE_PCT = 100.0    # no table with an SLA -> 100 %
