"""Result-log reports and governance metrics (WIN2, TOP1-4, AGG5/6/9/10,
FIL2-5, GOV4-10, GOV12).

The log is an ordinary DataFrame (one row per run). "Latest run per table"
is ``latest_per_key`` (row_number with partial group limits), so a table
with millions of runs ships one row per input partition to the exchange.
Every top-k report is a ``TakeOrderedAndProject`` (per-task top-k, then a
merge of k rows per task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covenant.operators.checks import as_of_col
from covenant.operators.latest import latest_per_key
from covenant.plans import vocabulary as V

LOG_KEYS = ["table_name", "schema_name"]
NEWEST = [("executed_at", "desc", "last")]
TIE = [("run_id", "desc", "last")]

SUMMARY_COLUMNS = ["run_id", "table_name", "schema_name", "contract_version", "overall_status",
                   "total_checks", "passed_checks", "failed_checks", "warning_checks",
                   "duration_seconds", "executed_at"]


def latest_per_table(log: DataFrame) -> DataFrame:
    """WIN2 / GOV6: most recent run of every (table, schema)."""
    return latest_per_key(log, LOG_KEYS, NEWEST, TIE)


def recent_results(log: DataFrame, limit: int = V.RECENT_RESULTS_LIMIT, table_name: str | None = None) -> DataFrame:
    """TOP1: newest runs first, optional table filter (pushed to the scan)."""
    if table_name is not None:
        log = log.filter(F.col("table_name") == table_name)
    return (log.select(*SUMMARY_COLUMNS)
               .orderBy(F.col("executed_at").desc(), F.col("run_id").desc()).limit(limit))


def table_history(log: DataFrame, table_name: str, limit: int = V.TABLE_HISTORY_LIMIT) -> DataFrame:
    """TOP2: one table's runs, newest first (schema not filtered, Q10)."""
    return (log.filter(F.col("table_name") == table_name)
               .select("run_id", "overall_status", "total_checks", "passed_checks",
                       "failed_checks", "duration_seconds", "executed_at")
               .orderBy(F.col("executed_at").desc(), F.col("run_id").desc()).limit(limit))


def run_detail(log: DataFrame, run_id) -> DataFrame:
    """GOV8 / FIL2 (FN9 JSON decode, FN16 casts): the stored payload of one run, decoded."""
    p = F.col("result_data")
    return log.filter(F.col("run_id") == F.lit(run_id)).select(
        "run_id", "table_name", "schema_name", "executed_at",
        F.get_json_object(p, "$.overall_status").alias("overall_status"),
        F.get_json_object(p, "$.total_checks").cast("bigint").alias("total_checks"),
        F.get_json_object(p, "$.freshness_result.status").alias("freshness_status"),
        F.get_json_object(p, "$.freshness_result.actual_delay_minutes").cast("double")
         .alias("actual_delay_minutes"))


def last_failure_per_table(log: DataFrame) -> DataFrame:
    """GOV7, code reading (Q7): filter to failed, then latest per table: the
    last failure of every table that ever failed."""
    failed = log.filter(F.col("overall_status") == "failed")
    return latest_per_key(failed, LOG_KEYS, NEWEST, TIE).select(
        "run_id", "table_name", "schema_name", "contract_version", "overall_status",
        "failed_checks", "executed_at")


def currently_failing(log: DataFrame) -> DataFrame:
    """GOV7, documented reading (Q7): tables whose most recent run failed."""
    return latest_per_table(log).filter(F.col("overall_status") == "failed").select(
        "run_id", "table_name", "schema_name", "contract_version", "overall_status",
        "failed_checks", "executed_at")


def summary_report(log: DataFrame) -> DataFrame:
    """GOV6 + AGG8: report counts over the latest run per table."""
    st = F.col("overall_status")
    return latest_per_table(log).agg(
        F.count(F.lit(1)).alias("total_tables"),
        F.count_if(st == "passed").alias("tables_passed"),
        F.count_if(st == "failed").alias("tables_failed"))


def check_totals_latest(log: DataFrame) -> DataFrame:
    """AGG5: total and passed checks over the latest run per table, 0 when
    the log is empty."""
    return latest_per_table(log).agg(
        F.coalesce(F.sum("total_checks"), F.lit(0)).cast("bigint").alias("total_checks_run"),
        F.coalesce(F.sum("passed_checks"), F.lit(0)).cast("bigint").alias("total_checks_passed"))


def freshness_compliance(log: DataFrame) -> DataFrame:
    """AGG6 + FIL5, code reading (Q8): latest run among payloads whose text
    contains 'freshness' (every payload, as the key is always written);
    within SLA = the run's overall status is passed."""
    rows = log.filter(F.col("result_data").contains("freshness"))
    latest = latest_per_key(rows, LOG_KEYS, NEWEST, TIE)
    return latest.agg(
        F.count_if(F.col("overall_status") == "passed").cast("bigint").alias("tables_within_sla"),
        F.count(F.lit(1)).alias("tables_with_freshness_sla"))


def sla_compliance_by_freshness(log: DataFrame) -> DataFrame:
    """AGG6, documented reading (Q8): latest run among runs that carry a
    freshness result; within SLA = that result passed."""
    fr = F.get_json_object("result_data", "$.freshness_result.status")
    rows = log.withColumn("__fs", fr).filter(F.col("__fs").isNotNull())
    latest = latest_per_key(rows, LOG_KEYS, NEWEST, TIE)
    return latest.agg(
        F.count_if(F.col("__fs") == "passed").cast("bigint").alias("tables_within_sla"),
        F.count(F.lit(1)).alias("tables_with_freshness_sla"))


def _pct(n: Column, d: Column, empty: float) -> Column:
    """AGG9 percentage rounded half-up to 2 places in exact integer
    arithmetic (hundredths = floor((2*n*10000 + d) / (2*d))), so the result
    does not depend on binary rounding (Q14); the given default when the
    denominator is 0 (ANSI-safe: the division only runs when d > 0)."""
    n, d = n.cast("bigint"), d.cast("bigint")
    hundredths = F.when(d > 0, (n * 20000 + d).cast("long")).otherwise(F.lit(None))
    q = F.when(d > 0, F.floor((hundredths - (hundredths % (d * 2))) / (d * 2)))
    return F.when(d > 0, q / F.lit(100.0)).otherwise(F.lit(empty))


def metrics(counts: DataFrame) -> DataFrame:
    """AGG9: percentages from the six counts (defaults 0, 0, 100)."""
    return counts.select(
        _pct(F.col("tables_with_contracts"), F.col("total_tables"), 0.0).alias("contract_coverage_pct"),
        _pct(F.col("total_checks_passed"), F.col("total_checks_run"), 0.0).alias("quality_pass_rate_pct"),
        _pct(F.col("tables_within_sla"), F.col("tables_with_freshness_sla"),
             V.EMPTY_SLA_COMPLIANCE_PCT).alias("sla_compliance_pct"),
        *[F.col(c).cast("bigint").alias(c) for c in (
            "total_tables", "tables_with_contracts", "total_checks_run", "total_checks_passed",
            "tables_within_sla", "tables_with_freshness_sla")],
        *([F.col("captured_at")] if "captured_at" in counts.columns else []),
    )


SYSTEM_SCHEMAS = V.SYSTEM_SCHEMAS


def count_user_tables(inventory: DataFrame) -> DataFrame:
    """SRC6 + FIL8: base tables outside the system schemas."""
    return inventory.filter(~F.col("table_schema").isin(*SYSTEM_SCHEMAS)
                            & (F.col("table_type") == V.BASE_TABLE)).agg(
        F.count(F.lit(1)).alias("total_tables"))


def count_contracts(contracts: DataFrame) -> DataFrame:
    """AGG4: number of registered contracts (one-row aggregate)."""
    return contracts.agg(F.count(F.lit(1)).alias("tables_with_contracts"))


def governance_snapshot(inventory: DataFrame, contracts: DataFrame, log: DataFrame,
                        as_of=None) -> DataFrame:
    """GOV4: the four one-row aggregates joined into one snapshot row.
    Each side is a single row, so the joins are on one row each."""
    total = count_user_tables(inventory)
    covered = count_contracts(contracts)
    checks = check_totals_latest(log)
    fresh = freshness_compliance(log)
    counts = merge_single_rows([total, covered, checks, fresh]) \
        .withColumn("captured_at", as_of_col(as_of).cast("timestamp_ntz"))
    return metrics(counts)


def merge_single_rows(parts: list[DataFrame]) -> DataFrame:
    """Side-by-side merge of one-row aggregates without a join: each part is
    widened with NULLs for the other columns, unioned, and folded by one
    global aggregate (each column has exactly one non-null value)."""
    names = [c for p in parts for c in p.columns]
    types = {f.name: f.dataType for p in parts for f in p.schema.fields}
    wide = None
    for p in parts:
        w = p.select(*[F.col(c) if c in p.columns else F.lit(None).cast(types[c]).alias(c)
                       for c in names])
        wide = w if wide is None else wide.unionByName(w)
    return wide.agg(*[F.max(c).alias(c) for c in names])


def daily_snapshots(log: DataFrame, total_tables: DataFrame) -> DataFrame:
    """Metric history (the snapshot table) derived from the log: one
    snapshot per day at the end of that day, over that day's runs.

    Two-stage aggregate instead of COUNT(DISTINCT): first per (day, table)
    — partial aggregation collapses every table's runs map-side, so a table
    with a third of all runs is one row per task — then per day over those
    few rows. No Expand, no row multiplication before the shuffle.
    ``total_tables`` is the one-row count of the inventory."""
    fs = F.get_json_object("result_data", "$.freshness_result.status")
    per_table = (log.withColumn("__day", F.to_date("executed_at"))
                 .groupBy("__day", "schema_name", "table_name").agg(
                     F.sum("total_checks").alias("c_run"),
                     F.sum("passed_checks").alias("c_passed"),
                     F.max(fs.isNotNull().cast("int")).alias("has_fresh"),
                     F.max((fs == "passed").cast("int")).alias("fresh_ok")))
    per_day = per_table.groupBy("__day").agg(
        F.count(F.lit(1)).alias("tables_with_contracts"),
        F.sum("c_run").cast("bigint").alias("total_checks_run"),
        F.sum("c_passed").cast("bigint").alias("total_checks_passed"),
        F.count_if(F.col("has_fresh") == 1).alias("tables_with_freshness_sla"),
        F.count_if(F.col("fresh_ok") == 1).alias("tables_within_sla"))
    per_day = per_day.withColumn(
        "captured_at", (F.col("__day").cast("timestamp_ntz") + F.expr("INTERVAL '23:59:59' HOUR TO SECOND")))
    one = total_tables.select("total_tables", F.lit(1).alias("__one"))
    return metrics(per_day.withColumn("__one", F.lit(1)).join(one, "__one").drop("__day", "__one"))


def trend(snapshots: DataFrame, days: int = V.TREND_DAYS, as_of=None) -> DataFrame:
    """GOV5 + FIL4 + TOP4: snapshots of the last ``days`` days, oldest first.
    When the snapshot table is partitioned by ``capture_date`` (as the
    workspace writes it), the same bound is applied to the partition column
    so older partitions are pruned, not read."""
    start = as_of_col(as_of) - F.make_dt_interval(days=F.lit(days))
    out = snapshots.filter(F.col("captured_at") >= start)
    if "capture_date" in snapshots.columns:
        out = out.filter(F.col("capture_date") >= F.to_date(start))
    return out.orderBy("captured_at")


def trend_bounds(snapshots: DataFrame, days: int = V.TREND_DAYS, as_of=None) -> DataFrame:
    """AGG10: first and last capture time of the trend window."""
    t = trend(snapshots, days, as_of)
    return t.agg(F.min("captured_at").alias("period_start"),
                 F.max("captured_at").alias("period_end"),
                 F.count(F.lit(1)).alias("snapshots"))


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """TOP3: the most recent snapshot."""
    return snapshots.orderBy(F.col("captured_at").desc()).limit(1)


def quality_alerts(runs: DataFrame, failed_names: DataFrame | None = None) -> DataFrame:
    """GOV9: alert rows for failed and error runs (Q22); critical when more
    than 3 checks failed, else warning."""
    a = runs.filter(F.col("overall_status").isin(*V.ALERT_STATUSES))
    if failed_names is not None:
        a = a.join(failed_names, [k for k in ("run_id", "table_name", "schema_name")
                                  if k in failed_names.columns], "left")
    cols = [
        F.lit(V.ALERT_QUALITY).alias("alert_type"),
        F.when(F.col("failed_checks") > V.CRITICAL_FAILED_CHECKS, V.SEVERITY_CRITICAL)
         .otherwise(V.SEVERITY_WARNING).alias("severity"),
        F.concat_ws(".", "schema_name", "table_name").alias("table"),
        F.col("overall_status").alias("status"),
        "total_checks", "failed_checks",
    ]
    if "run_id" in a.columns:
        cols.append("run_id")
    if "contract_version" in a.columns:
        cols.append("contract_version")
    if "duration_seconds" in a.columns:
        cols.append("duration_seconds")
    if "executed_at" in a.columns:
        cols.append(F.col("executed_at").alias("timestamp"))
    if failed_names is not None or "failed_check_names" in a.columns:
        cols.append(F.coalesce("failed_check_names", F.array().cast("array<string>"))
                    .alias("failed_check_names"))
    return a.select(*cols)


def log_freshness_alerts(log: DataFrame) -> DataFrame:
    """GOV10 over the log: runs whose stored freshness result failed."""
    p = F.col("result_data")
    return log.filter(F.get_json_object(p, "$.freshness_result.status") == "failed").select(
        F.lit(V.ALERT_FRESHNESS).alias("alert_type"), F.lit(V.SEVERITY_CRITICAL).alias("severity"),
        F.concat_ws(".", "schema_name", "table_name").alias("table"), "run_id",
        F.get_json_object(p, "$.freshness_result.actual_delay_minutes").cast("double")
         .alias("actual_delay_minutes"),
        F.get_json_object(p, "$.freshness_result.max_delay_minutes").cast("bigint")
         .alias("max_delay_minutes"),
        F.col("executed_at").alias("timestamp"))


def run_summaries(log: DataFrame, digits: int | None = 3) -> DataFrame:
    """GOV12 / PRJ2 (FN8): run-all summary rows, duration rounded half up to 3
    places in decimal arithmetic, so that ...5 does not depend on binary
    rounding (``digits=None`` keeps the exact value)."""
    d = F.col("duration_seconds")
    return log.select("table_name", "schema_name", "overall_status", "total_checks",
                      "passed_checks", "failed_checks",
                      (d if digits is None else F.round(d.cast("decimal(18,6)"), digits).cast("double")).alias("duration_seconds"))


def payload_checks(log: DataFrame) -> DataFrame:
    """GOV8 over many runs: the check rows stored in each run's JSON payload
    (SINK3 round trip), decoded with a declared schema, one row per check."""
    from pyspark.sql import types as T
    check = T.StructType([T.StructField(n, t) for n, t in (
        ("seq", T.IntegerType()), ("check_name", T.StringType()), ("check_type", T.StringType()),
        ("column", T.StringType()), ("status", T.StringType()), ("severity", T.StringType()),
        ("violations", T.LongType()))])
    payload = T.StructType([T.StructField("checks", T.ArrayType(check))])
    return (log.select("run_id", "table_name", "schema_name",
                       F.explode(F.from_json("result_data", payload)["checks"]).alias("c"))
               .select("run_id", "table_name", "schema_name", "c.*"))
