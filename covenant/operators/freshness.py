"""Freshness SLA checks (CHK3, CHK4, FIL9, CHK9).

One MAX per table (partial aggregation per task, one-row merge), compared
with ``as_of``. Many tables are one DataFrame: the per-table one-row
aggregates are unioned, so a single action checks them all.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covenant.functions.literals import local_rows
from covenant.functions.text import minutes_between
from covenant.operators.checks import _field, _valid_ident, as_of_col, time_column_error
from covenant.plans import vocabulary as V
from covenant.plans.contracts import normalise
from covenant.session import ensure_checkpoint_dir

FRESHNESS_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("schema_name", T.StringType()),
    T.StructField("timestamp_column", T.StringType()),
    T.StructField("last_updated_at", T.TimestampNTZType()),
    T.StructField("max_delay_minutes", T.LongType()),
    T.StructField("actual_delay_minutes", T.DoubleType()),
    T.StructField("status", T.StringType()),
    T.StructField("is_within_sla", T.BooleanType()),
    T.StructField("message", T.StringType()),
    T.StructField("checked_at", T.TimestampNTZType()),
])
FRESHNESS_COLUMNS = [f.name for f in FRESHNESS_SCHEMA.fields]


def _static(spark, table, schema, column, max_delay, status, message, as_of) -> DataFrame:
    df = local_rows(
        spark, [(table, schema, column, None, max_delay, None, status, False, message)],
        "table_name string, schema_name string, timestamp_column string, last_updated_at timestamp_ntz, "
        "max_delay_minutes bigint, actual_delay_minutes double, status string, is_within_sla boolean, "
        "message string")
    return df.withColumn("checked_at", as_of_col(as_of).cast("timestamp_ntz")).select(*FRESHNESS_COLUMNS)


def freshness_result(spark: SparkSession, df: DataFrame | None, contract: dict,
                     as_of=None, last_row: DataFrame | None = None) -> DataFrame:
    """CHK3 for one table: skipped (no SLA), error (bad column name, missing
    table or column), failed (no rows / null max, or delay > max), passed.
    The status and ``is_within_sla`` both use the unrounded delay (Q6); the
    message (FN10) shows it rounded to one place (FN8). ``last_row`` gives the
    latest time (one row, ``last_updated_at``) where it is known without a scan."""
    c = normalise(contract)
    table, schema = c["table_name"], c["schema_name"]
    f = c.get("freshness")
    if not f:
        return _static(spark, table, schema, "", 0, "skipped", V.MSG_NO_FRESHNESS_SLA, as_of)
    col, mx = f.get("timestamp_column") or "", int(f["max_delay_minutes"])
    if not _valid_ident(col):
        return _static(spark, table, schema, col, mx, "error", V.MSG_INVALID_TS_COLUMN.format(column=col), as_of)
    if df is None:
        return _static(spark, table, schema, col, mx, "error", V.MSG_TABLE_MISSING.format(schema=schema, table=table), as_of)
    if _field(df, col) is None:
        return _static(spark, table, schema, col, mx, "error",
                       V.MSG_FRESHNESS_QUERY_FAILED.format(error=f"column {col} not found"), as_of)
    if error := time_column_error(df, col):
        return _static(spark, table, schema, col, mx, "error", error, as_of)
    now = as_of_col(as_of)
    last = F.col("last_updated_at")
    delay = minutes_between(now, last)
    within = last.isNotNull() & (delay <= F.lit(mx))
    agg = df.agg(F.max(F.col(col)).cast("timestamp_ntz").alias("last_updated_at")) if last_row is None else last_row
    return agg.select(
        F.lit(table).alias("table_name"), F.lit(schema).alias("schema_name"),
        F.lit(col).alias("timestamp_column"), last.alias("last_updated_at"),
        F.lit(mx).cast("bigint").alias("max_delay_minutes"),
        delay.alias("actual_delay_minutes"),
        F.when(within, "passed").otherwise("failed").alias("status"),
        within.alias("is_within_sla"),
        F.when(last.isNull(), F.lit(V.MSG_NO_DATA.format(schema=schema, table=table)))
         .otherwise(F.format_string(
             V.MSG_FRESHNESS.format(max_delay=mx),
             F.round(delay, 1).cast("decimal(24,1)").cast("string"),
             F.when(within, "WITHIN").otherwise("OUTSIDE"))).alias("message"),
        now.cast("timestamp_ntz").alias("checked_at"),
    )


#: tables in one plan; more are checked group by group
TABLES_PER_PLAN = 50


def freshness_many(spark: SparkSession, items: Iterable[tuple[dict, DataFrame | None]],
                   as_of=None) -> DataFrame:
    """CHK4: every table's freshness in one DataFrame. Groups of tables are one
    plan each; beyond one group the results are written to the shared
    folder and read back, so a registry of any size can be planned."""
    path, group, n = f"{ensure_checkpoint_dir(spark).rstrip('/')}/freshness-{uuid.uuid4().hex}", [], 0
    for c, df in items:
        if len(group) == TABLES_PER_PLAN:
            reduce(DataFrame.unionByName, group).write.parquet(f"{path}/part={n}")
            group, n = [], n + 1
        group.append(freshness_result(spark, df, c, as_of))
    if not group:
        return local_rows(spark, [], FRESHNESS_SCHEMA)
    last = reduce(DataFrame.unionByName, group)
    if not n:
        return last
    last.write.parquet(f"{path}/part={n}")
    return spark.read.parquet(path).drop("part")


def stale_tables(results: DataFrame) -> DataFrame:
    """FIL9: only FAILED (not ERROR or SKIPPED) tables."""
    return results.filter(F.col("status") == "failed")


def freshness_alerts(results: DataFrame) -> DataFrame:
    """GOV10: one critical alert row per failed freshness result."""
    return stale_tables(results).select(
        F.lit(V.ALERT_FRESHNESS).alias("alert_type"),
        F.lit(V.SEVERITY_CRITICAL).alias("severity"),
        F.concat_ws(".", "schema_name", "table_name").alias("table"),
        "timestamp_column", "actual_delay_minutes", "max_delay_minutes", "message",
        F.col("checked_at").alias("timestamp"))
