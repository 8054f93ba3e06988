"""Governed tables derived from the driver's tables.

The base tables are clean (no nulls, no duplicate keys, no orphans), so the
governed tables inject violations with deterministic rules on the keys.
Every row of the base tables is kept: the rules only rewrite values or add
rows (second versions, prospects), so the work grows with the input.

Each function is pure DataFrame code; the matching SQL for the DuckDB
oracle lives in ``covenant.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covenant.sources.tables import read_table


def _ts(text: str):
    return F.to_timestamp_ntz(F.lit(text))


def _plus_minutes(ts, minutes):
    return ts + F.make_dt_interval(mins=minutes.cast("int"))


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the contract's shape: every order once (version 0) and a
    second, later version for every 50th order key."""
    o = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), "o_custkey", "o_totalprice",
        "o_orderstatus", "o_orderdate")
    # one scan: every 50th key is emitted twice (version 0 and 1)
    versions = F.when(F.col("k") % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    b = (o.withColumn("version", F.explode(versions))
          .withColumn("o_orderdate", F.col("o_orderdate")
                      + F.make_dt_interval(days=F.col("version"))))
    k = F.col("k")
    status = (F.when(k % 211 == 0, "lost")
              .when(F.col("o_orderstatus") == "F", " Completed ")
              .when(F.col("o_orderstatus") == "O", "PENDING")
              .when(k % 7 == 0, "refunded")
              .otherwise("cancelled"))
    return b.select(
        F.when(k % 97 == 0, F.lit(None)).otherwise(k).alias("order_id"),
        F.when(k % 101 == 0, F.col("o_custkey") + 1000000)
         .otherwise(F.col("o_custkey")).alias("customer_id"),
        F.col("o_orderdate").alias("order_date"),
        F.when(k % 89 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
         .cast("decimal(18,2)").alias("total_amount"),
        status.alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.when((k % 77 == 0) & (F.col("version") == 0), F.lit(None))
         .otherwise(F.col("o_orderdate")).alias("updated_at"),
        F.col("version"),
    )


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in the contract's shape: every customer (messy text),
    a second version for every 40th key (same e-mail), and one prospect
    per supplier (a customer without orders)."""
    c = read_table(spark, sf_dir, "customer")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    ck = F.col("c_custkey")
    # one scan: every 40th key is emitted twice (version 0 and 1)
    versions = F.when(ck % 40 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    v = F.col("version")
    cust = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")) \
        .withColumn("version", F.explode(versions)).select(
        ck.alias("customer_id"),
        F.when(ck % 53 == 0, F.lit("bad"))
         .when(ck % 71 == 0, F.lit(None))
         .otherwise(F.concat(F.lit("  "), F.upper(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))),
                             F.lit("@Example.com "))).alias("email"),
        F.concat(F.lit(" "), F.lower("c_mktsegment")).alias("first_name"),
        F.when(ck % 2 == 0, F.lit("o'brien-smith")).otherwise(F.lit("mcDONALD jr")).alias("last_name"),
        F.when(v == 1, F.lit(" unknown ")).otherwise(F.concat(F.lit(" "), F.lower("n_name"))).alias("country"),
        _plus_minutes(_ts("2023-01-01 00:00:00"), ck).alias("created_at"),
        F.when(v == 1, _plus_minutes(_ts("2024-01-20 00:00:00"), ck % 1000))
         .when(ck % 89 == 0, F.lit(None).cast("timestamp_ntz"))
         .otherwise(_plus_minutes(_ts("2024-01-01 00:00:00"), ck % 1000)).alias("updated_at"),
        v.alias("version"),
    )
    s = read_table(spark, sf_dir, "supplier")
    sk = F.col("s_suppkey")
    prospects = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        (-(sk + 1)).alias("customer_id"),
        F.concat(F.lower(F.replace(F.col("s_name"), F.lit("#"), F.lit("."))),
                 F.lit("@example.com")).alias("email"),
        F.lit("prospect").alias("first_name"),
        F.lit("van der berg").alias("last_name"),
        F.when(sk % 5 == 0, F.lit(None)).otherwise(F.col("n_name")).alias("country"),
        _plus_minutes(_ts("2023-06-01 00:00:00"), sk).alias("created_at"),
        _plus_minutes(_ts("2024-01-15 00:00:00"), sk % 1000).alias("updated_at"),
        F.lit(0).alias("version"),
    )
    return cust.unionByName(prospects)


def status_by_value():
    return (F.when(F.col("value") < 10, "failed")
            .when(F.col("value") < 12, "warning")
            .when(F.col("value") < 13, "error")
            .otherwise("passed"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result log (one row per run of one table) derived from events.

    ``result_data`` is the JSON payload; ``freshness_result`` is null in
    every fourth run (table without a freshness SLA) and is always
    serialised, also when null, as the reference does.
    """
    e = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    eid = F.col("event_id")
    r = e.select(
        eid.alias("run_id"),
        F.col("event_type").alias("table_name"),
        F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("schema_name"),
        F.lit("1.0.0").alias("contract_version"),
        status_by_value().alias("overall_status"),
        (10 + eid % 5).alias("total_checks"),
        (8 + eid % 3).alias("passed_checks"),
        F.col("value"),
        F.col("ts").alias("executed_at"),
    )
    diff = F.col("total_checks") - F.col("passed_checks")
    r = r.select(
        "*",
        F.when(F.col("overall_status") == "failed", diff).otherwise(0).alias("failed_checks"),
        F.when(F.col("overall_status") == "warning", diff).otherwise(0).alias("warning_checks"),
        (F.col("value") / 100.0).alias("duration_seconds"),
    )
    fresh = F.when(F.col("run_id") % 4 == 0, F.lit(None)).otherwise(
        F.struct(
            F.when(F.col("value") < 50, "passed").otherwise("failed").alias("status"),
            F.col("value").alias("actual_delay_minutes"),
            F.lit(60).alias("max_delay_minutes"),
        ))
    payload = F.to_json(
        F.struct(
            F.col("run_id"), F.col("table_name"), F.col("schema_name"),
            F.col("overall_status"), F.col("total_checks"), F.col("passed_checks"),
            F.col("failed_checks"), fresh.alias("freshness_result"),
        ),
        {"ignoreNullFields": "false"},
    )
    return r.select(
        "run_id", "table_name", "schema_name", "contract_version", "overall_status",
        "total_checks", "passed_checks", "failed_checks", "warning_checks",
        "duration_seconds", payload.alias("result_data"), "executed_at",
    )
