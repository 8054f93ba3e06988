"""SQL models and model tests (staging, mart, data tests).

Each model is a function ``DataFrame -> DataFrame``; composing them gives
one Catalyst plan (SRC3: model references are function composition).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.functions.text import initcap_trim, lower_trim, minutes_between, upper_trim
from covenant.operators.latest import latest_per_key

ORDER_COLUMNS = ("order_id", "customer_id", "order_date", "total_amount", "status",
                 "created_at", "updated_at")
CUSTOMER_COLUMNS = ("customer_id", "email", "first_name", "last_name", "country",
                    "created_at", "updated_at")

# newest first; PostgreSQL sorts NULL first under DESC (Q11)
_NEWEST = [("updated_at", "desc", "first")]


def _required(df: DataFrame, tie_break: Sequence) -> Sequence:
    """The tie-break, all of whose columns have to be there: without them,
    which of two equally new versions stays would be left to chance."""
    missing = [n for t in tie_break if (n := t if isinstance(t, str) else t[0]) not in df.columns]
    if missing:
        raise ValueError(f"tie-break column(s) {', '.join(missing)} not found; name others, or () for none")
    return tie_break


def stg_orders(raw: DataFrame, tie_break: Sequence = (("version", "desc", "last"),)) -> DataFrame:
    """FIL1 + FN1 + WIN1: drop null keys, normalise status, newest per key."""
    src = (raw.filter(F.col("order_id").isNotNull())
              .withColumn("status", lower_trim("status")))
    return latest_per_key(src, ["order_id"], _NEWEST, _required(src, tie_break)).select(*ORDER_COLUMNS)


def stg_customers(raw: DataFrame, tie_break: Sequence = (("version", "desc", "last"),)) -> DataFrame:
    """FIL1 + FN1-3 + WIN1 for customers."""
    src = (raw.filter(F.col("customer_id").isNotNull())
              .withColumn("email", lower_trim("email"))
              .withColumn("first_name", initcap_trim("first_name"))
              .withColumn("last_name", initcap_trim("last_name"))
              .withColumn("country", upper_trim("country")))
    return latest_per_key(src, ["customer_id"], _NEWEST, _required(src, tie_break)).select(*CUSTOMER_COLUMNS)


def order_aggregates(orders: DataFrame) -> DataFrame:
    """AGG1 + AGG2 (FN5 conditional counts): per-customer summary; partial aggregation runs before the
    shuffle, so a customer with a third of all orders is one row per map
    task in the exchange. Money is summed as decimal (exact) and exposed as
    double; the average is that exact sum over the count."""
    st = F.col("status")
    amount = F.col("total_amount").cast("decimal(18,2)")
    return orders.groupBy("customer_id").agg(
        F.count("order_id").alias("total_orders"),
        F.sum(amount).alias("_rev"),
        F.count(amount).alias("_n_amount"),
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
        F.count_if(st == "completed").alias("completed_orders"),
        F.count_if(st == "cancelled").alias("cancelled_orders"),
        F.count_if(st == "refunded").alias("refunded_orders"),
    ).select(
        "customer_id", "total_orders",
        F.col("_rev").cast("double").alias("total_revenue"),
        (F.col("_rev").cast("double") / F.col("_n_amount")).alias("avg_order_value"),
        "first_order_date", "last_order_date",
        "completed_orders", "cancelled_orders", "refunded_orders",
    )


def fct_order_summary(stg_orders_df: DataFrame, stg_customers_df: DataFrame,
                      generated_at=None) -> DataFrame:
    """JOIN1 + FN4 + PRJ3: customers left-joined to their order aggregates.

    Both inputs arrive hash-partitioned on customer_id (the aggregate's
    exchange and the customer window's exchange), so the sort-merge join
    reuses them; AQE turns it into a broadcast join when one side is
    measured small."""
    oa = order_aggregates(stg_orders_df)
    c = stg_customers_df.select("customer_id", "email", "first_name", "last_name", "country")
    j = c.join(oa, "customer_id", "left")
    gen = F.current_timestamp() if generated_at is None else F.lit(generated_at)
    return j.select(
        "customer_id", "email", "first_name", "last_name", "country",
        F.coalesce("total_orders", F.lit(0)).cast("bigint").alias("total_orders"),
        F.coalesce("total_revenue", F.lit(0.0)).alias("total_revenue"),
        F.coalesce("avg_order_value", F.lit(0.0)).alias("avg_order_value"),
        "first_order_date", "last_order_date",
        F.coalesce("completed_orders", F.lit(0)).cast("bigint").alias("completed_orders"),
        F.coalesce("cancelled_orders", F.lit(0)).cast("bigint").alias("cancelled_orders"),
        F.coalesce("refunded_orders", F.lit(0)).cast("bigint").alias("refunded_orders"),
        gen.alias("generated_at"),
    )


def assert_total_positive(stg_orders_df: DataFrame) -> DataFrame:
    """FIL6: failing rows of the negative-total data test."""
    return (stg_orders_df.filter(F.col("total_amount") < 0)
            .select("order_id", F.col("total_amount").cast("double").alias("total_amount")))


def freshness_sla_breach(df: DataFrame, column: str = "updated_at",
                         max_delay_minutes: int = 120, as_of=None) -> DataFrame:
    """CHK9 + AGG3 + FIL7: one row when the model is stale or has no
    timestamps, none otherwise. ``as_of`` replaces CURRENT_TIMESTAMP."""
    now = F.current_timestamp() if as_of is None else F.to_timestamp_ntz(F.lit(str(as_of)))
    agg = df.agg(F.max(column).alias("last_updated"))
    out = agg.select(
        "last_updated",
        now.alias("check_time"),
        minutes_between(now, F.col("last_updated")).alias("delay_minutes"),
        F.lit(max_delay_minutes).alias("max_allowed_minutes"),
    )
    return out.filter((F.col("delay_minutes") > max_delay_minutes) | F.col("last_updated").isNull())
