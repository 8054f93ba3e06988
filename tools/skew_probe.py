"""Skew probe: run the key-based checks on lineitem with one order key
holding a third of all rows, with Spark's event log in a scratch folder,
and report the most shuffle records any single task read.

usage: python tools/skew_probe.py [sf_dir]   -> one JSON line
"""
from __future__ import annotations

import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    logdir = tempfile.mkdtemp(prefix="covenant-eventlog-")
    spark = (SparkSession.builder.master("local[8]").appName("skew-probe")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", logdir)
             .config("spark.eventLog.compress", "false")
             .config("spark.eventLog.rolling.enabled", "false")
             .config("spark.sql.shuffle.partitions", "16")
             .config("spark.sql.adaptive.enabled", "false")  # keep every exchange visible
             .config("spark.sql.autoBroadcastJoinThreshold", "-1")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from covenant.operators.checks import evaluate_rules, orphan_keys
    from covenant.operators.latest import latest_per_key
    from covenant.sources.tables import TableSet

    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    hot = li.withColumn("l_orderkey", F.when(F.col("l_linenumber") % 3 == 1, F.lit(0))
                        .otherwise(F.col("l_orderkey")))  # rows rewritten, none dropped
    n = hot.count()
    hot_rows = hot.filter("l_orderkey = 0").count()
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    rules = [{"rule_type": "unique", "column": "l_orderkey"},
             {"rule_type": "referential_integrity", "column": "l_orderkey",
              "parameters": {"reference_table": "orders", "reference_column": "o_orderkey"}},
             {"rule_type": "not_null", "column": "l_partkey"}]
    evaluate_rules(spark, hot, "lineitem", rules, TableSet({"orders": orders})).collect()
    latest_per_key(hot, ["l_orderkey"], [("l_shipdate", "desc", "last")],
                   [("l_linenumber", "desc", "last")]).write.format("noop").mode("overwrite").save()
    orphan_keys(hot, "l_orderkey", orders, "o_orderkey").collect()
    spark.stop()

    worst = 0
    for path in glob.glob(os.path.join(logdir, "**", "*"), recursive=True):
        if os.path.isdir(path):
            continue
        with open(path, encoding="utf-8") as fh:
            for line in fh:
                ev = json.loads(line)
                if ev.get("Event") == "SparkListenerTaskEnd":
                    m = (ev.get("Task Metrics") or {}).get("Shuffle Read Metrics") or {}
                    worst = max(worst, int(m.get("Total Records Read", 0)))
    print(json.dumps({"rows": n, "hot_key_rows": hot_rows, "max_shuffle_records_per_task": worst}))


if __name__ == "__main__":
    main()
