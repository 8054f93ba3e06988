"""STR1: row-level contract rules as a gate on a file stream.

``readStream`` over the landing folder -> ``foreachBatch`` running the
fused row-level rules on each micro-batch -> check rows and a run-log row
per batch, written to ``<sink>/batch_id=<id>`` and ``<runs>/batch_id=<id>``
with overwrite, so a replayed batch (same id after a failure) replaces its
own output instead of duplicating it. Uniqueness and foreign keys look across
batches: ``stateful`` has gates for them.

A gate's folder, ``<base_dir>/gate-<table>``, holds its checkpoint, checks and
runs: a gate started again on it goes on after the last batch. The default
base folder is the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covenant.operators.checks import evaluate_rules
from covenant.operators.quarantine import read_split, tag, write_split
from covenant.operators.results import rollup_runs
from covenant.session import ensure_checkpoint_dir

_ROW_COUNTER = {"rule_type": "row_count_min", "parameters": {"min_count": 0},
                "description": "rows in the micro-batch"}
STREAMABLE = ("not_null", "accepted_values", "min_value", "max_value", "regex_match",
              "custom_sql", "row_count_min")


def start_rule_gate(spark: SparkSession, source_dir: str, schema: T.StructType, table: str,
                    rules: Sequence[dict], glob: str = "*.parquet", base_dir: str | None = None,
                    available_now: bool = True, max_files_per_trigger: int | None = None,
                    check_interval_minutes: int | None = None, quarantine: bool = False):
    """Start the gate; returns (query, sink_path). With ``quarantine`` the rows of
    each batch go on as well, below ``rows`` beside the sink: passed and failed
    ones apart, the failed with the rules that they break (``gate_rows``).

    ``available_now`` processes what has landed and stops; otherwise the
    gate keeps running with one micro-batch every ``check_interval_minutes``
    (the contract's freshness cadence, default 60)."""
    bad = [r["rule_type"] for r in rules if r["rule_type"] not in STREAMABLE
           or "sql" in (r.get("parameters") or {})]
    if bad:
        raise ValueError(f"rules that span batches cannot run on a stream: {bad}")
    root = f"{(base_dir or ensure_checkpoint_dir(spark)).rstrip('/')}/gate-{table}"
    sink, runs, rows, ckpt = f"{root}/log", f"{root}/runs", f"{root}/rows", f"{root}/checkpoint"
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir)

    # the batch's row count rides in the same fused aggregate as the rules
    gated = list(rules) + [_ROW_COUNTER]

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        checks = evaluate_rules(batch.sparkSession, batch, table, gated)
        if quarantine:
            write_split(tag(batch, rules), f"{rows}/batch_id={batch_id}")
        # the folder name carries the batch id (read back as a partition column)
        checks.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
        written = batch.sparkSession.read.parquet(f"{sink}/batch_id={batch_id}")
        (rollup_runs(written, ["table_name", "schema_name"]).withColumn("run_id", F.lit(f"{table}-{batch_id}"))
         .withColumn("executed_at", F.localtimestamp()).write.mode("overwrite").parquet(f"{runs}/batch_id={batch_id}"))

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", ckpt)
    every = f"{int(check_interval_minutes or 60)} minutes"
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=every)
    return w.start(), sink


def gate_totals(spark: SparkSession, sink: str) -> DataFrame:
    """Per-rule totals over all micro-batches (equal to one batch run)."""
    checks = spark.read.parquet(sink)
    counter = (F.col("check_type") == "row_count_min") & (F.col("expected_value") == "0")
    rows = checks.filter(counter).agg(F.sum(F.col("actual_value").cast("bigint")).alias("rows_checked"))
    per_rule = checks.filter(~counter).groupBy("check_type", "column").agg(
        F.sum("violations").cast("bigint").alias("violations"))
    return per_rule.unionByName(rows.select(
        F.lit("rows_checked").alias("check_type"), F.lit(None).cast("string").alias("column"),
        F.col("rows_checked").cast("bigint").alias("violations")))


def gate_rows(spark: SparkSession, sink: str, passed: bool) -> DataFrame:
    """The passed or failed rows of a gate with quarantine, with their batch_id."""
    return read_split(spark, f"{sink.rpartition('/')[0]}/rows", passed)


def gate_runs(spark: SparkSession, sink: str) -> DataFrame:
    """The run-log rows of a gate, one per micro-batch."""
    return spark.read.parquet(f"{sink.rpartition('/')[0]}/runs")


def run_rule_gate(spark: SparkSession, source_dir: str, schema: T.StructType, table: str,
                  rules: Sequence[dict], glob: str = "*.parquet", base_dir: str | None = None) -> DataFrame:
    """Run the gate to the end of the available files and return totals; on a
    folder of its own unless ``base_dir`` names one to go on with."""
    base = base_dir or f"{ensure_checkpoint_dir(spark).rstrip('/')}/gates-{uuid.uuid4().hex}"
    q, sink = start_rule_gate(spark, source_dir, schema, table, rules, glob, base)
    q.awaitTermination()
    return gate_totals(spark, sink)


def start_contract_gate(spark: SparkSession, contract: dict, source_dir: str, schema: T.StructType,
                        glob: str = "*.parquet", available_now: bool = True, base_dir: str | None = None):
    """STR1 from a contract: its row-level rules (the ones a single batch can
    decide) gate the stream, at the contract's ``check_interval_minutes``."""
    from covenant.plans.contracts import normalise
    c = normalise(contract)
    rules = [r for r in c["quality_rules"]
             if r["rule_type"] in STREAMABLE and "sql" not in (r.get("parameters") or {})]
    interval = (c.get("freshness") or {}).get("check_interval_minutes")
    return start_rule_gate(spark, source_dir, schema, c["table_name"], rules, glob, base_dir,
                           available_now=available_now, check_interval_minutes=interval)
