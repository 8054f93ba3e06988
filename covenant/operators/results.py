"""Run roll-ups, the result log and report roll-ups (AGG7, AGG8, SINK3, GOV1).

Counting rules kept from the reference (Q1-Q3):
* total counts every check, freshness included (also when it errored);
* passed / failed / warning count their status; ERROR and SKIPPED add to
  the total only;
* a freshness check never counts as a warning;
* overall: error if the contract's checks could not run at all, failed if any
  failed, else warning if any warned, else passed (single ERROR checks do
  not fail a run unless ``strict``).
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covenant.operators.checks import CONTRACT_ERROR
from covenant.plans import vocabulary as V
from covenant.sources.tables import data_files

RUN_KEYS = ("run_id", "table_name", "schema_name")
#: a compaction makes one file, by one task, of so many bytes of files
COMPACTED_FILE_BYTES = 32 << 20


def overall_status(failed: Column, warning: Column, errors: Column | None = None,
                   strict: bool = False, crashed: Column | None = None) -> Column:
    s = F.when(F.coalesce(crashed, F.lit(False)), "error") if crashed is not None else F
    s = s.when(failed > 0, "failed").when(warning > 0, "warning")
    if strict and errors is not None:
        s = s.when(errors > 0, "error")
    return s.otherwise("passed")


def rollup_runs(checks: DataFrame, keys: Sequence[str] = RUN_KEYS, strict: bool = False,
                with_failed_names: int = 0, extra: Sequence[Column] = ()) -> DataFrame:
    """AGG7: one summary row per run from its check rows. With
    ``with_failed_names=n`` the same aggregate also keeps the first n failed
    check names in plan order (TOP5), so alerts need no second pass;
    ``extra`` aggregates join the same grouping."""
    keys = [k for k in keys if k in checks.columns]
    st = F.col("status")
    fresh = F.col("check_type") == "freshness"
    more = list(extra)
    if with_failed_names:
        more.append(F.slice(F.transform(
            F.array_sort(F.collect_list(F.when(st == "failed", F.struct("seq", "check_name")))),
            lambda x: x["check_name"]), 1, with_failed_names).alias("failed_check_names"))
    crashed = (F.col("check_name") == CONTRACT_ERROR) & (st == "error") if "check_name" in checks.columns else F.lit(False)
    agg = checks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_checks"),
        F.count_if(st == "passed").alias("passed_checks"),
        F.count_if(st == "failed").alias("failed_checks"),
        F.count_if((st == "warning") & ~fresh).alias("warning_checks"),
        F.count_if(st == "error").alias("error_checks"),
        F.max(crashed).alias("_crashed"),
        *more,
    )
    return agg.withColumn("overall_status", overall_status(
        F.col("failed_checks"), F.col("warning_checks"), F.col("error_checks"), strict, F.col("_crashed"))).drop("_crashed")


def failed_check_names(checks: DataFrame, keys: Sequence[str] = RUN_KEYS,
                       limit: int = V.ALERT_FAILED_NAMES) -> DataFrame:
    """TOP5: the first ``limit`` failed check names of each run, in plan
    order. Collected per run only after filtering to failed checks; a run
    has at most as many checks as its contract declares."""
    keys = [k for k in keys if k in checks.columns]
    failed = checks.filter(F.col("status") == "failed")
    return failed.groupBy(*keys).agg(
        F.slice(F.transform(F.array_sort(F.collect_list(F.struct("seq", "check_name"))),
                            lambda x: x["check_name"]), 1, limit).alias("failed_check_names"))


def log_rows(checks: DataFrame, executed_at=None) -> DataFrame:
    """SINK3 rows (FN9 JSON encode): the scalar columns of each run, its JSON
    payload with every check and the freshness result (null keys are
    serialised), and the failed names for alerts. ``checks`` has
    contract_version and duration_seconds beside the check columns. One
    grouping on the run keys gives all of it."""
    keys = [k for k in RUN_KEYS if k in checks.columns]
    body = [c for c in checks.columns if c not in (*keys, "contract_version", "duration_seconds")]
    fresh = F.struct(
        "status", F.col("column").alias("timestamp_column"),
        F.col("expected_value").try_cast("bigint").alias("max_delay_minutes"),
        F.col("actual_value").try_cast("double").alias("actual_delay_minutes"),
        (F.col("status") == "passed").alias("is_within_sla"), "message")
    runs = rollup_runs(checks, keys, with_failed_names=V.ALERT_FAILED_NAMES, extra=[
        F.array_sort(F.collect_list(F.struct(*body))).alias("checks"),
        F.max(F.when(F.col("check_type") == "freshness", fresh)).alias("freshness_result"),
        F.max("contract_version").alias("contract_version"),
        F.max("duration_seconds").alias("duration_seconds")])
    ts = F.localtimestamp() if executed_at is None else F.to_timestamp_ntz(F.lit(str(executed_at)))
    r = runs.select(*keys, "contract_version", "overall_status", "total_checks", "passed_checks", "failed_checks",
                    "warning_checks", "duration_seconds", "checks", "freshness_result", ts.alias("executed_at"), "failed_check_names")
    stored = [c for c in r.columns if c != "failed_check_names"]
    payload = F.to_json(F.struct(*stored), {"ignoreNullFields": "false"})
    return r.withColumn("result_data", payload).drop("checks", "freshness_result")


def append_log(rows: DataFrame, path: str) -> None:
    """SINK3/SINK4: add to the log, one folder per run date and run: reads of
    a time range prune folders, and a run written again replaces its own rows."""
    (rows.drop("failed_check_names").withColumn("run_date", F.to_date("executed_at"))
         .withColumn("run", F.concat(F.lit("run-"), F.col("run_id").cast("string")))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date", "run").parquet(path))


def _compacted(spark: SparkSession, path: str) -> list[str]:
    """Folders of the newest compaction of a log."""
    from covenant.sources import registry as RG

    found = {v: f for v, f in RG.commits(spark, f"{path.rstrip('/')}/_compacted").items() if f}
    return [f"{path.rstrip('/')}/_compacted/{found[max(found)]}"] if found else []


def _log_parts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows in run folders that no compaction holds, rows of the compaction that
    no later write of their run replaced), with ``run``; the first also with the
    name of the file."""
    folders = _compacted(spark, path)
    if not folders:
        return spark.read.parquet(path).withColumn("source_file", F.col("_metadata.file_name")), None
    done = spark.read.parquet(*folders)
    rows = spark.read.schema(done.drop("source_file").schema).option("basePath", path).parquet(path)
    live = rows.withColumn("source_file", F.col("_metadata.file_name")).join(
        done.select("run_date", "run", "source_file").distinct(), ["run_date", "run", "source_file"], "left_anti")
    return live, done.join(live.select("run_date", "run").distinct(), ["run_date", "run"], "left_anti")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log's rows, whether their run's folder was compacted or not."""
    live, done = _log_parts(spark, path)
    if done is None:
        return live.drop("run", "source_file")
    names = [c for c in live.columns if c not in ("run", "source_file")]
    return live.select(*names).unionByName(done.select(*names))


def _compaction_bytes(spark: SparkSession, path: str, before) -> int:
    """Bytes of the files that a compaction reads, or some more: run folders that
    an earlier compaction holds and that are not dropped yet count too."""
    day = F.regexp_extract("path", "run_date=([^/]+)/", 1).try_cast("date")
    parts = [data_files(spark, path).filter(day < F.lit(str(before)).cast("date")), *[data_files(spark, f) for f in _compacted(spark, path)]]
    return sum(p.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0] for p in parts)


def compact_log(spark: SparkSession, path: str, before, files: int | None = None) -> int:
    """SINK3 compaction: the runs of all dates before ``before`` as few files; the
    number of compactions of this log so far. Without ``files`` there is a file for
    each ``COMPACTED_FILE_BYTES`` read, so a task's share does not grow with the log;
    rows are dealt by all plain columns, so one large run is shared out too.

    The rows are written beside the log with the name of the file that each came
    from, then one commit makes all readers take them instead of those files. A
    reader that listed the log before goes on with the files that it saw; they
    stay until ``drop_compacted``. A run that is written again later stands in new
    files and replaces its compacted rows. Of two compactions at a time, the
    later one to commit goes again on what the other left."""
    from covenant.sources import registry as RG

    root, path = f"{path.rstrip('/')}/_compacted", path.rstrip("/")
    while True:
        base = max(RG.commits(spark, root), default=0)
        live, done = _log_parts(spark, path)
        old = live.filter(F.col("run_date") < F.lit(str(before)).cast("date"))
        rows = old if done is None else old.unionByName(done.select(*old.columns))
        plain = [f.name for f in rows.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))]
        n = files or -(-_compaction_bytes(spark, path, before) // COMPACTED_FILE_BYTES) or 1
        folder = f"data-{uuid.uuid4().hex}"
        rows.repartition(n, *plain).sortWithinPartitions("run_date", "run").write.parquet(f"{root}/{folder}")
        if RG.put_if_absent(spark, f"{root}/_commits/{base + 1:020d}", folder):
            return base + 1


def drop_compacted(spark: SparkSession, path: str) -> int:
    """Delete the files that the newest compaction holds, and older compactions;
    their number. For when no reader from before the compaction is left."""
    from covenant.sources import registry as RG

    folders = _compacted(spark, path)
    if not folders:
        return 0
    held = spark.read.parquet(*folders).select("run_date", "run", "source_file").distinct()
    fs, root = RG._fs(spark, path)
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    n = 0
    for r in held.toLocalIterator():
        n += bool(fs.delete(Path(root, f"run_date={r['run_date']}/run={r['run']}/{r['source_file']}"), False))
    keep = {f.rpartition("/")[2] for f in folders}
    for st in fs.listStatus(Path(root, "_compacted")):
        if st.getPath().getName().startswith("data-") and st.getPath().getName() not in keep:
            fs.delete(st.getPath(), True)
    return n


class Stopwatch:
    def __init__(self):
        self.t0 = time.monotonic()

    def seconds(self) -> float:
        return round(time.monotonic() - self.t0, 3)
