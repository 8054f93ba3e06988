"""GOV1-GOV3 and GOV11: run the contracts of a warehouse and publish the
results.

    contracts --per table: contract_parts (a few Spark plans per table)-->
              checks, one folder per table in the run's checks folder
              --> runs (roll-up) added to the run log
              --> {governance snapshot, summary report, alerts}

Checks are written before anything reads them twice: the written table
cuts the lineage (an executor lost later recomputes from the written
files, not from the source tables), and the metrics and the report both
read it. Contract metadata is planned on the driver, some contracts at a
time; all data work is Spark jobs, several tables at once.
"""

from __future__ import annotations

import contextlib
import threading
import time
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covenant.functions.literals import local_rows
from covenant.operators import governance as G
from covenant.operators import results as R
from covenant.operators.checks import Part, contract_parts, error_rows, single_parts
from covenant.plans.contracts import normalise
from covenant.session import ensure_checkpoint_dir
from covenant.sources.tables import TableSet

#: tables checked at the same time
CONCURRENT_TABLES = 5


def new_folder(spark: SparkSession) -> str:
    """A fresh folder name below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/governance-{uuid.uuid4().hex}"


def _reason(exc: Exception) -> str:
    return str(exc).split("\n\nJVM stacktrace")[0].strip()


class _Limit:
    """Jobs of one table: a scheduler pool and a job group of their own, which
    is cancelled at the time limit."""

    def __init__(self, spark: SparkSession, name: str, seconds: float | None):
        self.context, self.name, self.seconds = spark.sparkContext, name, seconds
        self.passed = threading.Event()
        self._done = threading.Event()

    def _watch(self) -> None:
        end = time.monotonic() + self.seconds
        while not self._done.wait(max(0.05, min(0.5, end - time.monotonic()))):
            if time.monotonic() >= end:  # again and again: a job may start after a cancellation
                self.passed.set()
                self.context.cancelJobGroup(self.name)

    @contextlib.contextmanager
    def watched(self) -> Iterator[None]:
        self.context.setLocalProperty("spark.scheduler.pool", self.name)
        self.context.setJobGroup(self.name, self.name, interruptOnCancel=True)
        watcher = threading.Thread(target=self._watch, daemon=True) if self.seconds is not None else None
        if watcher is not None:
            watcher.start()
        try:
            yield
        finally:
            self._done.set()
            if watcher is not None:
                watcher.join()
            self.context.setJobGroup(f"{self.name}-end", self.name)  # what is written now is not cancelled
            self.context.setLocalProperty("spark.scheduler.pool", None)


def _check_table(spark: SparkSession, doc: dict, tables: TableSet, target: str, as_of, name: str, seconds: float | None) -> float:
    """``_write_checks`` within a time limit; seconds that it took. A table that
    passes the limit becomes one ERROR check, whatever of it was written."""
    clock = R.Stopwatch()
    limit = _Limit(spark, name, seconds)
    try:
        with limit.watched():
            _write_checks(spark, doc, tables, target, as_of, limit)
    except Exception:  # noqa: BLE001 - a cancelled job
        if not limit.passed.is_set():
            raise
    if limit.passed.is_set():
        c = normalise(doc)
        rows = error_rows(spark, c, [], f"checks did not end within {seconds:g} seconds")
        rows.withColumn("contract_version", F.lit(c["version"])).write.mode("overwrite").parquet(target)
    return clock.seconds()


def _write_checks(spark: SparkSession, doc: dict, tables: TableSet, target: str, as_of, limit: _Limit) -> None:
    """Write one table's checks to ``target``. If the
    checks fail at run time together, the parts run one by one, and the rules
    of a failing part each on their own; only what fails becomes an ERROR
    check (GOV3). A contract that cannot be planned becomes one."""
    c = normalise(doc)

    def write(rows: DataFrame, mode: str) -> None:
        rows.withColumn("contract_version", F.lit(c["version"])).write.mode(mode).parquet(target)

    def alone(part: Part, df: DataFrame | None) -> None:
        if limit.passed.is_set():
            return
        try:
            write(part.rows, "append")
            return
        except Exception as exc:  # noqa: BLE001 - becomes an ERROR check below
            reason = _reason(exc)
        if len(part.specs) > 1:
            for one in single_parts(spark, df, c, part, as_of):
                alone(one, df)
        else:
            write(error_rows(spark, c, part.specs, f"check failed: {reason}"), "append")

    try:
        df = tables.get(c["table_name"], c["schema_name"])
        parts = contract_parts(spark, df, c, tables, as_of)
    except Exception as exc:  # noqa: BLE001
        write(error_rows(spark, c, [], f"checks cannot be planned: {_reason(exc)}"), "overwrite")
        return
    try:
        write(reduce(DataFrame.unionByName, [p.rows for p in parts]), "overwrite")
    except Exception:  # noqa: BLE001 - a failing check must not sink the table's others
        if limit.passed.is_set():
            return
        write(parts[0].rows.limit(0), "overwrite")  # nothing of the failed write stays
        for part in parts:
            alone(part, df)


def run_contracts(spark: SparkSession, contracts: Iterable[dict], tables: TableSet, out_dir: str, as_of=None,
                  run_id: str | None = None, concurrent: int = CONCURRENT_TABLES, timeout_seconds: float | None = None) -> DataFrame:
    """GOV1/GOV2: evaluate every contract against its table, ``concurrent``
    tables at a time. Each table's jobs have a scheduler pool of their own, so
    under ``spark.scheduler.mode=FAIR`` a slow table does not hold back the
    others; what a table has not ended within ``timeout_seconds`` (default: no
    limit) is cancelled and the table is an ``error`` run. Each table's checks are a folder of their own, written
    with overwrite: a repeat replaces them. Returns the written checks with
    run_id, contract_version and each table's own duration_seconds; no
    contracts give no rows."""
    run_id = run_id or uuid.uuid4().hex
    path = f"{out_dir.rstrip('/')}/checks/run={run_id}"
    times: list[tuple[int, float]] = []
    pending: dict[Future, int] = {}

    def collect(done: Iterable[Future]) -> None:
        times.extend((pending.pop(f), f.result()) for f in list(done))

    with ThreadPoolExecutor(max_workers=concurrent) as pool:
        for i, doc in enumerate(contracts):
            if len(pending) >= concurrent:
                collect(wait(pending, return_when=FIRST_COMPLETED).done)
            pending[pool.submit(_check_table, spark, doc, tables, f"{path}/part={i}", as_of, f"checks-{run_id}-{i}", timeout_seconds)] = i
        collect(wait(pending).done)
    if not times:
        return _no_checks(spark, run_id)
    durations = local_rows(spark, times, "part int, duration_seconds double")
    checks = spark.read.parquet(path).withColumn("run_id", F.lit(run_id))
    return checks.join(durations, "part", "left").drop("part")


def _no_checks(spark: SparkSession, run_id: str) -> DataFrame:
    empty = error_rows(spark, {"table_name": "", "columns": []}, [], "").limit(0)
    return empty.withColumn("contract_version", F.lit("")).withColumn("run_id", F.lit(run_id)).withColumn("duration_seconds", F.lit(0.0))


def empty_log(spark: SparkSession) -> DataFrame:
    """A run log without rows."""
    return R.log_rows(_no_checks(spark, "")).drop("failed_check_names").withColumn("run_date", F.to_date("executed_at"))


def governance_run(spark: SparkSession, contracts: Iterable[dict], tables: TableSet,
                   inventory: DataFrame, registry: DataFrame, as_of=None,
                   out_dir: str | None = None, run_id: str | None = None, timeout_seconds: float | None = None) -> dict[str, DataFrame]:
    """GOV11: checks -> runs (logged) -> snapshot, report, alerts. ``runs`` and
    ``alerts`` are this run's; ``log``, ``report`` and ``snapshot`` cover the
    whole log."""
    out_dir = out_dir or new_folder(spark)
    run_id = run_id or uuid.uuid4().hex
    checks = run_contracts(spark, contracts, tables, out_dir, as_of, run_id, timeout_seconds=timeout_seconds)
    rows = R.log_rows(checks, as_of)
    log_path = f"{out_dir.rstrip('/')}/quality_results"
    R.append_log(rows, log_path)
    log = R.read_log(spark, log_path)
    mine = log.filter(F.col("run_id") == run_id)
    return {
        "checks": checks,
        "runs": mine,
        "log": log,
        "snapshot": G.governance_snapshot(inventory, registry, log, as_of),
        "report": G.summary_report(log),
        "alerts": G.quality_alerts(mine, R.failed_check_names(checks)),
    }
