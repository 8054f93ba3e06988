"""One place for the state a governance deployment keeps: the contract
registry (versioned snapshots), the run log and the metric snapshots, all
as Parquet under one shared root. Methods mirror the everyday workflows —
register and list contracts, run checks for one table or all, reports,
failing tables, history, metrics and trends — and return DataFrames; the
work is the Spark operators of this package.

Tables are found through ``tables`` (a ``TableSet`` or name -> DataFrame
mapping) and otherwise through the session catalog (``schema.table``).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covenant.functions.literals import local_rows
from covenant.operators import governance as G
from covenant.operators.results import read_log
from covenant.operators.freshness import freshness_many, stale_tables
from covenant.plans.contracts import CONTRACT_SCHEMA, contracts_df, read_contract_files, row_to_doc
from covenant.plans.pipeline import empty_log, governance_run
from covenant.session import ensure_checkpoint_dir
from covenant.sources import registry as RG
from covenant.sources.tables import TableSet

KEYS = ["table_name", "schema_name"]


class Workspace:
    def __init__(self, spark: SparkSession, root: str | None = None,
                 tables: TableSet | Mapping[str, DataFrame] | None = None,
                 inventory: DataFrame | None = None, definitions: str | None = None, check_timeout_seconds: float | None = None):
        self.definitions = definitions
        self.check_timeout_seconds = check_timeout_seconds
        self.spark = spark
        self.root = root.rstrip("/") if root else f"{ensure_checkpoint_dir(spark).rstrip('/')}/covenant-workspace"
        held = tables if isinstance(tables, TableSet) else TableSet(dict(tables or {}))
        self.tables = TableSet(find=lambda schema, name: self._lookup(held, schema, name))
        self._held = held
        self.inventory = inventory

    # ------------------------------------------------------------- paths
    @property
    def registry_root(self) -> str:
        return f"{self.root}/registry"

    @property
    def log_path(self) -> str:
        return f"{self.root}/quality_results"

    @property
    def metrics_path(self) -> str:
        return f"{self.root}/governance_metrics"

    def _exists(self, path: str) -> bool:
        fs, p = RG._fs(self.spark, path)
        return fs.exists(p)

    # ----------------------------------------------------------- registry
    def contracts(self) -> DataFrame:
        """SRC8: the current registry (empty when nothing is registered)."""
        return self._or_none(RG.read_snapshot(self.spark, self.registry_root))

    def _or_none(self, snap: DataFrame | None) -> DataFrame:
        if snap is None:
            return contracts_df(self.spark, []).withColumn(
                "created_at", F.lit(None).cast("timestamp_ntz")).withColumn(
                "updated_at", F.lit(None).cast("timestamp_ntz"))
        return snap

    def register(self, contracts: DataFrame | Iterable[dict], as_of=None) -> DataFrame:
        """SINK1: upsert contracts (only lint-clean ones; see ``lint``) and
        commit them as a new registry snapshot. Returns (table, schema,
        version, action) per contract."""
        inc = contracts if isinstance(contracts, DataFrame) else contracts_df(self.spark, list(contracts))
        inc = RG.valid_contracts(inc.select(*[f.name for f in CONTRACT_SCHEMA.fields]))
        merged = []

        def change(stored: DataFrame | None) -> DataFrame:
            merged[:] = [RG.upsert(self._or_none(stored), inc, as_of)]
            return merged[0].drop("action")

        RG.change_snapshot(self.spark, self.registry_root, change)
        # the previous snapshot stays readable, so this re-reads the same input
        return merged[0].select(*KEYS, "version", "action")

    def sync_directory(self, path: str, as_of=None) -> DataFrame:
        """SRC9 + SINK1: register every valid contract document (YAML or
        JSON) of a folder."""
        return self.register(read_contract_files(self.spark, path), as_of)

    def lint(self, contracts: DataFrame | Iterable[dict]) -> DataFrame:
        inc = contracts if isinstance(contracts, DataFrame) else contracts_df(self.spark, list(contracts))
        return RG.lint_contracts(inc)

    def get(self, table_name: str, schema_name: str = "public") -> DataFrame:
        return RG.get_contract(self.contracts(), table_name, schema_name)

    def delete(self, table_name: str, schema_name: str = "public") -> DataFrame:
        """SINK2: remove one contract (new snapshot); returns (table, schema,
        deleted) computed against the snapshot it replaced."""
        keys = local_rows(self.spark, [(table_name, schema_name)], "table_name string, schema_name string")
        reports = []

        def change(stored: DataFrame | None) -> DataFrame:
            remaining, report = RG.delete(self._or_none(stored), keys)
            reports[:] = [report]
            return remaining

        RG.change_snapshot(self.spark, self.registry_root, change)
        return reports[0]

    # ------------------------------------------------------------- checks
    def _lookup(self, held: TableSet, schema: str, name: str) -> DataFrame | None:
        df = held.get(name, schema)
        if df is not None:
            return df
        qualified = f"{schema}.{name}"
        return self.spark.table(qualified) if self.spark.catalog.tableExists(qualified) else None

    def _docs(self, contracts: DataFrame) -> Iterator[dict]:
        """Contract documents one by one, as the checks ask for them."""
        return map(row_to_doc, contracts.drop("created_at", "updated_at").toLocalIterator())

    def run_checks(self, contracts: DataFrame | None = None, as_of=None) -> dict[str, DataFrame]:
        """GOV1/GOV2/GOV11 for the given (default: all registered)
        contracts. The runs are added to the workspace log; ``runs`` and
        ``alerts`` are this call's, ``report``/``snapshot`` cover the whole log."""
        inventory = self.inventory if self.inventory is not None else self._inventory_of()
        return governance_run(self.spark, self._docs(contracts if contracts is not None else self.contracts()),
                              self.tables, inventory, self.contracts(), as_of, out_dir=self.root,
                              timeout_seconds=self.check_timeout_seconds)

    def resolve(self, table_name: str, schema_name: str = "public", as_of=None) -> DataFrame:
        """SRC7: the registered contract, else the one in the ``definitions``
        folder, which is registered then."""
        found = self.get(table_name, schema_name)
        if not found.isEmpty():
            return found
        if self.definitions is not None:
            files = RG.get_contract(read_contract_files(self.spark, self.definitions), table_name, schema_name)
            if not files.isEmpty():
                self.register(files, as_of)
                return self.get(table_name, schema_name)
        raise LookupError(f"no contract for {schema_name}.{table_name}")

    def run_checks_for_table(self, table_name: str, schema_name: str = "public", as_of=None):
        return self.run_checks(self.resolve(table_name, schema_name, as_of), as_of)

    def _inventory_of(self) -> DataFrame:
        return local_rows(self.spark, [(s, t, "BASE TABLE") for s, t in self._held.keys()],
                          "table_schema string, table_name string, table_type string")

    def check_freshness(self, as_of=None, stale_only: bool = False) -> DataFrame:
        """CHK4 / FIL9 over every registered contract."""
        res = freshness_many(self.spark, ((d, self.tables.get(d["table_name"], d["schema_name"]))
                                          for d in self._docs(self.contracts())), as_of)
        return stale_tables(res) if stale_only else res

    # ------------------------------------------------------------ reports
    def log(self) -> DataFrame:
        """The run log (empty before the first run)."""
        return read_log(self.spark, self.log_path) if self._exists(self.log_path) else empty_log(self.spark)

    def recent_results(self, limit: int = G.V.RECENT_RESULTS_LIMIT, table_name: str | None = None) -> DataFrame:
        return G.recent_results(self.log(), limit, table_name)

    def result_detail(self, run_id) -> DataFrame:
        return self.log().filter(F.col("run_id") == F.lit(run_id))

    def summary_report(self) -> DataFrame:
        return G.summary_report(self.log())

    def failing_tables(self, current: bool = False) -> DataFrame:
        return G.currently_failing(self.log()) if current else G.last_failure_per_table(self.log())

    def table_history(self, table_name: str, limit: int = G.V.TABLE_HISTORY_LIMIT) -> DataFrame:
        return G.table_history(self.log(), table_name, limit)

    # ------------------------------------------------------------ metrics
    def capture_snapshot(self, as_of=None) -> DataFrame:
        """GOV4 + SINK4: compute and append a metrics snapshot."""
        inventory = self.inventory if self.inventory is not None else self._inventory_of()
        snap = G.governance_snapshot(inventory, self.contracts(), self.log(), as_of)
        # a folder of its own: two captures at a time do not share a write
        (snap.withColumn("capture_date", F.to_date("captured_at")).withColumn("capture", F.lit(f"c-{uuid.uuid4().hex}"))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("capture_date", "capture").parquet(self.metrics_path))
        return self._metrics()

    def _metrics(self) -> DataFrame:
        return self.spark.read.parquet(self.metrics_path).drop("capture_date", "capture")

    def current_metrics(self, as_of=None) -> DataFrame:
        """TOP3: the latest snapshot; captured first when there is none."""
        if not self._exists(self.metrics_path):
            self.capture_snapshot(as_of)
        return G.latest_snapshot(self._metrics())

    def trends(self, days: int = G.V.TREND_DAYS, as_of=None) -> DataFrame:
        """GOV5: snapshots of the last ``days`` days, oldest first."""
        if not self._exists(self.metrics_path):
            return self.capture_snapshot(as_of).limit(0)
        return G.trend(self._metrics(), days, as_of)
