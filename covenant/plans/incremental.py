"""Checks on new data only: mergeable states per input file (RUL1-9, GOV11).

A table is a folder of Parquet files that is checked again and again. What a
check needs to know of a file is kept, so that the next run reads only the files
that came since:

* row rules, row count and freshness: one row a file, with its count of rows,
  violations per rule, least and greatest value, and latest time. Counts are
  added, extremes are compared;
* uniqueness and foreign keys: the non-null keys of a file with their counts.
  Counts of the same key in several files are added. Whether a key occurs twice,
  or is missing in the reference, is asked of the sums, so a duplicate across
  files is found and the reference may change between runs.

A file is known by path, length and modification time. A file that was rewritten
is read again, one that is gone no longer counts (its states stay on disk until
``vacuum``). States belong to a plan: if the rules (or the columns' types) change,
all files are new. A query rule (``custom_sql`` with ``sql``) cannot be merged and
runs on the whole table each time.

Each run writes its states to a folder of its own below ``states/<plan>``; a run
that failed half way leaves a folder without ``_SUCCESS`` and is not read. Two runs
at the same time may both read a new file; of a file's states only those of one
run count.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covenant.functions.literals import local_rows
from covenant.operators import checks as C
from covenant.plans.checkplan import CheckSpec, check_name, plan_contract
from covenant.plans.contracts import normalise
from covenant.sources.tables import TableSet, data_files, path_exists

#: a file as it was when its state was made (names that no table of its own has)
FILE = ["__path", "__length", "__modified"]


def _signature(plan: list[CheckSpec], schema) -> str:
    """The plan and the types it was made for."""
    text = json.dumps([[s.seq, s.check_type, s.column, s.params_json, s.severity] for s in plan]) + schema.json()
    return hashlib.sha256(text.encode()).hexdigest()[:24]


def _state_aggs(df: DataFrame, specs: list[CheckSpec]):
    """What a file's state row holds: ``__v`` violations, ``__a`` extremes in
    the column's own type, ``__m`` latest time."""
    for s in specs:
        if s.check_type == "freshness":
            yield F.max(s.column).alias(f"__m{s.seq}")
        elif s.check_type != "row_count_min":
            yield F.count_if(C.row_predicate_failures(df, s)).alias(f"__v{s.seq}")
            if s.check_type in ("min_value", "max_value"):
                yield (F.min if s.check_type == "min_value" else F.max)(s.column).alias(f"__a{s.seq}")


def _merge_aggs(specs: list[CheckSpec]):
    """State rows of many files as the one row that ``_fused_outputs`` reads."""
    yield F.coalesce(F.sum("__n"), F.lit(0)).alias("__n")
    for s in specs:
        if s.check_type == "freshness":
            yield F.max(f"__m{s.seq}").alias(f"__m{s.seq}")
        elif s.check_type != "row_count_min":
            yield F.coalesce(F.sum(f"__v{s.seq}"), F.lit(0)).alias(f"__v{s.seq}")
            if s.check_type in ("min_value", "max_value"):
                yield (F.min if s.check_type == "min_value" else F.max)(f"__a{s.seq}").cast("string").alias(f"__a{s.seq}")


def _key_group(spec: CheckSpec) -> str | None:
    """The columns whose key counts a rule reads; rules on the same columns share them."""
    return spec.column if spec.check_type in ("unique", "referential_integrity") else None


@dataclass
class Run:
    """Checks of one run, and what it read for them."""

    checks: DataFrame
    files: int
    files_read: int
    rows_read: int


class IncrementalChecks:
    """The checks of one contract on one folder, with the states of its files
    below ``root``."""

    def __init__(self, spark: SparkSession, contract: dict, folder: str, root: str, tables: TableSet | None = None):
        self.spark, self.contract, self.folder, self.tables = spark, normalise(contract), folder, tables
        self.root = f"{root.rstrip('/')}/states/{self.contract['schema_name']}.{self.contract['table_name']}"

    def _known(self, path: str) -> DataFrame | None:
        """States of all finished runs."""
        fs, p = _fs(self.spark, f"{path}/run=*/_SUCCESS")
        runs = [st.getPath().getParent().toString() for st in fs.globStatus(p) or []]
        return self.spark.read.option("mergeSchema", "false").parquet(*runs) if runs else None

    def _files(self) -> DataFrame:
        return data_files(self.spark, self.folder).toDF(*FILE)

    def run(self, as_of=None) -> Run:
        spark, c = self.spark, self.contract
        df = spark.read.option("recursiveFileLookup", "true").parquet(self.folder)
        plan = [s for s in plan_contract(c) if s.check_type not in ("column_exists", "column_type")]
        static = C.schema_check_rows(df, c, plan_contract(c))
        split = C.split_plan(spark, df, plan, static, c["schema_name"], self.tables)
        home = f"{self.root}/{_signature(plan, df.schema)}"
        files = self._files()
        done = self._known(f"{home}/rows")
        # states of files as they are now; of a file read by two runs, those of one
        kept = None if done is None else done.join(files, FILE, "left_semi")
        new = files if kept is None else files.join(kept.select(*FILE), FILE, "left_anti")
        todo = [tuple(r) for r in new.collect()]  # a list of files, as any scan's driver holds it
        read = self._read_new(df, todo, split, home) if todo else 0
        states = self._known(f"{home}/rows")
        checks = self._evaluate(df, files, states, split, static, home, as_of)
        return Run(checks, files.count(), len(todo), read)

    # ------------------------------------------------------------- states

    def _read_new(self, df: DataFrame, todo: list[tuple], split, home: str) -> int:
        """States of the files in ``todo`` as one run's folders. The rows folder
        is written last: it says that the run's keys are there too."""
        spark, run = self.spark, uuid.uuid4().hex
        listed = spark.read.schema(df.schema).parquet(*[t[0] for t in todo])
        # the metadata column gives the path URL-encoded (but for plus signs)
        path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        rows = listed.withColumns(dict(zip(FILE, (path, F.col("_metadata.file_size"), F.unix_micros("_metadata.file_modification_time")))))
        # a file's number stands for its name in what is shuffled and grouped
        number = F.broadcast(local_rows(spark, [(*t, i) for i, t in enumerate(todo)], "__path string, __length long, __modified long, __file long"))
        for columns in sorted({k for s in split.keyed if (k := _key_group(s))}):
            parts = columns.split(",")
            names = [f"key{i}" for i in range(len(parts))]
            keyed = rows.select(*FILE, *[F.col(p).alias(k) for p, k in zip(parts, names)]).dropna("any", subset=names)
            counted = _counted(_folded(keyed.join(number, FILE).select("__file", *names)), ["__file", *names])
            counted.join(number, "__file").select(*FILE, *names, "n").withColumn("run_id", F.lit(run)) \
                .write.mode("overwrite").parquet(f"{home}/keys/{_folder(columns)}/run={run}")
        state = rows.groupBy(*FILE).agg(F.count(F.lit(1)).alias("__n"), *_state_aggs(df, split.fused))
        # a file without rows has a state too, or it would be read again each time
        all_new = local_rows(spark, todo, "__path string, __length long, __modified long")
        state = all_new.join(state, FILE, "left").fillna(0, subset=["__n"]).withColumn("run_id", F.lit(run))
        state.write.mode("overwrite").parquet(f"{home}/rows/run={run}")
        return spark.read.parquet(f"{home}/rows/run={run}").agg(F.sum("__n")).first()[0] or 0

    def _counting(self, files: DataFrame, states: DataFrame) -> DataFrame:
        """(file, run_id): the one run whose states count for each present file."""
        return states.join(files, FILE, "left_semi").groupBy(*FILE).agg(F.min("run_id").alias("run_id"))

    def _evaluate(self, df, files, states, split, static, home, as_of) -> DataFrame:
        c, spark = self.contract, self.spark
        table, schema = c["table_name"], c["schema_name"]
        counting = self._counting(files, states) if states is not None else None
        out = []
        if static:
            out.append(C.static_checks(spark, static, table, schema))
        if split.fused:
            if states is None:  # an empty folder
                merged = df.agg(F.count(F.lit(1)).alias("__n"), *_state_aggs(df, split.fused))
            else:
                merged = states.join(counting, [*FILE, "run_id"], "left_semi").agg(*_merge_aggs(split.fused))
            outs = C._fused_outputs(split.fused, split.plan, table, schema, as_of)
            out.append(merged.select(F.explode(F.array(*outs)).alias("c")).select("c.*"))
        for s in split.keyed:
            parts = s.column.split(",")
            counts = self._key_counts(s, parts, df, counting, home)
            if s.check_type == "unique":
                out.append(C.unique_check(C.duplicates_of(counts, parts), s, check_name(s, split.plan), table, schema))
            else:
                ref = self.tables.reference(s.params["reference_table"], schema)
                out.append(C.fk_check(C.orphans_of(counts, s.column, ref, s.params["reference_column"]), s, check_name(s, split.plan), table, schema))
        for s in split.whole:
            out.append(C.query_check(spark, df, s, check_name(s, split.plan), table, schema, self.tables))
        return reduce(DataFrame.unionByName, out)

    def _key_counts(self, spec: CheckSpec, parts: list[str], df: DataFrame, counting: DataFrame | None, home: str) -> DataFrame:
        """Non-null keys of the present files with their number of rows."""
        kept = self._known(f"{home}/keys/{_folder(spec.column)}") if counting is not None else None
        if kept is None:
            return df.select(*parts).dropna("any").groupBy(*parts).agg(F.count(F.lit(1)).alias("n_rows"))
        # a list of files: broadcast, or the keys of one large file would meet it in one task
        named = kept.join(F.broadcast(counting), [*FILE, "run_id"], "left_semi")
        sums = _counted(named, [f"key{i}" for i in range(len(parts))])
        return sums.select(*[F.col(f"key{i}").alias(p) for i, p in enumerate(parts)], F.col("n").alias("n_rows"))

    def vacuum(self) -> int:
        """Rewrite the states of present files as one run each and drop the
        others; the number of files whose states are kept. Not beside a run."""
        df = self.spark.read.option("recursiveFileLookup", "true").parquet(self.folder)
        plan = [s for s in plan_contract(self.contract) if s.check_type not in ("column_exists", "column_type")]
        home = f"{self.root}/{_signature(plan, df.schema)}"
        states = self._known(f"{home}/rows")
        if states is None:
            return 0
        counting = self._counting(self._files(), states)
        run = uuid.uuid4().hex
        jvm = self.spark.sparkContext._jvm
        keys = f"{home}/keys"
        folders = [f"{keys}/{st.getPath().getName()}" for st in _fs(self.spark, keys)[0].listStatus(jvm.org.apache.hadoop.fs.Path(keys))] if path_exists(self.spark, keys) else []
        for path in [*folders, f"{home}/rows"]:
            old = [st.getPath() for st in _fs(self.spark, path)[0].listStatus(jvm.org.apache.hadoop.fs.Path(path))]
            (self._known(path).join(counting, [*FILE, "run_id"], "left_semi").withColumn("run_id", F.lit(run))
             .write.mode("overwrite").parquet(f"{path}/run={run}"))
            for p in old:
                _fs(self.spark, path)[0].delete(p, True)
        return self._known(f"{home}/rows").count()


#: types that Arrow groups by
_FOLDS = (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _folded(rows: DataFrame) -> DataFrame:
    """(columns, number of rows ``n``) for each record batch: a hot key ships one row
    a record batch, and a task holds one batch, whatever the number of keys."""
    columns = rows.columns
    if not all(isinstance(f.dataType, _FOLDS) for f in rows.schema):
        return rows.withColumn("n", F.lit(1).cast("long"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.Table.from_batches([batch]).group_by(columns).aggregate([([], "count_all")])
            yield from out.select([*columns, "count_all"]).rename_columns([*columns, "n"]).combine_chunks().to_batches()

    return rows.mapInArrow(fold, T.StructType([*rows.schema.fields, T.StructField("n", T.LongType())]))


def _counted(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Sums of ``n`` by ``columns``. Dealt out first: nearly all keys are unique, so a
    map side that aggregates would hold the keys of its whole file to drop few."""
    return rows.select(*columns, "n").repartition(*columns).groupBy(*columns).agg(F.sum("n").alias("n"))


def _folder(columns: str) -> str:
    return hashlib.sha256(columns.encode()).hexdigest()[:16]


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p
