"""STR1 for rules that look across micro-batches.

* **Uniqueness.** The number of rows of each key is keyed state
  (``transformWithStateInPandas``, kept by Spark's state store with the stream's
  checkpoint), so a second row of a key is found however many batches later it
  comes. Rows are folded to (key, count, latest time) in each record batch before
  the shuffle, so a hot key ships one row a record batch. A key that has more than
  one row writes (rows before, rows now) for each batch that adds to it. The state
  is kept by bucket, a remainder of the key's hash: a batch calls Python and the
  state store once for each bucket that it touches, not for each key.
  Without ``horizon_minutes`` state is kept for ever and totals equal the batch
  rule. With it, a watermark on the time column lets go of keys that were not
  seen for that long in event time: duplicates farther apart, and rows later than
  the watermark, are not found.
* **Foreign keys.** Each batch's distinct keys are anti-joined with the
  reference as it is then. Keys without a match are written with their number of
  rows; ``open_orphans`` asks the reference again, so a row that came before its
  reference is no orphan for good.

Each batch writes to ``batch_id=<id>`` with overwrite: a batch that runs again
after a failure replaces its own output, and the state store goes back to the
version of its checkpoint. A gate started again on its folder goes on there.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from covenant.operators.checks import key_counts, orphans_of
from covenant.session import ensure_checkpoint_dir

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_N, _TS, _UNTIL, _BUCKET = "n_folded", "ts_folded", "until_folded", "bucket_folded"
#: keys with equal remainders of their hash share one value of the state; a gate's
#: checkpoint holds this number, so it stays
BUCKETS = 4096


class KeyCounts(StatefulProcessor):
    """Rows seen of each key of a bucket; says of keys with new rows how many there
    were and are when there is more than one. The keys of a bucket are one value of
    the state, an Arrow table of (key parts, n, until)."""

    def __init__(self, keys: T.StructType, horizon_ms: int | None):
        self.keys, self.horizon_ms = keys.names, horizon_ms
        # times as the record batches of a group have them: without a zone
        kinds = [pa.timestamp("us") if isinstance(f.dataType, T.TimestampType) else to_arrow_type(f.dataType) for f in keys]
        self.typed = pa.schema([*zip(self.keys, kinds), (_N, pa.int64()), (_UNTIL, pa.int64())])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "entries binary")

    def _held(self) -> pa.Table:
        found = self.seen.get()
        return self.typed.empty_table() if found is None else pa.ipc.open_stream(bytes(found[0])).read_all()

    def _hold(self, entries: pa.Table) -> None:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.typed) as out:
            out.write_table(entries.select(self.typed.names).cast(self.typed).combine_chunks())
        self.seen.update((sink.getvalue().to_pybytes(),))
        if self.horizon_ms is not None:  # the first that can be let go of
            self.handle.registerTimer(pc.min(entries[_UNTIL]).as_py())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        parts = [held.append_column("before", held[_N])]
        for part in rows:
            until = 0 if self.horizon_ms is None else part[_TS].fillna(pd.Timestamp(0)).astype("datetime64[ms]").astype("int64") + self.horizon_ms
            came = pa.Table.from_pandas(part[[*self.keys, _N]].assign(**{_UNTIL: until}), self.typed, preserve_index=False)
            parts.append(came.append_column("before", pa.array([None] * came.num_rows, pa.int64())))
        # a key without new rows has one entry, the held one
        all_of = pa.concat_tables(parts).group_by(self.keys).aggregate([(_N, "sum"), (_UNTIL, "max"), ("before", "sum"), ([], "count_all")])
        all_of = all_of.rename_columns({f"{_N}_sum": _N, f"{_UNTIL}_max": _UNTIL})
        self._hold(all_of)
        before = pc.fill_null(all_of["before_sum"], 0)
        told = all_of.select(self.keys).append_column("rows_before", before).append_column("rows_now", all_of[_N])
        told = told.filter(pc.and_(pc.greater(all_of[_N], before), pc.greater(all_of[_N], 1)))
        if told.num_rows:
            yield told.to_pandas()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, at = self._held(), expiredTimerInfo.getExpiryTimeInMs()
        over = pc.or_(pc.less_equal(held[_UNTIL], at), pc.less(held[_UNTIL], timerValues.getCurrentWatermarkInMs()))
        kept = held.filter(pc.invert(over))
        if kept.num_rows:
            self._hold(kept)
        else:
            self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def folded(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, number of rows, latest time) for each record batch; rows have the
    keys and ``__ts``."""
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField(_N, T.LongType()), T.StructField(_TS, rows.schema[_TS].dataType)])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.Table.from_batches([batch]).group_by(list(keys)).aggregate([([], "count_all"), (_TS, "max")])
            yield from out.select([*keys, "count_all", f"{_TS}_max"]).rename_columns([*keys, _N, _TS]).combine_chunks().to_batches()

    return rows.mapInArrow(fold, schema)


@contextlib.contextmanager
def _keyed_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which keyed state needs."""
    old = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, old)


def _root(spark: SparkSession, base_dir: str | None, name: str) -> str:
    return f"{(base_dir or ensure_checkpoint_dir(spark)).rstrip('/')}/gate-{name}"


def _stream(spark: SparkSession, source_dir: str, schema: T.StructType, glob: str, max_files: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(source_dir)


def _started(stream: DataFrame, mode: str, per_batch: Callable, checkpoint: str, available_now: bool, minutes: int | None):
    w = stream.writeStream.outputMode(mode).foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{int(minutes or 60)} minutes")).start()


def start_unique_gate(spark: SparkSession, source_dir: str, schema: T.StructType, table: str, columns: Sequence[str],
                      time_column: str | None = None, horizon_minutes: int | None = None, glob: str = "*.parquet",
                      base_dir: str | None = None, available_now: bool = True, max_files_per_trigger: int | None = None,
                      check_interval_minutes: int | None = None):
    """Start a uniqueness gate on ``columns``; returns (query, sink). Rows with a
    null key part are left out, as in the batch rule."""
    if horizon_minutes is not None and not time_column:
        raise ValueError("a horizon needs a time column")
    root = _root(spark, base_dir, f"{table}-unique-{'-'.join(columns)}")
    sink = f"{root}/log"
    ts = F.col(time_column).cast("timestamp") if horizon_minutes is not None else F.lit(None).cast("timestamp")
    rows = _stream(spark, source_dir, schema, glob, max_files_per_trigger).select(*columns, ts.alias(_TS)).dropna("any", subset=list(columns))
    few = folded(rows, columns).withColumn(_BUCKET, F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)))
    if horizon_minutes is not None:
        few = few.withWatermark(_TS, f"{int(horizon_minutes)} minutes")
    out = T.StructType([*[schema[c] for c in columns], T.StructField("rows_before", T.LongType()), T.StructField("rows_now", T.LongType())])
    horizon_ms = None if horizon_minutes is None else int(horizon_minutes) * 60_000
    counted = few.groupBy(_BUCKET).transformWithStateInPandas(
        KeyCounts(T.StructType([schema[c] for c in columns]), horizon_ms), out, "Update", "None" if horizon_minutes is None else "EventTime")

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    with _keyed_state(spark):
        return _started(counted, "update", per_batch, f"{root}/checkpoint", available_now, check_interval_minutes), sink


def duplicate_totals(spark: SparkSession, sink: str, columns: Sequence[str]) -> DataFrame:
    """One row: duplicate key values, the rows they cover, and the keys that
    had rows in several batches."""
    log = spark.read.parquet(sink)
    added = F.col("rows_now") - F.when(F.col("rows_before") > 1, F.col("rows_before")).otherwise(0)
    per_key = log.groupBy(*columns).agg(F.sum(added).alias("n_rows"), F.max(F.col("rows_before") > 0).alias("across"))
    return per_key.agg(F.count(F.lit(1)).alias("duplicate_keys"), F.coalesce(F.sum("n_rows"), F.lit(0)).cast("long").alias("duplicate_rows"),
                       F.count_if("across").alias("keys_across_batches"))


def start_reference_gate(spark: SparkSession, source_dir: str, schema: T.StructType, table: str, column: str,
                         reference: Callable[[], DataFrame], reference_column: str, glob: str = "*.parquet",
                         base_dir: str | None = None, available_now: bool = True, max_files_per_trigger: int | None = None,
                         check_interval_minutes: int | None = None):
    """Start a foreign-key gate; returns (query, sink). ``reference`` is asked
    for the reference table at each batch."""
    root = _root(spark, base_dir, f"{table}-fk-{column}")
    sink = f"{root}/log"

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        orphans_of(key_counts(batch, [column]), column, reference(), reference_column).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    rows = _stream(spark, source_dir, schema, glob, max_files_per_trigger).select(column)
    return _started(rows, "append", per_batch, f"{root}/checkpoint", available_now, check_interval_minutes), sink


def open_orphans(spark: SparkSession, sink: str, column: str, reference: DataFrame, reference_column: str) -> DataFrame:
    """(key, n_rows) of all batches whose key the reference lacks now."""
    seen = spark.read.parquet(sink).groupBy(column).agg(F.sum("n_rows").alias("n_rows"))
    return orphans_of(seen, column, reference, reference_column)


def start_contract_gates(spark: SparkSession, contract: dict, source_dir: str, schema: T.StructType,
                         references: Callable[[str], DataFrame] | None = None, horizon_minutes: int | None = None,
                         glob: str = "*.parquet", available_now: bool = True, base_dir: str | None = None) -> dict[str, tuple]:
    """STR1 from a contract, rules across batches included: check name ->
    (query, sink); ``rows`` is the gate of the single-batch rules. Keys that are
    implied (``primary_key``) are gated too; ``references`` finds the table that a
    foreign key names."""
    from covenant.plans.checkplan import plan_contract
    from covenant.plans.contracts import normalise
    from covenant.streaming.gate import start_contract_gate

    c = normalise(contract)
    fresh = c.get("freshness") or {}
    every = {"glob": glob, "available_now": available_now, "base_dir": base_dir}
    out = {"rows": start_contract_gate(spark, c, source_dir, schema, **every)}
    for s in plan_contract(c):
        if s.check_type == "unique":
            out[s.name] = start_unique_gate(spark, source_dir, schema, c["table_name"], s.column.split(","), fresh.get("timestamp_column") if horizon_minutes else None,
                                            horizon_minutes, check_interval_minutes=fresh.get("check_interval_minutes"), **every)
        elif s.check_type == "referential_integrity" and references is not None:
            out[s.name] = start_reference_gate(spark, source_dir, schema, c["table_name"], s.column, lambda s=s: references(s.params["reference_table"]),
                                               s.params["reference_column"], check_interval_minutes=fresh.get("check_interval_minutes"), **every)
    return out
