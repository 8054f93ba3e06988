"""Helpers shared by the training-data operators.

Intermediate tables go to the folder named by ``spark.checkpoint.dir`` (shared
by the driver and all executors), so a lost executor costs a re-read and not a
recomputation, and the lineage of the next step starts at a file.
"""
from __future__ import annotations

import contextlib
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from covenant.session import ensure_checkpoint_dir

#: stands for a null identifier inside an operator (it sorts first); null again in the result
NULL_ID = -(2 ** 63)

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_SHIPPED: dict[str, tempfile.TemporaryDirectory] = {}


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application, as
    ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.TemporaryDirectory()  # Spark serves the file from here until the driver ends
    archive = Path(folder.name, f"{package.name}-{context.applicationId}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED[context.applicationId] = folder


_BATCH, _BATCH_DEFAULT, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 16 << 20


def on_workers(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with this package at hand. Record batches of long texts
    are held several times over in a task; unless the session says otherwise
    they are a quarter of Spark's default."""
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get(_BATCH, None) in (f"{_BATCH_DEFAULT}b", str(_BATCH_DEFAULT)):
        spark.conf.set(_BATCH, f"{_BATCH_BYTES}b")
    return df.mapInArrow(function, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/covenant-llm/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffle_files_dropped(spark: SparkSession):
    """Shuffle files of the writes inside go when their write has ended (the
    written table replaces them)."""
    old = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, old)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again (zstd: these tables
    hold whole texts, and lie there until the cluster's retention deletes them)."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with shuffle_files_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hash_sample(df: DataFrame, order: list[str], k: int, group: str | None = None) -> DataFrame:
    """At most ``k`` rows (of each ``group``), those least by a hash of the
    ``order`` columns, with their ``_rank``. Rows are counted first and only
    hashes below a bound that some 4k rows keep are ranked, so what is ranked
    does not grow with the table."""
    top = 1 << 40
    if group is None:
        share = F.lit(min(1.0, 4 * k / max(1, df.count())))
    else:
        counts = df.groupBy(group).count().collect()
        if not counts:
            return df.withColumn("_rank", F.lit(0)).limit(0)
        share = F.create_map(*[x for r in counts for x in (F.lit(r[0]), F.lit(min(1.0, 4 * k / r[1])))])[F.col(group)]
    some = df.withColumn("_u", F.pmod(F.xxhash64(*order), F.lit(top))).filter(F.col("_u") < share * F.lit(float(top)))
    ranked = Window.partitionBy(group if group else F.lit(0)).orderBy("_u", *order)
    return some.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= k).drop("_u")


def whole_text(name: str = "text") -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def long_id(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def id_or_null(name: str) -> Column:
    return F.when(F.col(name) != NULL_ID, F.col(name))


def salted_left_join(big: DataFrame, small: DataFrame, keys: list[str], spread: Column,
                     salts: int = 16) -> DataFrame:
    """Left join of many rows to at most one row per key. Every row of
    ``small`` is repeated once per salt and every row of ``big`` picks one
    by ``spread``, so the rows of a hot key meet in ``salts`` tasks."""
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, [*keys, "_salt"], "left").drop("_salt")


def slices(batch: pa.RecordBatch, column: str, max_bytes: int):
    """Row ranges of a batch whose ``column`` holds about ``max_bytes``; one
    row at least, however long it is."""
    col = batch.column(column)
    if not len(col):
        return
    sizes = pc.fill_null(pc.binary_length(col), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [b or b"" for b in batch.column(column).cast(pa.binary()).to_pylist()]


def pylist(batch: pa.RecordBatch, column: str) -> list:
    return batch.column(column).to_pylist()


