"""Table sources: the driver's Parquet tables and a small path registry.

Every loader returns a lazy DataFrame; column pruning and filter pushdown
reach the Parquet scan because nothing here forces a projection of all
columns or an action.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """SRC1/SRC2: Parquet scan of one base table, listed anew on each call."""
    return spark.read.parquet(table_path(sf_dir, name))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, asked of the file system that it names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def table_exists(spark: SparkSession, name: str, sf_dir: str | None = None) -> bool:
    """SRC4/JOIN5: existence probe by catalog name or Parquet path."""
    return path_exists(spark, table_path(sf_dir, name)) if sf_dir is not None else spark.catalog.tableExists(name)


def data_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modified) of the Parquet files of a folder, listed by
    Spark; their contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", "length", F.unix_micros("modificationTime").alias("modified"))


DEFAULT_SCHEMA = "public"


class TableSet:
    """Named DataFrames a contract run may reference (its own table and
    the targets of referential-integrity rules), by schema and table. A name
    without a schema is in ``public``. ``find(schema, table)`` is asked for
    tables that are not held."""

    def __init__(self, tables: dict[str, DataFrame] | None = None,
                 find: Callable[[str, str], DataFrame | None] | None = None):
        self._find = find
        self._tables: dict[tuple[str, str], DataFrame] = {}
        for name, df in (tables or {}).items():
            self.add(name, df)

    @staticmethod
    def _key(name: str, schema: str | None) -> tuple[str, str]:
        head, dot, tail = name.rpartition(".")
        return (schema or (head if dot else DEFAULT_SCHEMA), tail if dot else name)

    def add(self, name: str, df: DataFrame, schema: str | None = None) -> "TableSet":
        self._tables[self._key(name, schema)] = df
        return self

    def get(self, name: str, schema: str | None = None) -> DataFrame | None:
        key = self._key(name, schema)
        df = self._tables.get(key)
        return self._find(*key) if df is None and self._find is not None else df

    def reference(self, name: str, schema: str = DEFAULT_SCHEMA) -> DataFrame | None:
        """The table that a rule of a contract in ``schema`` names: with its
        schema, or in the contract's own schema, or in ``public``."""
        if "." in name:
            return self.get(name)
        own = self.get(name, schema)
        return own if own is not None else self.get(name)

    def __contains__(self, name: str) -> bool:
        return self._key(name, None) in self._tables

    def names(self) -> list[str]:
        return sorted(t if s == DEFAULT_SCHEMA else f"{s}.{t}" for s, t in self._tables)

    def keys(self) -> list[tuple[str, str]]:
        """(schema, table) of each."""
        return sorted(self._tables)


def write_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int,
                   mode: str = "overwrite") -> DataFrame:
    """Store a governed table bucketed (and sorted) on its join key. Checks
    that run every cycle on that key (referential integrity, uniqueness,
    latest-per-key) then read it already hash-partitioned: the aggregate
    and the join need no exchange when both sides share the bucketing.
    ``buckets`` should give partitions of a few hundred MB at full size."""
    (df.write.mode(mode).format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
       .saveAsTable(table))
    return df.sparkSession.table(table)
