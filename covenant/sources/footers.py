"""What Parquet footers know, read by Spark's tasks (SRC4-SRC6, AGG3, CHK3).

A footer holds a file's columns and types, its number of rows, and for each row
group the least and greatest value and the number of nulls. So the catalog of
many tables and a table's latest time need no scan of rows. Files are dealt over
the tasks; a task opens a file with pyarrow's file systems and reads its end.

A store that pyarrow cannot open, but Spark can, is no error: columns come from
Spark's own reader then, and a file whose footer was not read, or holds no
statistics for a row group, is scanned.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covenant.functions.literals import local_rows
from covenant.operators.checks import _field, spark_type_name
from covenant.sources.tables import data_files, path_exists

#: microseconds in the unit of a time column
_MICROS = {"MILLIS": 1000, "MICROS": 1}
_LISTED = "table_schema string, table_name string, file string, opened boolean"
_COLUMNS = "table_schema string, table_name string, file string, n_rows long, ordinal_position int, column_name string, data_type string, is_nullable boolean"


def _open(path: str):
    """(file system, path in it) of a path as Spark writes it (not URL-encoded)."""
    from urllib.parse import quote

    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe=":/@")) if "://" in path else (fs.LocalFileSystem(), path)


def listed(tables: DataFrame) -> DataFrame:
    """The data files of (table_schema, table_name, path): a row for each file; a
    row without a file where the path does not exist or holds none; ``opened`` is
    false where pyarrow has no way to the store."""
    def files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as pafs

        for frame in frames:
            out = []
            for schema, table, path in frame[["table_schema", "table_name", "path"]].itertuples(index=False):
                try:
                    store, root = _open(path)
                    info = store.get_file_info(root)
                except Exception:  # noqa: BLE001 - no way from here; the driver asks Spark
                    out.append((schema, table, None, False))
                    continue
                prefix = path[: len(path) - len(root)] if path.endswith(root) else ""
                found = [info] if info.type == pafs.FileType.File else [] if info.type == pafs.FileType.NotFound else \
                    store.get_file_info(pafs.FileSelector(root, recursive=True))
                names = [f.path for f in found if f.type == pafs.FileType.File and f.base_name.endswith(".parquet")
                         and not any(p.startswith(("_", ".")) for p in f.path[len(root):].split("/") if p)]
                out += [(schema, table, prefix + n, True) for n in sorted(names)] or [(schema, table, None, True)]
            yield pd.DataFrame(out, columns=["table_schema", "table_name", "file", "opened"])

    return tables.select("table_schema", "table_name", "path").mapInPandas(files, _LISTED)


def file_columns(files: DataFrame) -> DataFrame:
    """The columns of each file of ``listed``, from its footer."""
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_type

        for frame in frames:
            out = []
            for schema, table, file in frame[["table_schema", "table_name", "file"]].itertuples(index=False):
                store, path = _open(file)
                with store.open_input_file(path) as source:
                    meta = pq.read_metadata(source)
                for i, field in enumerate(meta.schema.to_arrow_schema()):
                    out.append((schema, table, file, meta.num_rows, i + 1, field.name, spark_type_name(from_arrow_type(field.type, True)), field.nullable))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _COLUMNS.split(", ")])

    return files.filter("file is not null").repartition("file").mapInPandas(read, _COLUMNS)


def catalog_scan(spark: SparkSession, tables: DataFrame) -> DataFrame:
    """SRC4/SRC5/SRC6 for (table_schema, table_name, path), any number of them: a
    row for each column of each table with its type in the newest file by name,
    the number of files and of files that have the column, and of its types; a
    row without a column for a table that is not found."""
    files = listed(tables)
    columns = file_columns(files).groupBy("table_schema", "table_name", "column_name").agg(
        F.max_by("ordinal_position", "file").alias("ordinal_position"), F.max_by("data_type", "file").alias("data_type"),
        F.max("is_nullable").alias("is_nullable"), F.count(F.lit(1)).alias("files_with"), F.count_distinct("data_type").alias("types"))
    sizes = files.groupBy("table_schema", "table_name").agg(F.count("file").alias("files"), F.max("opened").alias("opened"))
    out = sizes.join(columns, ["table_schema", "table_name"], "left").withColumn("found", F.col("files") > 0)
    names = ["table_schema", "table_name", "found", "ordinal_position", "column_name", "data_type", "is_nullable", "files", "files_with", "types"]
    closed = sizes.filter("not opened").join(tables, ["table_schema", "table_name"]).select("table_schema", "table_name", "path")
    rows = []
    for schema, table, path in closed.toLocalIterator():  # stores that only Spark opens
        if path_exists(spark, path):
            fields = spark.read.parquet(path).schema.fields
            rows += [(schema, table, True, i + 1, f.name, spark_type_name(f.dataType), f.nullable, None, None, None) for i, f in enumerate(fields)]
        else:
            rows.append((schema, table, False, *[None] * 7))
    known = out.filter("opened").select(*names)
    return known.unionByName(local_rows(spark, rows, known.schema)) if rows else known


# ----------------------------------------------------------------- freshness

_LATEST = "path string, known boolean, latest long"


def latest_values(files: DataFrame, column: str) -> DataFrame:
    """(path, known, latest) of each file of ``data_files``: the greatest value of
    a time column in microseconds since 1970 (null: no value). ``known`` is false
    where the footer was not read or does not tell."""
    def tell(file: str) -> tuple[bool, int | None]:
        import pyarrow.parquet as pq

        store, path = _open(file)
        with store.open_input_file(path) as source:
            meta = pq.read_metadata(source)
        place = [i for i in range(meta.num_columns) if meta.schema.column(i).path == column]
        if not place:
            return True, None  # the file lacks the column: null in every row
        kind = meta.schema.column(place[0])
        unit = kind.logical_type.to_json() if kind.logical_type is not None else ""
        if kind.physical_type == "INT32" and kind.logical_type.type == "DATE":
            scale = 86_400_000_000
        elif kind.physical_type == "INT64" and kind.logical_type.type == "TIMESTAMP":
            scale = next((m for name, m in _MICROS.items() if name.lower() in unit.lower()), None)
        else:
            scale = None
        if scale is None:
            return False, None
        best = None
        for g in range(meta.num_row_groups):
            chunk = meta.row_group(g).column(place[0])
            stats = chunk.statistics
            n = meta.row_group(g).num_rows
            if not n or stats is not None and stats.has_null_count and stats.null_count == n:
                continue
            if stats is None or not stats.has_min_max:
                return False, None
            top = stats.max_raw * scale
            best = top if best is None or top > best else best
        return True, best

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for file in frame["path"]:
                try:
                    out.append((file, *tell(file)))
                except Exception:  # noqa: BLE001 - the file is scanned then
                    out.append((file, False, None))
            yield pd.DataFrame({"path": [o[0] for o in out], "known": [o[1] for o in out], "latest": pd.array([o[2] for o in out], "Int64")})

    return files.select("path").repartition("path").mapInPandas(read, _LATEST)


def latest_time(spark: SparkSession, folder: str, column: str) -> tuple[DataFrame, int, int]:
    """(``last_updated_at`` as one row, files, files scanned): AGG3 from footers;
    only files whose footers do not tell are scanned, for this one column."""
    schema = spark.read.parquet(folder).schema
    told = latest_values(data_files(spark, folder), column).persist()
    micros = F.timestamp_add("MICROSECOND", F.max("latest"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    known = told.agg(micros.alias("at"))
    files, scan = told.count(), [r["path"] for r in told.filter("not known").select("path").toLocalIterator()]
    if scan:
        of_type = F.max(column).cast("timestamp_ntz")
        known = known.unionByName(spark.read.schema(schema).parquet(*scan).agg(of_type.alias("at")))
    return known.agg(F.max("at").alias("last_updated_at")), files, len(scan)


def freshness_from_footers(spark: SparkSession, folder: str, contract: dict, as_of=None) -> DataFrame:
    """CHK3 of a table that is a folder (or file) of Parquet: the result of
    ``freshness_result``, with the number of files and of those scanned."""
    from covenant.operators.freshness import freshness_result

    df = spark.read.parquet(folder) if path_exists(spark, folder) else None
    fresh = contract.get("freshness") or {}
    column = fresh.get("timestamp_column")
    field = _field(df, column) if df is not None and column else None
    if field is None or not isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return freshness_result(spark, df, contract, as_of).withColumns({"files": F.lit(0).cast("long"), "files_scanned": F.lit(0).cast("long")})
    last, files, scanned = latest_time(spark, folder, column)
    return freshness_result(spark, df, contract, as_of, last).withColumns({"files": F.lit(files).cast("long"), "files_scanned": F.lit(scanned).cast("long")})
