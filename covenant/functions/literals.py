"""Small literal tables built JVM-side.

``spark.createDataFrame(list)`` plans a Python RDD scan, so executors would
need Python workers just to read a handful of literal rows. Here the rows
are literal structs passed through ``inline``; Catalyst folds that into a
``LocalRelation`` and the whole plan stays in the JVM.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def literal(value, dt: T.DataType) -> Column:
    """A typed literal for ``value`` (structs, arrays and NULLs included)."""
    if value is None:
        return F.lit(None).cast(dt)
    if isinstance(dt, T.StructType):
        if isinstance(value, Mapping):
            vals = [value.get(f.name) for f in dt.fields]
        else:
            vals = list(value)
        return F.struct(*[literal(v, f.dataType).alias(f.name) for v, f in zip(vals, dt.fields)])
    if isinstance(dt, T.ArrayType):
        if not value:
            return F.array().cast(dt)
        return F.array(*[literal(v, dt.elementType) for v in value])
    return F.lit(value).cast(dt)


def _jsonable(value, dt: T.DataType):
    if value is None:
        return None
    if isinstance(dt, T.StructType):
        vals = [value.get(f.name) for f in dt.fields] if isinstance(value, Mapping) else list(value)
        return {f.name: _jsonable(v, f.dataType) for v, f in zip(vals, dt.fields)}
    if isinstance(dt, T.ArrayType):
        return [_jsonable(v, dt.elementType) for v in value]
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return value.isoformat() if hasattr(value, "isoformat") else str(value)
    if isinstance(dt, T.DecimalType):
        return str(value)
    return value


def local_rows(spark: SparkSession, rows: Sequence, schema: T.StructType | str) -> DataFrame:
    """A DataFrame of literal rows with an exact schema, planned in the JVM:
    the rows travel as one JSON literal that ``from_json`` decodes (folded
    to a local relation by the optimizer)."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    text = json.dumps([_jsonable(r, schema) for r in rows])
    arr = F.from_json(F.lit(text), T.ArrayType(schema))
    return spark.range(1).select(F.inline(arr)).select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
