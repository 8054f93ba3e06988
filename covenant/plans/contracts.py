"""Contract documents: vocabulary, Spark schema, loading.

A contract is one row of a ``contracts`` DataFrame. Rule parameters are
heterogeneous, so they travel as a JSON string and are decoded per rule
type. Contract metadata is small (columns and rules of one table), so a
single contract may be held on the driver to plan its checks; many
contracts are processed as DataFrames (lint, plan, registry).
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values (must equal the reference's vocabulary) -------------
# Column types a contract may declare.
COLUMN_TYPES = ("string", "integer", "float", "boolean", "date", "timestamp",
                "decimal", "text", "uuid")
# Rule types a contract may declare.
RULE_TYPES = ("not_null", "unique", "accepted_values", "min_value", "max_value",
              "regex_match", "custom_sql", "row_count_min", "referential_integrity")
# Rule severities.
SEVERITIES = ("error", "warning")
# Check outcomes.
STATUSES = ("passed", "failed", "warning", "error", "skipped")
# Defaults filled on load.
DEFAULT_SCHEMA = "public"
DEFAULT_VERSION = "1.0.0"
DEFAULT_COLUMN_TYPE = "string"
DEFAULT_MAX_DELAY_MINUTES = 60
DEFAULT_CHECK_INTERVAL_MINUTES = 60
VERSION_PATTERN = r"^\d+\.\d+\.\d+$"
# Ranges of the freshness settings.
MAX_DELAY_RANGE = (1, 10080)
CHECK_INTERVAL_RANGE = (1, 1440)
NAME_MAX_LENGTH = 255
# -----------------------------------------------------------------------

# Spark type classes accepted for each contract type (the catalog's type
# names differ from PostgreSQL's; this is the Spark reading of the same
# classes).
ACCEPTED_SPARK_TYPES = {
    "string": ("string", "varchar", "char"),
    "text": ("string", "varchar"),
    "integer": ("tinyint", "smallint", "int", "bigint"),
    "float": ("float", "double"),
    "boolean": ("boolean",),
    "date": ("date",),
    "timestamp": ("timestamp", "timestamp_ntz"),
    "decimal": ("decimal",),
    "uuid": ("string",),
}

COLUMN_STRUCT = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("nullable", T.BooleanType()),
    T.StructField("description", T.StringType()),
    T.StructField("primary_key", T.BooleanType()),
])

RULE_STRUCT = T.StructType([
    T.StructField("rule_type", T.StringType()),
    T.StructField("column", T.StringType()),
    T.StructField("parameters", T.StringType()),  # JSON text
    T.StructField("severity", T.StringType()),
    T.StructField("description", T.StringType()),
])

FRESHNESS_STRUCT = T.StructType([
    T.StructField("timestamp_column", T.StringType()),
    T.StructField("max_delay_minutes", T.LongType()),
    T.StructField("check_interval_minutes", T.LongType()),
])

CONTRACT_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("schema_name", T.StringType()),
    T.StructField("owner", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("columns", T.ArrayType(COLUMN_STRUCT)),
    T.StructField("quality_rules", T.ArrayType(RULE_STRUCT)),
    T.StructField("freshness", FRESHNESS_STRUCT),
    T.StructField("tags", T.ArrayType(T.StringType())),
])

CONTRACTS_DIR = os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(
    os.path.abspath(__file__)))), "contracts")


def load_document(path: str) -> dict:
    with open(path, encoding="utf-8") as fh:
        return json.load(fh)


def sample_contract(name: str) -> dict:
    """The shipped sample contracts (``orders``, ``customers``)."""
    return normalise(load_document(os.path.join(CONTRACTS_DIR, f"{name}.json")))


def normalise(doc: dict) -> dict:
    """Fill the load defaults (Q20) and lower-case table and column names,
    as the contract model does. Validation is ``lint_contracts``."""
    d = dict(doc)
    d["table_name"] = (d.get("table_name") or "").lower()
    d.setdefault("schema_name", DEFAULT_SCHEMA)
    d.setdefault("version", DEFAULT_VERSION)
    d.setdefault("tags", [])
    d.setdefault("description", None)
    cols = []
    for c in d.get("columns") or []:
        c = dict(c)
        c["name"] = (c.get("name") or "").lower()
        c.setdefault("type", DEFAULT_COLUMN_TYPE)
        c.setdefault("nullable", True)
        c.setdefault("primary_key", False)
        c.setdefault("description", None)
        cols.append(c)
    d["columns"] = cols
    rules = []
    for r in d.get("quality_rules") or []:
        r = dict(r)
        r.setdefault("column", None)
        r["parameters"] = r.get("parameters") or {}
        r.setdefault("severity", "error")
        r.setdefault("description", None)
        rules.append(r)
    d["quality_rules"] = rules
    f = d.get("freshness")
    if f is not None:
        f = dict(f)
        f.setdefault("max_delay_minutes", DEFAULT_MAX_DELAY_MINUTES)
        f.setdefault("check_interval_minutes", DEFAULT_CHECK_INTERVAL_MINUTES)
        d["freshness"] = f
    else:
        d["freshness"] = None
    return d


def to_row(doc: dict) -> tuple:
    d = normalise(doc)
    cols = [(c["name"], c["type"], c["nullable"], c["description"], c["primary_key"])
            for c in d["columns"]]
    rules = [(r["rule_type"], r["column"], json.dumps(r["parameters"], sort_keys=True),
              r["severity"], r["description"]) for r in d["quality_rules"]]
    f = d["freshness"]
    fr = None if f is None else (f.get("timestamp_column"), f.get("max_delay_minutes"),
                                 f.get("check_interval_minutes"))
    return (d["table_name"], d["schema_name"], d.get("owner"), d["description"],
            d["version"], cols, rules, fr, list(d["tags"]))


def contracts_df(spark: SparkSession, docs: Iterable[dict]) -> DataFrame:
    """Contract documents -> contracts DataFrame (driver-sized input)."""
    from covenant.functions.literals import local_rows
    return local_rows(spark, [to_row(d) for d in docs], CONTRACT_SCHEMA)


def read_contract_dir(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """SRC9 (re-aimed): a folder of JSON contract documents, read by Spark
    with the declared schema (no inference); ``parameters`` objects decode
    into their JSON text. ``multi_line=False`` for files of one document a line."""
    raw_schema = T.StructType([
        f if f.name != "columns" else T.StructField("columns", T.ArrayType(COLUMN_STRUCT))
        for f in CONTRACT_SCHEMA.fields
    ])
    df = (spark.read.schema(raw_schema).option("multiLine", str(multi_line).lower())
          .option("pathGlobFilter", "*.json").json(path))
    return apply_defaults(df)


def apply_defaults(df: DataFrame) -> DataFrame:
    """Q20 defaults as column expressions (for contracts read as data)."""
    cols = F.transform(F.coalesce("columns", F.array()), lambda c: F.struct(
        F.lower(c["name"]).alias("name"),
        F.coalesce(c["type"], F.lit(DEFAULT_COLUMN_TYPE)).alias("type"),
        F.coalesce(c["nullable"], F.lit(True)).alias("nullable"),
        c["description"].alias("description"),
        F.coalesce(c["primary_key"], F.lit(False)).alias("primary_key")))
    rules = F.transform(F.coalesce("quality_rules", F.array()), lambda r: F.struct(
        r["rule_type"].alias("rule_type"), r["column"].alias("column"),
        F.coalesce(r["parameters"], F.lit("{}")).alias("parameters"),
        F.coalesce(r["severity"], F.lit("error")).alias("severity"),
        r["description"].alias("description")))
    fr = F.when(F.col("freshness").isNull(), F.lit(None).cast(FRESHNESS_STRUCT)).otherwise(
        F.struct(F.col("freshness.timestamp_column").alias("timestamp_column"),
                 F.coalesce("freshness.max_delay_minutes", F.lit(DEFAULT_MAX_DELAY_MINUTES))
                  .cast("bigint").alias("max_delay_minutes"),
                 F.coalesce("freshness.check_interval_minutes",
                            F.lit(DEFAULT_CHECK_INTERVAL_MINUTES))
                  .cast("bigint").alias("check_interval_minutes")))
    return df.select(
        F.lower("table_name").alias("table_name"),
        F.coalesce("schema_name", F.lit(DEFAULT_SCHEMA)).alias("schema_name"),
        "owner", "description",
        F.coalesce("version", F.lit(DEFAULT_VERSION)).alias("version"),
        cols.alias("columns"), rules.alias("quality_rules"), fr.alias("freshness"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
    )


def row_to_doc(row) -> dict:
    """A contracts-DataFrame row (already on the driver) back to a document."""
    d = row.asDict(recursive=True)
    for r in d.get("quality_rules") or []:
        r["parameters"] = json.loads(r["parameters"]) if r.get("parameters") else {}
    return d


def read_contract_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC9: contract documents as YAML (``*.yml``, ``*.yaml``) or JSON files, the
    way contract folders are usually kept. Files are read and decoded by
    Spark's tasks (YAML becomes JSON text there) and get the load defaults.
    Invalid documents still load; ``lint_contracts`` reports them."""
    def decoded(frames):
        import json

        import pandas
        import yaml

        for frame in frames:
            yield pandas.DataFrame({"doc": [json.dumps(yaml.safe_load(text) or {}, default=str) for text in frame["value"]]})

    # parameters stay JSON text: read as such from an object by the JSON reader
    parts = [spark.read.schema(CONTRACT_SCHEMA).option("multiLine", "true").option("pathGlobFilter", "*.json").json(path)]
    for pattern in ("*.yml", "*.yaml"):
        files = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
        if not files.isEmpty():
            text = files.mapInPandas(decoded, "doc string")
            parts.append(text.select(F.from_json("doc", CONTRACT_SCHEMA).alias("d")).select("d.*"))
    return apply_defaults(reduce(DataFrame.unionByName, parts))
