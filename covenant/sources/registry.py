"""Contract registry, warehouse inventory and column catalog as DataFrames.

The registry is a table of contract rows; every registry operator (lint,
plan, upsert, delete, coverage, schema conformance across tables) is a
DataFrame job over it, so a registry of millions of tables is processed
like any other table.

``contracts_from_part`` / ``inventory_from_data`` / ``catalog_columns_from_part``
derive a governed warehouse from the driver's tables (one contract per
part, with deterministic defects), so these operators run on data whose
size grows with the input.
"""

from __future__ import annotations

import os
import random
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from covenant.functions.literals import local_rows
from covenant.functions.text import is_identifier
from covenant.operators.checks import as_of_col
from covenant.plans.contracts import (
    CHECK_INTERVAL_RANGE, COLUMN_TYPES, CONTRACT_SCHEMA, MAX_DELAY_RANGE, NAME_MAX_LENGTH,
    RULE_TYPES, SEVERITIES, VERSION_PATTERN, ACCEPTED_SPARK_TYPES,
)
from covenant.sources.tables import read_table

KEYS = ["table_name", "schema_name"]

# Spark type a column of each contract type has when it conforms.
CONFORMING_SPARK_TYPE = {
    "string": "string", "integer": "bigint", "float": "double", "boolean": "boolean",
    "date": "date", "timestamp": "timestamp", "decimal": "decimal", "text": "string",
    "uuid": "string",
}


def _types_array() -> Column:
    return F.array(*[F.lit(t) for t in COLUMN_TYPES])


def contracts_from_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One contract per part row (table ``t_<partkey>``), with defects:
    invalid names, empty owners, bad versions and types, unknown rule types
    and severities, missing parameters, out-of-range SLAs."""
    p = read_table(spark, sf_dir, "part")
    pk = F.col("p_partkey")
    w = F.split(F.col("p_name"), " ")
    w0, w1 = F.element_at(w, 1), F.element_at(w, 2)
    types = _types_array()
    col = lambda name, typ, nullable, pkey: F.struct(
        name.alias("name"), typ.alias("type"), nullable.alias("nullable"),
        F.lit(None).cast("string").alias("description"), pkey.alias("primary_key"))
    columns = F.array(
        col(F.lit("id"), F.lit("integer"), F.lit(False), F.lit(True)),
        col(w0, F.element_at(types, (pk % 9 + 1).cast("int")), F.lit(True), F.lit(False)),
        col(F.when(pk % 29 == 0, F.concat(w1, F.lit("-x"))).otherwise(w1),
            F.when(pk % 23 == 0, F.lit("varchar2"))
             .otherwise(F.element_at(types, ((pk + 1) % 9 + 1).cast("int"))),
            pk % 2 == 0, F.lit(False)),
        col(F.lit("updated_at"), F.lit("timestamp"), F.lit(False), F.lit(False)),
    )
    rule = lambda rt, c, params, sev: F.struct(
        rt.alias("rule_type"), c.cast("string").alias("column"), params.alias("parameters"),
        sev.alias("severity"), F.lit(None).cast("string").alias("description"))
    rules = F.array(
        rule(F.lit("not_null"), F.lit("id"), F.lit("{}"), F.lit("error")),
        rule(F.lit("min_value"), w0,
             F.when(pk % 43 == 0, F.lit("{}"))
              .otherwise(F.to_json(F.struct(F.col("p_size").alias("value")))), F.lit("warning")),
        rule(F.lit("accepted_values"), w1,
             F.to_json(F.struct(F.array(F.lower("p_type"), F.lit("other")).alias("values"))),
             F.lit("error")),
        rule(F.when(pk % 31 == 0, F.lit("not_a_rule")).otherwise(F.lit("row_count_min")),
             F.lit(None), F.lit('{"min_count": 1}'),
             F.when(pk % 37 == 0, F.lit("fatal")).otherwise(F.lit("warning"))),
    )
    freshness = F.when(F.col("p_size") % 3 == 0, F.lit(None)).otherwise(F.struct(
        F.lit("updated_at").alias("timestamp_column"),
        F.when(pk % 41 == 0, F.lit(0)).otherwise(F.col("p_size") * 60).cast("bigint").alias("max_delay_minutes"),
        F.lit(60).cast("bigint").alias("check_interval_minutes")))
    out = p.select(
        F.when(pk % 13 == 0, F.concat(F.lit("T-"), pk.cast("string")))
         .otherwise(F.concat(F.lit("t_"), pk.cast("string"))).alias("table_name"),
        F.when(F.col("p_size") % 2 == 0, F.lit("public")).otherwise(F.lit("sales")).alias("schema_name"),
        F.when(pk % 17 == 0, F.lit("")).otherwise(F.col("p_brand")).alias("owner"),
        F.col("p_type").alias("description"),
        F.when(pk % 19 == 0, F.lit("1.0"))
         .otherwise(F.concat(F.lit("1."), F.col("p_size").cast("string"), F.lit(".0"))).alias("version"),
        columns.alias("columns"), rules.alias("quality_rules"), freshness.alias("freshness"),
        F.array(F.lower("p_type")).alias("tags"),
    )
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CONTRACT_SCHEMA.fields])


def inventory_from_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """information_schema.tables analogue: part tables (every fifth a view),
    supplier staging tables without contracts, and system tables."""
    p = read_table(spark, sf_dir, "part")
    pk = F.col("p_partkey")
    parts = p.select(
        F.when(F.col("p_size") % 2 == 0, F.lit("public")).otherwise(F.lit("sales")).alias("table_schema"),
        F.lower(F.when(pk % 13 == 0, F.concat(F.lit("T-"), pk.cast("string")))
                .otherwise(F.concat(F.lit("t_"), pk.cast("string")))).alias("table_name"),
        F.when(pk % 5 == 0, F.lit("VIEW")).otherwise(F.lit("BASE TABLE")).alias("table_type"))
    s = read_table(spark, sf_dir, "supplier").select(
        F.lit("staging").alias("table_schema"),
        F.concat(F.lit("s_"), F.col("s_suppkey").cast("string")).alias("table_name"),
        F.lit("BASE TABLE").alias("table_type"))
    n = read_table(spark, sf_dir, "nation").select(
        F.lit("pg_catalog").alias("table_schema"),
        F.concat(F.lit("pg_"), F.lower(F.col("n_name"))).alias("table_name"),
        F.lit("BASE TABLE").alias("table_type"))
    return parts.unionByName(s).unionByName(n)


def catalog_columns_from_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """information_schema.columns analogue for the part tables: the second
    column drifts to another type on every 7th table and the third is
    missing on every 11th."""
    p = read_table(spark, sf_dir, "part")
    pk = F.col("p_partkey")
    w = F.split(F.col("p_name"), " ")
    conform = F.create_map(*[x for k, v in CONFORMING_SPARK_TYPE.items() for x in (F.lit(k), F.lit(v))])
    t1 = F.element_at(_types_array(), (pk % 9 + 1).cast("int"))
    t2 = F.element_at(_types_array(), ((pk + 1) % 9 + 1).cast("int"))
    c = lambda pos, name, typ: F.struct(
        F.lit(pos).alias("ordinal_position"), name.alias("column_name"), typ.alias("data_type"))
    cols = F.array(
        c(1, F.lit("id"), F.lit("bigint")),
        c(2, F.element_at(w, 1),
          F.when(pk % 7 == 0, F.when(t1 == "integer", F.lit("string")).otherwise(F.lit("int")))
           .otherwise(F.element_at(conform, t1))),
        c(3, F.when(pk % 11 == 0, F.lit(None)).otherwise(F.element_at(w, 2)),
          F.element_at(conform, t2)),
        c(4, F.lit("updated_at"), F.lit("timestamp")),
    )
    return p.select(
        F.when(F.col("p_size") % 2 == 0, F.lit("public")).otherwise(F.lit("sales")).alias("table_schema"),
        F.lower(F.when(pk % 13 == 0, F.concat(F.lit("T-"), pk.cast("string")))
                .otherwise(F.concat(F.lit("t_"), pk.cast("string")))).alias("table_name"),
        F.explode(F.filter(cols, lambda x: x["column_name"].isNotNull())).alias("c"),
    ).select("table_schema", "table_name", "c.ordinal_position", "c.column_name", "c.data_type")


# ------------------------------------------------------------------ LINT1

def _err(cond: Column, path: Column | str, message: Column | str) -> Column:
    return F.when(cond, F.struct(
        (F.lit(path) if isinstance(path, str) else path).alias("path"),
        (F.lit(message) if isinstance(message, str) else message).alias("error")))


def _errors(df: DataFrame, keys: list[str], errs: list[Column]) -> DataFrame:
    return (df.select(*keys, F.explode(F.array(*errs)).alias("e"))
              .filter(F.col("e").isNotNull()).select(*keys, "e.path", "e.error"))


def lint_contracts(contracts: DataFrame) -> DataFrame:
    """LINT1 (FN11 identifiers, FN12 enums/patterns/ranges): every
    validation error of every contract, as rows (table_name, schema_name,
    path, error). The reference stops at the first error of a file; here
    all are reported in one pass. Top-level fields are plain column
    predicates; columns and rules are ``posexplode``d so every predicate
    stays in generated code (no interpreted lambdas)."""
    tn, owner, ver = F.col("table_name"), F.col("owner"), F.col("version")
    fr = F.col("freshness")
    top = _errors(contracts, KEYS, [
        _err(F.coalesce(F.length(tn), F.lit(0)) == 0, "table_name", "required"),
        _err((F.length(tn) > 0) & ~is_identifier(tn), "table_name", "invalid characters"),
        _err(F.length(tn) > NAME_MAX_LENGTH, "table_name", "too long"),
        _err(F.coalesce(F.length(owner), F.lit(0)) == 0, "owner", "required"),
        _err(~F.coalesce(ver.rlike(VERSION_PATTERN), F.lit(False)), "version", "invalid version"),
        _err(F.coalesce(F.size("columns"), F.lit(0)) <= 0, "columns", "at least one column required"),
        _err(fr.isNotNull() & ~F.col("freshness.max_delay_minutes").between(*MAX_DELAY_RANGE),
             "freshness.max_delay_minutes", "out of range"),
        _err(fr.isNotNull() & ~F.col("freshness.check_interval_minutes").between(*CHECK_INTERVAL_RANGE),
             "freshness.check_interval_minutes", "out of range"),
        _err(fr.isNotNull() & ~is_identifier(F.col("freshness.timestamp_column")),
             "freshness.timestamp_column", "invalid characters"),
    ])
    cols = contracts.select(*KEYS, F.posexplode("columns").alias("i", "c"))
    c = lambda f: F.col(f"c.{f}")
    col_errs = _errors(cols, KEYS, [
        _err(~is_identifier(c("name")), F.format_string("columns[%d].name", "i"), "invalid characters"),
        _err(~F.coalesce(c("type").isin(*COLUMN_TYPES), F.lit(False)), F.format_string("columns[%d].type", "i"),
             F.concat(F.lit("invalid column type "), F.coalesce(c("type"), F.lit("null")))),
    ])
    rules = contracts.select(*KEYS, F.posexplode("quality_rules").alias("i", "r"))
    r = lambda f: F.col(f"r.{f}")
    rt = r("rule_type")

    def needs(key):
        return F.get_json_object(r("parameters"), f"$.{key}").isNull()

    path = lambda suffix: F.format_string(f"quality_rules[%d]{suffix}", "i")
    rule_errs = _errors(rules, KEYS, [
        _err(~F.coalesce(rt.isin(*RULE_TYPES), F.lit(False)), path(".rule_type"),
             F.concat(F.lit("invalid rule type "), F.coalesce(rt, F.lit("null")))),
        _err(~F.coalesce(r("severity").isin(*SEVERITIES), F.lit(False)), path(".severity"), "invalid severity"),
        _err(rt.isin("min_value", "max_value") & needs("value"), path(".parameters.value"), "required"),
        _err((rt == "accepted_values") & needs("values"), path(".parameters.values"), "required"),
        _err((rt == "regex_match") & needs("pattern"), path(".parameters.pattern"), "required"),
        _err((rt == "referential_integrity") & (needs("reference_table") | needs("reference_column")),
             path(".parameters"), "reference_table and reference_column required"),
        _err((rt == "custom_sql") & needs("expression") & needs("sql"),
             path(".parameters"), "expression or sql required"),
    ])
    return top.unionByName(col_errs).unionByName(rule_errs)


def valid_contracts(contracts: DataFrame) -> DataFrame:
    """Contracts without lint errors (left anti-join on the keys)."""
    return contracts.join(lint_contracts(contracts).select(*KEYS).distinct(), KEYS, "left_anti")


# ------------------------------------------------------- summaries (PRJ1, FIL10)

def contract_summary(contracts: DataFrame) -> DataFrame:
    """PRJ1: the API's contract summary projection, ordered by table (SRC8)."""
    return contracts.select(
        *KEYS, "owner", "version",
        F.size("columns").alias("column_count"), F.size("quality_rules").alias("rule_count"),
        F.col("freshness").isNotNull().alias("has_freshness_sla"),
        F.array_join("tags", ",").alias("tags"))


def required_columns(contracts: DataFrame) -> DataFrame:
    """FIL10: non-nullable and primary-key columns per contract."""
    return contracts.select(
        *KEYS,
        F.transform(F.filter("columns", lambda c: ~c["nullable"]), lambda c: c["name"]).alias("required_columns"),
        F.transform(F.filter("columns", lambda c: c["primary_key"]), lambda c: c["name"]).alias("primary_key_columns"))


# ------------------------------------------------------------ SINK1 / SINK2

def upsert(current: DataFrame, incoming: DataFrame, as_of=None) -> DataFrame:
    """SINK1: register contracts on (table_name, schema_name). Updated rows
    keep ``created_at`` and get ``updated_at = as_of``; new rows get both;
    untouched rows stay as they were. Columns that only one side has stay too:
    a stored column that the batch lacks keeps its values. A full outer join on the keys (both
    sides hash-partitioned on them). The caller writes the result as a new
    snapshot and switches to it (never overwrite the table being read)."""
    from covenant.operators.latest import latest_per_key
    now = as_of_col(as_of).cast("timestamp_ntz")
    cur = current
    if "created_at" not in cur.columns:
        cur = cur.withColumn("created_at", now).withColumn("updated_at", now)
    inc = incoming.drop("created_at", "updated_at")
    # one incoming contract per key: a key repeated in the batch neither
    # multiplies rows nor piles up in one join task. The highest version wins,
    # its three numbers compared as numbers; versions that are none come last
    if "version" in inc.columns:
        numbers = F.split("version", r"\.")
        order = [F.get(numbers, F.lit(i)).try_cast("bigint").desc_nulls_last() for i in range(3)] + [F.col("version").desc_nulls_last()]
    else:
        order = [F.lit(0)]
    tie = [("owner", "asc", "last")] if "owner" in inc.columns else []
    inc = latest_per_key(inc, KEYS, order, tie)
    # columns of both sides: what the store holds and the batch lacks stays, what
    # only the batch has is null in rows that it does not touch
    stamps = ["created_at", "updated_at"]
    types = {f.name: f.dataType for f in (*inc.schema.fields, *cur.schema.fields)}
    data_cols = [c for c in dict.fromkeys([*cur.columns, *inc.columns]) if c not in KEYS + stamps]

    def side(df: DataFrame, mark: str, names: list[str]) -> DataFrame:
        held = [(F.col(x) if x in df.columns else F.lit(None).cast(types[x])).alias(f"{mark}_{x}") for x in names]
        return df.select(*KEYS, *held, F.lit(True).alias(f"_in_{mark}"))

    j = side(cur, "c", data_cols + stamps).join(side(inc, "i", data_cols), KEYS, "full")
    came = F.col("_in_i").isNotNull()
    return j.select(
        *KEYS,
        *[(F.when(came, F.col(f"i_{x}")).otherwise(F.col(f"c_{x}")) if x in inc.columns else F.col(f"c_{x}")).alias(x) for x in data_cols],
        F.coalesce(F.col("c_created_at"), now).alias("created_at"),
        F.when(came, now).otherwise(F.col("c_updated_at")).alias("updated_at"),
        F.when(came & F.col("_in_c"), "updated").when(came, "inserted").otherwise("kept").alias("action"))


def delete(current: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SINK2: (remaining registry, per requested key whether a row went)."""
    remaining = current.join(keys.select(*KEYS).distinct(), KEYS, "left_anti")
    hit = current.select(*KEYS).distinct().withColumn("_hit", F.lit(True))
    report = keys.select(*KEYS).distinct().join(hit, KEYS, "left").select(
        *KEYS, F.coalesce("_hit", F.lit(False)).alias("deleted"))
    return remaining, report


# ------------------------------------------------------------ SINK6 / SINK7

def insert_ignore(target: DataFrame, incoming: DataFrame, key: str,
                  order: Column | None = None) -> DataFrame:
    """SINK6: incoming rows whose key is not in the target (ON CONFLICT DO
    NOTHING); among incoming duplicates the first under ``order`` wins.
    NULL keys never conflict (SQL UNIQUE semantics)."""
    from covenant.operators.latest import latest_per_key
    nonnull = incoming.filter(F.col(key).isNotNull())
    first = latest_per_key(nonnull, [key], [order if order is not None else F.col(key).asc()])
    fresh = first.join(target.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return fresh.unionByName(incoming.filter(F.col(key).isNull()))


def insert_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """SINK7: column defaults for NULL values (generated id, 'pending',
    current time). Where the default is text and the column is not (a
    generated id for a numeric key), the column becomes text."""
    out = df
    for c, expr in defaults.items():
        if c not in df.columns:
            out = out.withColumn(c, expr)
            continue
        text = isinstance(df.select(expr.alias("d")).schema["d"].dataType, StringType)
        own = F.col(c).cast("string") if text and not isinstance(df.schema[c].dataType, StringType) else F.col(c)
        out = out.withColumn(c, F.coalesce(own, expr))
    return out


# ----------------------------------------------------- schema checks at scale

def accepted_types(spark: SparkSession) -> DataFrame:
    """Contract type -> accepted Spark type names (fixed, 19 rows)."""
    return local_rows(spark, [(k, t) for k, ts in ACCEPTED_SPARK_TYPES.items() for t in ts],
                      "contract_type string, data_type string")


def schema_checks_many(spark: SparkSession, contracts: DataFrame, inventory: DataFrame,
                       columns: DataFrame) -> DataFrame:
    """CHK1 + CHK2 + CHK5 for every contract at once (JOIN3 as a join, not a
    loop). Contract columns are flagged with table existence by one left
    join against the inventory's distinct table keys, then left-joined to
    the catalog's columns on (schema, table, column); a missing table yields
    one failed ``table_exists`` row. Inventory and catalog grow with the
    warehouse, and their sizes before they are built are guesses (a compressed
    file's, not counting exploded columns): both joins are merge joins, never a
    broadcast through the driver. The accepted-type table is fixed-size, so its
    broadcast is bounded."""
    tables = (inventory.select(F.col("table_schema").alias("schema_name"), "table_name").distinct()
              .withColumn("_exists", F.lit(True)))
    exp = contracts.select(F.lower("table_name").alias("table_name"), "schema_name",
                           F.explode_outer("columns").alias("c")).select(
        *KEYS, F.lower(F.col("c.name")).alias("column"), F.col("c.type").alias("contract_type"))
    flagged = exp.join(tables.hint("merge"), KEYS, "left")
    missing = flagged.filter(F.col("_exists").isNull()).select(*KEYS).distinct().select(
        *KEYS, F.lit("table_exists").alias("check_type"), F.lit(None).cast("string").alias("column"),
        F.lit("failed").alias("status"), F.lit(None).cast("string").alias("expected_value"),
        F.lit(None).cast("string").alias("actual_value"))
    act = columns.select(F.col("table_schema").alias("schema_name"), "table_name",
                         F.col("column_name").alias("column"), "data_type")
    j = (flagged.filter(F.col("_exists") & F.col("column").isNotNull()).drop("_exists")
         .join(act.hint("merge"), KEYS + ["column"], "left"))
    ok_types = accepted_types(spark).withColumn("_ok", F.lit(True))
    j = j.join(F.broadcast(ok_types), ["contract_type", "data_type"], "left")
    checks = j.select(*KEYS, "column", "contract_type", "data_type", F.explode(F.array(
        F.struct(F.lit("column_exists").alias("check_type"),
                 F.when(F.col("data_type").isNotNull(), "passed").otherwise("failed").alias("status"),
                 F.lit(None).cast("string").alias("expected_value"),
                 F.lit(None).cast("string").alias("actual_value")),
        F.when(F.col("data_type").isNotNull(), F.struct(
            F.lit("column_type").alias("check_type"),
            F.when(F.col("_ok"), "passed").otherwise("failed").alias("status"),
            F.col("contract_type").alias("expected_value"), F.col("data_type").alias("actual_value"))),
    )).alias("k")).filter(F.col("k").isNotNull()).select(
        *KEYS, "k.check_type", "column", "k.status", "k.expected_value", "k.actual_value")
    return missing.unionByName(checks)


def missing_columns_many(contracts: DataFrame, columns: DataFrame) -> DataFrame:
    """CHK8 at scale: expected contract columns absent from the catalog. Merge
    joins, as in ``schema_checks_many``: the catalog is never broadcast."""
    exp = contracts.select(F.lower("table_name").alias("table_name"), "schema_name",
                           F.explode("columns").alias("c")).select(
        *KEYS, F.lower(F.col("c.name")).alias("column_name"))
    act = columns.select(F.col("table_schema").alias("schema_name"), "table_name", "column_name")
    tables = act.select(*KEYS).distinct()
    return (exp.join(tables.hint("merge"), KEYS, "left_semi").join(act.hint("merge"), KEYS + ["column_name"], "left_anti")
               .withColumnRenamed("column_name", "missing_column"))



# ------------------------------------------------------------ SRC7 / SRC8

def resolve_contracts(registry: DataFrame, files: DataFrame) -> DataFrame:
    """SRC7 for a whole set of keys: the registered contract, or — when a
    table has none — the contract from the definition files (which the
    caller then registers with ``upsert``). Registry wins; the file side is
    an anti-join against it. ``source`` tells which side answered."""
    reg = registry.withColumn("source", F.lit("registry"))
    fallback = files.join(registry.select(*KEYS).distinct(), KEYS, "left_anti") \
        .withColumn("source", F.lit("file"))
    return reg.unionByName(fallback, allowMissingColumns=True)


def get_contract(contracts: DataFrame, table_name: str, schema_name: str = "public") -> DataFrame:
    """FIL2 / SRC7: one contract by key (a pushed-down equality filter)."""
    return contracts.filter((F.col("table_name") == table_name) & (F.col("schema_name") == schema_name))


def list_contracts(contracts: DataFrame) -> DataFrame:
    """SRC8: all contracts ordered by table name."""
    return contracts.orderBy("table_name", "schema_name")


def materialise(df: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """SINK5: write a model as a table (Parquet) and read it back, so later
    jobs start from the files instead of re-running the model. Write to a
    new path, then switch readers to it; never overwrite the path being
    read."""
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.parquet(path)


# ------------------------------------------------- versioned snapshots

def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class Conflict(RuntimeError):
    """Another writer committed the version that this one meant to."""


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file that is not there yet; False if it is. One of
    several writers succeeds. On a local file system a finished file is
    linked to the name (fails if it exists); elsewhere the store's own
    exclusive create decides."""
    fs, p = _fs(spark, path)
    if not fs.exists(p.getParent()):
        fs.mkdirs(p.getParent())
    if fs.getScheme() == "file":
        target = p.toUri().getPath()
        own = f"{os.path.dirname(target)}/.{uuid.uuid4().hex}"
        with open(own, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(own, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(own)
        return True
    try:
        out = fs.create(p, False)
    except Py4JJavaError as exc:
        if fs.exists(p):
            return False
        raise exc
    out.write(bytearray(text, "utf-8"))
    out.close()
    return True


def commits(spark: SparkSession, root: str) -> dict[int, str]:
    """Version -> data folder of the commits below ``root``. A commit file that
    is empty (its writer died between creating and filling it) counts as a
    version that holds nothing new: it is passed over in reading."""
    fs, p = _fs(spark, f"{root.rstrip('/')}/_commits")
    out = {}
    if fs.exists(p):
        for st in fs.listStatus(p):
            name = st.getPath().getName()
            if name.isdigit():
                stream = fs.open(st.getPath())
                out[int(name)] = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
                stream.close()
    return out


def snapshot_versions(spark: SparkSession, root: str) -> list[int]:
    """Committed snapshot versions under ``root``."""
    return sorted(v for v, folder in commits(spark, root).items() if folder)


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """The newest committed snapshot, or that of a version (None when there is none)."""
    found = {v: f for v, f in commits(spark, root).items() if f and (version is None or v == version)}
    return spark.read.parquet(f"{root.rstrip('/')}/{found[max(found)]}") if found else None


def commit_snapshot(df: DataFrame, root: str, after: int | None = None) -> int:
    """Write a snapshot beside the others and commit it as the next version:
    the one after ``after`` (the version that ``df`` was made from; 0: none),
    else after the newest. Readers keep the version that they resolved; the new
    one is visible once its commit file exists. If another writer committed
    that version first, nothing is changed and Conflict is raised."""
    spark, root = df.sparkSession, root.rstrip("/")
    folder = f"data-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(f"{root}/{folder}")
    version = (max(commits(spark, root), default=0) if after is None else after) + 1
    if not put_if_absent(spark, f"{root}/_commits/{version:020d}", folder):
        fs, p = _fs(spark, f"{root}/{folder}")
        fs.delete(p, True)  # written by this call, and nothing refers to it
        raise Conflict(f"version {version} of {root} was committed by another writer")
    return version


def change_snapshot(spark: SparkSession, root: str, change: Callable[[DataFrame | None], DataFrame], tries: int = 20) -> int:
    """SINK1/SINK2/SINK4 with several writers: read the newest version, commit
    ``change`` of it as the next; if another writer was first, do it again on what
    that one wrote. No change is lost, and each sees those before it."""
    for i in range(tries):
        base = max(commits(spark, root), default=0)
        try:
            return commit_snapshot(change(read_snapshot(spark, root)), root, after=base)
        except Conflict:
            if i + 1 == tries:
                raise
            time.sleep(random.uniform(0, 0.05 * 2 ** min(i, 6)))
    raise Conflict(root)
