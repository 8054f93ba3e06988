"""Contract checks evaluated on data (CHK1-10, RUL1-9, VIO1).

Plan shape for one table:

* every row-level rule (not-null, accepted values, min, max, regex,
  custom predicate, row count) and the freshness MAX are folded into ONE
  aggregate: one scan of the pruned columns, partial aggregation per task,
  a single-row final merge;
* each uniqueness rule is one grouped count on its key columns (partial
  aggregation before the exchange, so a hot key ships one row per task);
* each referential-integrity rule pre-aggregates the foreign keys, then
  anti-joins distinct reference keys (both sides are key-distinct, so a hot
  foreign key cannot skew the join);
* schema checks come from the DataFrame's schema (metadata only).

All of it is one DataFrame (SET2: ``unionByName`` of the check families) so a
single action runs it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal, InvalidOperation
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covenant.functions.literals import local_rows
from covenant.functions.text import minutes_between
from covenant.plans.checkplan import CheckSpec, check_name, name_plan, plan_contract
from covenant.plans import vocabulary as V
from covenant.plans.contracts import ACCEPTED_SPARK_TYPES, normalise
from covenant.sources.tables import TableSet

CHECK_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("schema_name", T.StringType()),
    T.StructField("seq", T.IntegerType()),
    T.StructField("check_name", T.StringType()),
    T.StructField("check_type", T.StringType()),
    T.StructField("column", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("expected_value", T.StringType()),
    T.StructField("actual_value", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("violations", T.LongType()),
    T.StructField("message", T.StringType()),
])
CHECK_COLUMNS = [f.name for f in CHECK_SCHEMA.fields]

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)


def as_of_col(as_of) -> Column:
    """The evaluation time: a fixed instant (tests, replays) or now."""
    if as_of is None:
        return F.localtimestamp()
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, datetime):
        as_of = as_of.isoformat(sep=" ")
    return F.to_timestamp_ntz(F.lit(str(as_of)))


def spark_type_name(dt: T.DataType) -> str:
    if isinstance(dt, T.DecimalType):
        return "decimal"
    if isinstance(dt, (T.VarcharType, T.CharType)):
        return "varchar" if isinstance(dt, T.VarcharType) else "char"
    return dt.simpleString()


def type_matches(contract_type: str, dt: T.DataType) -> bool:
    """CHK2: is the Spark type in the contract type's accepted class."""
    return spark_type_name(dt) in ACCEPTED_SPARK_TYPES.get(contract_type, ())


#: the check that stands for a contract whose checks could not run at all
CONTRACT_ERROR = "contract_checks"


# ------------------------------------------------------------------ helpers

def _field(df: DataFrame, name: str) -> T.StructField | None:
    for f in df.schema.fields:
        if f.name == name:  # exact, case-sensitive (Q21)
            return f
    return None


class RuleError(ValueError):
    """A rule that cannot be judged on this table: one ERROR check."""


def _number(value) -> Decimal | None:
    """The bound as an exact number, or None."""
    if isinstance(value, bool) or value is None:
        return None
    try:
        d = Decimal(str(value).strip())
    except InvalidOperation:
        return None
    return d if d.is_finite() else None


def _instant(value) -> datetime | None:
    if isinstance(value, datetime):
        return value
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    try:
        return datetime.fromisoformat(str(value).strip())
    except ValueError:
        return None


def _out_of_range(df: DataFrame, spec: CheckSpec) -> Column:
    """RUL4/RUL5: TRUE where the value lies beyond the bound, compared in a
    type that holds both: a fractional bound stays fractional on a whole-number
    column. Text under a numeric bound is read as a number; text that is
    none is beyond any bound. A bound that does not convert is a RuleError."""
    if spec.params.get("value") is None:
        raise RuleError(f"{spec.check_type} needs parameters.value")
    value, dt, c = spec.params["value"], _field(df, spec.column).dataType, F.col(spec.column)
    beyond = (lambda x, b: x < b) if spec.check_type == "min_value" else (lambda x, b: x > b)
    number = _number(value)
    if isinstance(dt, _NUMERIC):
        if number is None:
            raise RuleError(f"{spec.check_type} bound {value!r} is not a number")
        digits = max(len(number.as_tuple().digits), abs(number.as_tuple().exponent))
        if isinstance(dt, (T.FloatType, T.DoubleType)) or digits > 18:
            return F.coalesce(beyond(c.cast("double"), F.lit(float(number))), F.lit(False))
        return F.coalesce(beyond(c, F.lit(number)), F.lit(False))
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        at = _instant(value) if not isinstance(value, (int, float)) else None
        if at is None:
            raise RuleError(f"{spec.check_type} bound {value!r} is not a date or time")
        kind = "timestamp" if isinstance(dt, T.TimestampType) or at.tzinfo else "timestamp_ntz"
        return F.coalesce(beyond(c.cast(kind), F.lit(at.isoformat(sep=" ")).cast(kind)), F.lit(False))
    if isinstance(dt, (T.StringType, T.VarcharType, T.CharType)):
        if number is None:
            return F.coalesce(beyond(c, F.lit(str(value))), F.lit(False))
        read = c.try_cast("double")
        return c.isNotNull() & (read.isNull() | beyond(read, F.lit(float(number))))
    raise RuleError(f"{spec.check_type} cannot order {dt.simpleString()} values")


def _as_text(value) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def _not_listed(df: DataFrame, spec: CheckSpec) -> Column:
    """RUL3: TRUE where a value is not in the list. Numbers are compared as
    numbers where column and list hold them; everything else as text."""
    c, dt = F.col(spec.column), _field(df, spec.column).dataType
    vals = [v for v in spec.params.get("values") or [] if v is not None]
    if not vals:
        return c.isNotNull()
    if isinstance(dt, _NUMERIC) and all(_number(v) is not None for v in vals):
        if isinstance(dt, (T.FloatType, T.DoubleType)):
            return c.isNotNull() & ~c.cast("double").isin([float(_number(v)) for v in vals])
        same = [c == F.lit(_number(v)) for v in vals]
        return c.isNotNull() & ~reduce(lambda x, y: x | y, same)
    return c.isNotNull() & ~c.cast("string").isin([_as_text(v) for v in vals])


def _row(spec: CheckSpec, name: str, severity: str | None = None) -> dict:
    return {
        "seq": spec.seq, "check_name": name, "check_type": spec.check_type,
        "column": spec.column, "severity": severity or spec.severity,
    }


def _status(failed: Column, severity: str, error: Column | None = None) -> Column:
    bad = F.lit("warning") if severity == "warning" else F.lit("failed")
    s = F.when(failed, bad).otherwise(F.lit("passed"))
    if error is not None:
        s = F.when(error, F.lit("error")).otherwise(s)
    return s


def _check_struct(meta: dict, table: str, schema: str, status: Column, expected: Column,
                  actual: Column, violations: Column, message: Column) -> Column:
    return F.struct(
        F.lit(table).alias("table_name"), F.lit(schema).alias("schema_name"),
        F.lit(meta["seq"]).cast("int").alias("seq"), F.lit(meta["check_name"]).alias("check_name"),
        F.lit(meta["check_type"]).alias("check_type"),
        F.lit(meta["column"]).cast("string").alias("column"),
        status.alias("status"), expected.cast("string").alias("expected_value"),
        actual.cast("string").alias("actual_value"), F.lit(meta["severity"]).alias("severity"),
        violations.cast("bigint").alias("violations"), message.cast("string").alias("message"))


def _static_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    data = [tuple(r.get(c) for c in CHECK_COLUMNS) for r in rows]
    return local_rows(spark, data, CHECK_SCHEMA)


# --------------------------------------------------------- row-level rules

def row_predicate_failures(df: DataFrame, spec: CheckSpec) -> Column | None:
    """VIO1 core: a boolean column that is TRUE on rows violating a
    row-level rule (NULL never counts as a violation except for not_null)."""
    c = F.col(spec.column) if spec.column else None
    p = spec.params
    t = spec.check_type
    if t == "not_null":
        return c.isNull()
    if t == "accepted_values":
        return _not_listed(df, spec)
    if t in ("min_value", "max_value"):
        return _out_of_range(df, spec)
    if t == "regex_match":
        return c.isNotNull() & ~c.cast("string").rlike(p.get("pattern", ""))
    if t == "custom_sql" and "expression" in p:
        # CHECK-constraint semantics: FALSE fails, NULL passes
        return F.coalesce(~F.expr(p["expression"]), F.lit(False))
    return None


def _rule_error(spark: SparkSession, df: DataFrame, spec: CheckSpec, tables: TableSet | None = None,
                schema: str = "public") -> str | None:
    """GOV3 at rule level: compile a regex pattern, convert a bound, look at the
    type of a freshness column, analyse a custom expression or query, all
    on the driver (no job runs); a rule that does not pass becomes one
    ERROR check instead of failing the table's whole aggregate."""
    if spec.check_type == "regex_match":
        try:  # the JVM's own regex dialect, as rlike uses it
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(spec.params.get("pattern", ""))
        except Exception as exc:  # noqa: BLE001
            return f"regex_match pattern does not compile: {str(exc).splitlines()[0]}"
        return None
    if spec.check_type in ("min_value", "max_value"):
        try:
            _out_of_range(df, spec)
        except RuleError as exc:
            return str(exc)
    if spec.check_type == "freshness":
        return time_column_error(df, spec.column)
    if spec.check_type != "custom_sql":
        return None
    try:
        if "sql" in spec.params:
            run_rule_query(spark, df, spec.params["sql"], tables, schema).schema
        elif "expression" in spec.params:
            df.select(F.expr(spec.params["expression"]).cast("boolean")).schema
    except RuleError as exc:
        return str(exc)
    except Exception as exc:  # noqa: BLE001 - analysis errors become ERROR rows
        return f"custom_sql does not analyse: {str(exc).splitlines()[0]}"
    return None


def time_column_error(df: DataFrame, column: str) -> str | None:
    """Freshness needs a date or timestamp."""
    dt = _field(df, column).dataType
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return None
    return V.MSG_FRESHNESS_QUERY_FAILED.format(error=f"column {column} is {dt.simpleString()}, not a date or timestamp")


def _missing_columns(df: DataFrame, spec: CheckSpec) -> list[str]:
    if not spec.column:
        return []
    return [c for c in spec.column.split(",") if _field(df, c) is None]


def _fused_aggs(df: DataFrame, specs: list[CheckSpec]) -> list[Column]:
    """The aggregate expressions of the row-level rules and freshness:
    ``__v<seq>`` violations, ``__a<seq>`` min/max actuals, ``__m<seq>``
    freshness MAX."""
    aggs: list[Column] = []
    for s in specs:
        i = s.seq
        if s.check_type == "freshness":
            aggs.append(F.max(F.col(s.column)).alias(f"__m{i}"))
        elif s.check_type != "row_count_min":
            aggs.append(F.count_if(row_predicate_failures(df, s)).alias(f"__v{i}"))
            if s.check_type in ("min_value", "max_value"):
                fn = F.min if s.check_type == "min_value" else F.max
                aggs.append(fn(F.col(s.column)).cast("string").alias(f"__a{i}"))
    return aggs


def _fused_outputs(specs: list[CheckSpec], plan: list[CheckSpec], table: str, schema: str,
                   as_of) -> list[Column]:
    """Check-row structs built from one aggregated row (``__n`` plus the
    columns named by ``_fused_aggs``)."""
    outs: list[Column] = []
    n = F.col("__n")
    for s in specs:
        meta = _row(s, check_name(s, plan))
        i = s.seq
        if s.check_type == "row_count_min":
            mc = int(s.params.get("min_count", 1))
            outs.append(_check_struct(
                meta, table, schema, _status(n < mc, s.severity), F.lit(mc), n,
                F.greatest(F.lit(mc) - n, F.lit(0)),
                F.format_string(f"row count %d (minimum {mc})", n)))
            continue
        if s.check_type == "freshness":
            mx = s.params.get("max_delay_minutes")
            last = F.col(f"__m{i}")
            delay = minutes_between(as_of_col(as_of), last)
            failed = last.isNull() | (delay > F.lit(mx))
            msg = F.when(last.isNull(), F.lit(V.MSG_NO_DATA.format(schema=schema, table=table))) \
                .otherwise(F.format_string(V.MSG_FRESHNESS.format(max_delay=mx),
                                           F.round(delay, 1).cast("decimal(24,1)").cast("string"),
                                           F.when(failed, "OUTSIDE").otherwise("WITHIN")))
            outs.append(_check_struct(
                meta, table, schema, F.when(failed, "failed").otherwise("passed"), F.lit(mx),
                F.round(delay, 2).cast("decimal(24,2)"), failed.cast("int"), msg))
            continue
        v = F.col(f"__v{i}")
        expected, actual = F.lit(None), v
        if s.check_type in ("min_value", "max_value"):
            expected, actual = F.lit(s.params["value"]), F.col(f"__a{i}")
        elif s.check_type == "accepted_values":
            expected = F.lit(json.dumps(s.params.get("values", [])))
        elif s.check_type == "regex_match":
            expected = F.lit(s.params.get("pattern", ""))
        elif s.check_type == "custom_sql":
            expected = F.lit(s.params["expression"])
        elif s.check_type == "not_null":
            expected = F.lit(0)
        outs.append(_check_struct(
            meta, table, schema, _status(v > 0, s.severity), expected, actual, v,
            F.concat(F.lit(f"{s.check_type} on {s.column}: " if s.column else f"{s.check_type}: "), v.cast("string"), F.lit(" violating rows"))))
    return outs


def _fused(df: DataFrame, specs: list[CheckSpec], plan: list[CheckSpec], table: str,
           schema: str, as_of) -> DataFrame | None:
    """One aggregate for every row-level rule + freshness of a table."""
    if not specs:
        return None
    aggs = [F.count(F.lit(1)).alias("__n")] + _fused_aggs(df, specs)
    outs = _fused_outputs(specs, plan, table, schema, as_of)
    return df.agg(*aggs).select(F.explode(F.array(*outs)).alias("c")).select("c.*")


# ------------------------------------------------------------ set-level rules

def duplicate_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Key values occurring more than once (rows with a NULL key part are
    left out) with their row counts."""
    return key_counts(df, columns).filter(F.col("n_rows") > 1)


def duplicates_of(counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One-row summary of key counts: duplicate key values and the rows they cover."""
    return counts.filter(F.col("n_rows") > 1).agg(
        F.count(F.lit(1)).alias("duplicate_keys"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def unique_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """RUL2 one-row summary: duplicate key values and the rows they cover."""
    return duplicates_of(key_counts(df, columns), columns)


def orphan_keys(df: DataFrame, column: str, ref: DataFrame, ref_column: str) -> DataFrame:
    """JOIN4: non-null foreign keys absent from the reference, with the number
    of referencing rows. Foreign keys are pre-aggregated (partial aggregation
    collapses hot keys before the shuffle) and reference keys de-duplicated,
    so the anti-join sees each key at most once per side; AQE picks a
    broadcast only when the measured reference side is small. Keys of different
    types are compared in one that holds both (``comparable``)."""
    return orphans_of(key_counts(df, [column]), column, ref, ref_column)


def key_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-null key values with their number of rows; hot keys collapse before the shuffle."""
    return df.select(*columns).dropna("any").groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows"))


def orphans_of(counts: DataFrame, column: str, ref: DataFrame, ref_column: str) -> DataFrame:
    """Keys of ``counts`` (key, n_rows) that the reference lacks."""
    of_key, of_ref = comparable(_field(counts, column).dataType, _field(ref, ref_column).dataType)
    fk = counts.select(column, "n_rows", of_key(F.col(column)).alias("__k"))
    rk = ref.select(of_ref(F.col(ref_column)).alias("__k")).filter(F.col("__k").isNotNull()).distinct()
    return fk.join(rk, "__k", "left_anti").select(column, "n_rows")


_EXACT = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)
_BINARY = (T.FloatType, T.DoubleType)
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)
_TEXTS = (T.StringType, T.VarcharType, T.CharType)


def comparable(key: T.DataType, ref: T.DataType):
    """Expressions that bring a foreign and a reference key to one type without
    changing a value: no fraction is cut off, no time of day, no digit of a
    large number. A value that the type cannot hold becomes null, which matches
    nothing; nothing fails under ANSI."""
    def cast(kind):
        return lambda c: c.try_cast(kind)

    def same(c):
        return c

    if key == ref:
        return same, same
    if isinstance(key, _NUMERIC) and isinstance(ref, _NUMERIC):
        if isinstance(key, _BINARY) and isinstance(ref, _BINARY):
            return cast("double"), cast("double")
        scale = max((t.scale for t in (key, ref) if isinstance(t, T.DecimalType)), default=0)
        kind = f"decimal(38,{scale})"

        def exact(c):  # a binary fraction that the decimal does not hold is no key of the other side
            return F.when(c.try_cast(kind).try_cast("double") == c.cast("double"), c.try_cast(kind))

        return tuple(exact if isinstance(t, _BINARY) else cast(kind) for t in (key, ref))
    if isinstance(key, _TIMES) and isinstance(ref, _TIMES):
        kind = "timestamp" if T.TimestampType() in (key, ref) else "timestamp_ntz"
        return cast(kind), cast(kind)
    if isinstance(key, _NUMERIC) and isinstance(ref, _TEXTS):  # text is read as a number
        kind = "double" if isinstance(key, _BINARY) else "decimal(38,18)"
        return cast(kind), cast(kind)
    if isinstance(key, _TIMES) and isinstance(ref, _TEXTS):
        kind = "timestamp" if isinstance(key, T.TimestampType) else "timestamp_ntz"
        return cast(kind), cast(kind)
    return same, cast(key)


def orphan_summary(orphans: DataFrame) -> DataFrame:
    return orphans.agg(
        F.count(F.lit(1)).alias("orphan_keys"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).cast("bigint").alias("orphan_rows"))


def unique_check(summary: DataFrame, s: CheckSpec, name: str, table: str, schema: str) -> DataFrame:
    """RUL2's check row from (duplicate_keys, duplicate_rows)."""
    v = F.col("duplicate_keys")
    return summary.select(_check_struct(
        _row(s, name), table, schema, _status(v > 0, s.severity), F.lit(0), v, v,
        F.format_string(f"unique on {s.column}: %d duplicated values in %d rows",
                        v, F.col("duplicate_rows"))).alias("c")).select("c.*")


def fk_check(orphans: DataFrame, s: CheckSpec, name: str, table: str, schema: str) -> DataFrame:
    """RUL9's check row from the orphan keys with their rows."""
    target = f"{s.params.get('reference_table')}.{s.params.get('reference_column')}"
    v = F.col("orphan_rows")
    return orphan_summary(orphans).select(_check_struct(
        _row(s, name), table, schema, _status(v > 0, s.severity), F.lit(target),
        F.col("orphan_keys"), v,
        F.format_string(f"{s.column} -> {target}: %d orphan rows, %d keys",
                        v, F.col("orphan_keys"))).alias("c")).select("c.*")


_PLACE = re.compile(r"\{([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?)\}")


def bind_query(df: DataFrame, sql: str, tables: TableSet | None, schema: str) -> tuple[str, dict[str, DataFrame]]:
    """RUL7: a rule's query with each ``{name}`` or ``{schema.name}`` in it
    bound to a governed table. ``{table}`` is the checked table; a bare name is
    looked for in the contract's schema, then in ``public``. Braces of any other
    kind are text. An unknown table is a RuleError."""
    bound: dict[str, DataFrame] = {}
    names: dict[str, str] = {}
    parts = _PLACE.split(sql)
    for i, part in enumerate(parts):
        if i % 2 == 0:
            parts[i] = part.replace("{", "{{").replace("}", "}}")
            continue
        if part not in names:
            found = df if part == "table" else tables.reference(part, schema) if tables is not None else None
            if found is None:
                raise RuleError(f"custom_sql names {part}, which is no governed table")
            names[part] = f"t{len(names)}"
            bound[names[part]] = found
        parts[i] = "{" + names[part] + "}"
    return "".join(parts), bound


def run_rule_query(spark: SparkSession, df: DataFrame, sql: str, tables: TableSet | None = None,
                   schema: str = "public") -> DataFrame:
    """RUL7 query form: the failing rows. Tables are passed as query arguments
    (no temporary view is created or replaced)."""
    text, bound = bind_query(df, sql, tables, schema)
    return spark.sql(text, **bound) if bound else spark.sql(sql)  # without arguments braces are not read


def _fk_unavailable(s: CheckSpec, plan: list[CheckSpec], tables: TableSet | None, schema: str) -> dict | None:
    ref_name = s.params.get("reference_table")
    ref_col = s.params.get("reference_column")
    ref = tables.reference(ref_name, schema) if tables is not None and ref_name else None
    if ref is None or ref_col is None or _field(ref, ref_col) is None:
        return {**_row(s, check_name(s, plan)), "status": "error", "violations": None,
                "message": f"reference {ref_name}.{ref_col} not available"}
    return None


def query_check(spark, df, s: CheckSpec, name: str, table: str, schema: str, tables: TableSet | None) -> DataFrame:
    """RUL7: any row returned by the rule's query is a failure."""
    failing = run_rule_query(spark, df, s.params["sql"], tables, schema)
    v = F.col("n")
    return failing.agg(F.count(F.lit(1)).alias("n")).select(_check_struct(
        _row(s, name), table, schema, _status(v > 0, s.severity), F.lit(0), v, v,
        F.format_string("custom query returned %d failing rows", v)).alias("c")).select("c.*")


# -------------------------------------------------------------- schema checks

def schema_check_rows(df: DataFrame, contract: dict, plan: list[CheckSpec]) -> list[dict]:
    """CHK1 + CHK2 from the DataFrame schema (JOIN3 on metadata)."""
    rows = []
    types = {c["name"]: c["type"] for c in contract["columns"]}
    for s in plan:
        if s.check_type not in ("column_exists", "column_type"):
            continue
        f = _field(df, s.column)
        meta = _row(s, check_name(s, plan))
        if s.check_type == "column_exists":
            rows.append({**meta, "status": "passed" if f else "failed", "violations": 0 if f else 1,
                         "message": V.MSG_COLUMN_EXISTS.format(column=s.column) if f else
                         V.MSG_COLUMN_MISSING.format(column=s.column)})
        elif f is not None:  # type check only when the column exists
            ok = type_matches(types[s.column], f.dataType)
            rows.append({**meta, "status": "passed" if ok else "failed",
                         "expected_value": types[s.column], "actual_value": spark_type_name(f.dataType),
                         "violations": 0 if ok else 1,
                         "message": V.MSG_TYPE_MATCHES.format(column=s.column) if ok else
                         V.MSG_TYPE_MISMATCH.format(column=s.column, expected=types[s.column],
                                                    actual=spark_type_name(f.dataType))})
    return rows


# ---------------------------------------------------------------- entry points

@dataclass
class Part:
    """Checks that run as one piece: their specs and the rows they give."""

    specs: list[CheckSpec]
    rows: DataFrame


@dataclass
class Split:
    """A plan's data checks by how they run: in the table's one aggregate, on
    keys with their counts, or as a query of their own."""

    plan: list[CheckSpec]
    fused: list[CheckSpec]
    keyed: list[CheckSpec]
    whole: list[CheckSpec]


def split_plan(spark: SparkSession, df: DataFrame, plan: list[CheckSpec], static: list[dict], schema: str,
               tables: TableSet | None) -> Split:
    """The data checks of a plan that can be judged on this table; the others
    join ``static`` as ERROR rows."""
    out = Split(plan, [], [], [])
    for s in plan:
        name = check_name(s, plan)
        error = None
        if s.check_type == "freshness" and (not s.column or not _valid_ident(s.column)):
            error = V.MSG_INVALID_TS_COLUMN.format(column=s.column)
        elif missing := _missing_columns(df, s):
            error = f"column(s) {', '.join(missing)} not found"
        elif s.check_type == "custom_sql" and not {"sql", "expression"} & set(s.params):
            error = "custom_sql needs parameters.expression or parameters.sql"
        else:
            error = _rule_error(spark, df, s, tables, schema)
        if error:
            static.append({**_row(s, name), "status": "error", "message": error})
        elif s.check_type == "unique":
            out.keyed.append(s)
        elif s.check_type == "referential_integrity":
            if gone := _fk_unavailable(s, plan, tables, schema):
                static.append(gone)
            else:
                out.keyed.append(s)
        elif s.check_type == "custom_sql" and "sql" in s.params:
            out.whole.append(s)
        else:
            out.fused.append(s)
    return out


def static_checks(spark: SparkSession, static: list[dict], table: str, schema: str) -> DataFrame:
    return _static_rows(spark, [{**r, "table_name": table, "schema_name": schema} for r in static])


def _parts(spark: SparkSession, df: DataFrame, plan: list[CheckSpec], static: list[dict], table: str,
           schema: str, tables: TableSet | None, as_of) -> list[Part]:
    """The data checks of a plan: one aggregate for the row-level rules and
    freshness, one grouped count per key, one anti-join per foreign key, one
    job per query. What cannot be judged joins ``static`` as an ERROR row.
    The plan is the same at every size."""
    split = split_plan(spark, df, plan, static, schema, tables)
    parts: list[Part] = []
    if static:
        parts.append(Part([], static_checks(spark, static, table, schema)))
    if split.fused:
        parts.append(Part(split.fused, _fused(df, split.fused, plan, table, schema, as_of)))
    for s in split.keyed:
        if s.check_type == "unique":
            rows = unique_check(unique_summary(df, s.column.split(",")), s, check_name(s, plan), table, schema)
        else:
            ref = tables.reference(s.params["reference_table"], schema)
            rows = fk_check(orphan_keys(df, s.column, ref, s.params["reference_column"]), s, check_name(s, plan), table, schema)
        parts.append(Part([s], rows))
    parts += [Part([s], query_check(spark, df, s, check_name(s, plan), table, schema, tables)) for s in split.whole]
    return parts


def contract_parts(spark: SparkSession, df: DataFrame | None, contract: dict,
                   tables: TableSet | None = None, as_of=None) -> list[Part]:
    """All checks of one contract on one table, in parts that can run and
    fail on their own.

    ``df`` None means the table does not exist (CHK5): one failed
    ``table_exists`` check, and the freshness check reports an error."""
    c = normalise(contract)
    table, schema = c["table_name"], c["schema_name"]
    plan = plan_contract(c)
    if df is None:
        missing = V.MSG_TABLE_MISSING.format(schema=schema, table=table)
        static = [{"seq": 0, "check_name": "table_exists", "check_type": "schema", "status": "failed",
                   "severity": "error", "violations": 1, "message": missing}]
        static += [{**_row(s, check_name(s, plan)), "status": "error", "message": missing}
                   for s in plan if s.check_type == "freshness"]
        return [Part([], _static_rows(spark, [{**r, "table_name": table, "schema_name": schema} for r in static]))]
    data = [s for s in plan if s.check_type not in ("column_exists", "column_type")]
    return _parts(spark, df, data, schema_check_rows(df, c, plan), table, schema, tables, as_of)


def single_parts(spark: SparkSession, df: DataFrame, contract: dict, part: Part, as_of=None) -> list[Part]:
    """The checks of a fused part one by one."""
    c = normalise(contract)
    return [Part([s], _fused(df, [s], [s], c["table_name"], c["schema_name"], as_of)) for s in part.specs]


def error_rows(spark: SparkSession, contract: dict, specs: Sequence[CheckSpec], message: str) -> DataFrame:
    """GOV3: one ERROR row per check that could not run; for a whole
    contract (no specs) one ``contract_checks`` row."""
    c = normalise(contract)
    rows = [{**_row(s, check_name(s, list(specs))), "status": "error", "message": message} for s in specs] or [
        {"seq": 0, "check_name": CONTRACT_ERROR, "check_type": "quality", "status": "error", "severity": "error", "message": message}]
    return _static_rows(spark, [{**r, "table_name": c["table_name"], "schema_name": c["schema_name"]} for r in rows])


def evaluate_contract(spark: SparkSession, df: DataFrame | None, contract: dict,
                      tables: TableSet | None = None, as_of=None) -> DataFrame:
    """All checks of one contract on one table as a checks DataFrame."""
    return reduce(DataFrame.unionByName, [p.rows for p in contract_parts(spark, df, contract, tables, as_of)])


def evaluate_rules(spark: SparkSession, df: DataFrame, table: str, rules: Sequence[dict],
                   tables: TableSet | None = None, schema: str = "public", as_of=None) -> DataFrame:
    """Only the given rules (no implicit or schema checks), fused the same
    way as a full contract run."""
    contract = normalise({"table_name": table, "schema_name": schema, "columns": [], "quality_rules": list(rules)})
    plan = []
    for i, r in enumerate(contract["quality_rules"], start=1):
        cols = rule_columns(r)
        plan.append(CheckSpec(i, r["rule_type"], ",".join(cols) if cols else None, dict(r["parameters"]), r["severity"]))
    return reduce(DataFrame.unionByName, [p.rows for p in _parts(spark, df, name_plan(plan), [], table, schema, tables, as_of)])


def _valid_ident(name: str) -> bool:
    """FN11 on the driver, the same rule as ``text.is_identifier``."""
    return bool(re.fullmatch(r"_*[^\W_]\w*", name))


# --------------------------------------------------------------- violations

def violations(df: DataFrame, rule: dict, tables: TableSet | None = None,
               key_columns: Sequence[str] = ()) -> DataFrame:
    """VIO1: the failing rows of one rule (the data-test convention: any row
    returned is a failure).

    * row-level rules: the rows whose predicate fails (key columns + the
      checked column);
    * unique: the duplicated key values with their row counts;
    * referential_integrity: the orphan keys with their row counts;
    * row_count_min: one row with the count when below the minimum.
    """
    r = normalise({"table_name": "t", "columns": [], "quality_rules": [rule]})["quality_rules"][0]
    cols = rule_columns(r)
    spec = CheckSpec(1, r["rule_type"], ",".join(cols) if cols else None, r["parameters"],
                     r["severity"])
    t = spec.check_type
    if t == "unique":
        return duplicate_keys(df, cols)
    if t == "referential_integrity":
        ref = tables.reference(spec.params["reference_table"])
        return orphan_keys(df, spec.column, ref, spec.params["reference_column"])
    if t == "row_count_min":
        mc = int(spec.params.get("min_count", 1))
        return (df.agg(F.count(F.lit(1)).alias("row_count"))
                  .filter(F.col("row_count") < mc).withColumn("min_count", F.lit(mc).cast("bigint")))
    if t == "custom_sql" and "sql" in spec.params:
        return run_rule_query(df.sparkSession, df, spec.params["sql"], tables)
    pred = row_predicate_failures(df, spec)
    keep = list(dict.fromkeys(list(key_columns) + ([spec.column] if spec.column else [])))
    return df.filter(pred).select(*keep) if keep else df.filter(pred)


def rule_columns(rule: dict) -> list[str]:
    cols = (rule.get("parameters") or {}).get("columns")
    if cols:
        return list(cols)
    return [rule["column"]] if rule.get("column") else []
