"""Passed and failed rows apart (VIO1): every row gets the names of the rules
that it breaks, in one pass over the table.

Row rules are predicates of the row. Uniqueness and foreign keys are asked of
the keys: duplicate and orphan keys are found on key counts (pre-aggregated, so
a hot key is one row a task) and joined back to the rows; a key that stands in a
third of the rows is split by Spark's skew join. Rules on the same key columns
share a join. Rows with a null key break neither.

``write_split`` writes both kinds of rows in one job, below ``passed=true`` and
``passed=false``: what fails half way leaves neither, and writing a run (or a
stream's batch) again replaces both.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covenant.operators import checks as C
from covenant.plans.checkplan import CheckSpec, name_plan
from covenant.plans.contracts import normalise
from covenant.sources.tables import TableSet

BROKEN = "broken_rules"


def row_rules(rules: Sequence[dict]) -> list[CheckSpec]:
    """The rules that can be asked of a single row, named as their checks are;
    a row count and a query are of the whole table."""
    specs = []
    for i, r in enumerate(normalise({"table_name": "t", "columns": [], "quality_rules": list(rules)})["quality_rules"], start=1):
        cols = C.rule_columns(r)
        specs.append(CheckSpec(i, r["rule_type"], ",".join(cols) if cols else None, dict(r["parameters"]), r["severity"]))
    return [s for s in name_plan(specs) if s.check_type != "row_count_min" and "sql" not in s.params]


def tag(df: DataFrame, rules: Sequence[dict], tables: TableSet | None = None, schema: str = "public") -> DataFrame:
    """The rows with ``broken_rules``: the names of the rules that each breaks, in
    the order of the rules (empty: it passes)."""
    specs = row_rules(rules)
    marks: dict[int, object] = {}
    out = df
    for s in specs:
        if s.check_type not in ("unique", "referential_integrity"):
            marks[s.seq] = C.row_predicate_failures(df, s)
    keyed: dict[tuple[str, ...], list[CheckSpec]] = {}
    for s in specs:
        if s.seq not in marks:
            keyed.setdefault(tuple(s.column.split(",")), []).append(s)
    for columns, group in keyed.items():
        counts = C.key_counts(df, columns)
        bad = None
        for s in group:
            if s.check_type == "unique":
                found = counts.filter(F.col("n_rows") > 1)
            else:
                found = C.orphans_of(counts, s.column, tables.reference(s.params["reference_table"], schema), s.params["reference_column"])
            found = found.select(*columns, F.lit(s.seq).alias("__seq"))
            bad = found if bad is None else bad.unionByName(found)
        flags = [F.max(F.col("__seq") == s.seq).alias(f"__b{s.seq}") for s in group]
        out = out.join(bad.groupBy(*columns).agg(*flags), list(columns), "left")
        marks.update({s.seq: F.col(f"__b{s.seq}") for s in group})
    names = F.array(*[F.when(marks[s.seq], F.lit(s.name)) for s in specs]) if specs else F.array().cast("array<string>")
    return out.select(*[F.col(c) for c in df.columns], F.array_compact(names).alias(BROKEN))


def write_split(tagged: DataFrame, path: str) -> None:
    """Both kinds of rows in one job; ``path`` (of one run or batch) is replaced."""
    tagged.withColumn("passed", F.size(BROKEN) == 0).write.mode("overwrite").partitionBy("passed").parquet(path)


def read_split(spark: SparkSession, path: str, passed: bool) -> DataFrame:
    """The passed or the failed rows of one run, or of all below ``path``."""
    rows = spark.read.parquet(path).filter(F.col("passed") == passed).drop("passed")
    return rows.drop(BROKEN) if passed else rows


def broken_counts(failed: DataFrame) -> DataFrame:
    """(rule, n_rows) of failed rows."""
    return failed.select(F.explode(BROKEN).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n_rows"))
