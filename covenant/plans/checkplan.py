"""Check plan: which checks a contract asks for (PLAN1/PLAN2, CHK6, CHK7).

The reference builds two overlapping lists (expectation suite and check
YAML) and never evaluates them. Here both are merged into one plan with
duplicates collapsed on (check_type, column, parameters); the strictest
severity wins and every origin is kept. The plan is available for one
contract on the driver (to build its Spark job) and for many contracts as
a DataFrame job (``plan_many``).
"""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covenant.functions.text import slug
from covenant.plans.contracts import normalise

# plan origins in plan order: schema checks, implicit checks, declared rules, freshness
ORIGINS = ("schema", "implicit", "rule", "freshness")


@dataclass
class CheckSpec:
    seq: int
    check_type: str
    column: str | None
    params: dict = field(default_factory=dict)
    severity: str = "error"
    origin: str = "rule"
    name: str | None = None

    @property
    def params_json(self) -> str:
        return json.dumps(self.params, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _rule_columns(rule: dict) -> list[str]:
    cols = rule.get("parameters", {}).get("columns")
    if cols:
        return [c for c in cols]
    return [rule["column"]] if rule.get("column") else []


def plan_contract(contract: dict) -> list[CheckSpec]:
    """PLAN1 + PLAN2 for one contract (metadata only, no data touched)."""
    c = normalise(contract)
    raw: list[CheckSpec] = []
    for col in c["columns"]:
        raw.append(CheckSpec(0, "column_exists", col["name"], origin="schema"))
        raw.append(CheckSpec(0, "column_type", col["name"], {"type": col["type"]}, origin="schema"))
    for col in c["columns"]:
        if not col["nullable"]:
            raw.append(CheckSpec(0, "not_null", col["name"], origin="implicit"))
        if col["primary_key"]:
            raw.append(CheckSpec(0, "unique", col["name"], origin="implicit"))
    raw.append(CheckSpec(0, "row_count_min", None, {"min_count": 1}, origin="implicit"))
    for r in c["quality_rules"]:
        p = dict(r.get("parameters") or {})
        rt = r["rule_type"]
        if rt == "row_count_min":
            p = {"min_count": p.get("min_count", 1)}
        cols = _rule_columns(r)
        column = ",".join(cols) if cols else None
        raw.append(CheckSpec(0, rt, column, p, r.get("severity") or "error", origin="rule"))
    f = c.get("freshness")
    if f:
        raw.append(CheckSpec(0, "freshness", f.get("timestamp_column"),
                             {"max_delay_minutes": f.get("max_delay_minutes")}, origin="freshness"))
    merged: dict[tuple, CheckSpec] = {}
    for s in raw:
        key = (s.check_type, s.column, s.params_json)
        if key in merged:
            m = merged[key]
            if s.severity == "error":
                m.severity = "error"
            if s.origin not in m.origin.split("+"):
                m.origin = m.origin + "+" + s.origin
        else:
            merged[key] = s
    out = list(merged.values())
    for i, s in enumerate(out, start=1):
        s.seq = i
    return name_plan(out)


def _base_name(spec: CheckSpec) -> str:
    """FN13: the name of a check has no blanks and is in lower case."""
    name = spec.check_type if not spec.column else f"{spec.check_type}_{spec.column.replace(',', '_')}"
    return name.replace(" ", "_").lower()


def name_plan(plan: list[CheckSpec]) -> list[CheckSpec]:
    """Names for the checks of a plan; checks that would share one get their place."""
    count = Counter(map(_base_name, plan))
    for s in plan:
        s.name = _base_name(s) if count[_base_name(s)] == 1 else f"{_base_name(s)}_{s.seq}"
    return plan


def check_name(spec: CheckSpec, plan: list[CheckSpec]) -> str:
    if spec.name is None:
        name_plan(plan)
    return spec.name or _base_name(spec)


# ------------------------------------------------------------- many contracts

def plan_many(contracts: DataFrame) -> DataFrame:
    """PLAN1/PLAN2 as one DataFrame job over a contract registry.

    Output: table_name, schema_name, check_type, column, params, severity,
    origin, seq, check_name; the same plan as ``plan_contract`` gives. Works per contract
    (grouped by table), so the registry may hold any number of contracts."""
    keys = ["table_name", "schema_name"]

    def row(grp, pos, sub, check_type, column, params, severity, origin):
        lit = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(lit(grp).cast("int").alias("grp"), lit(pos).cast("int").alias("pos"),
                        lit(sub).cast("int").alias("sub"), lit(check_type).cast("string").alias("check_type"),
                        lit(column).cast("string").alias("column"), lit(params).cast("string").alias("params"),
                        lit(severity).cast("string").alias("severity"), lit(origin).cast("string").alias("origin"))

    # one row per contract, dealt once by its keys: the later grouping and
    # the numbering keep this partitioning
    dealt = contracts.repartition(*keys)
    none = F.array().cast("array<struct<grp:int,pos:int,sub:int,check_type:string,column:string,params:string,severity:string,origin:string>>")

    def of_column(c, i):
        return F.array(
            row(0, i, 0, "column_exists", c["name"], "{}", "error", "schema"),
            row(0, i, 1, "column_type", c["name"], F.to_json(F.struct(c["type"].alias("type"))), "error", "schema"),
            F.when(~c["nullable"], row(1, i, 0, "not_null", c["name"], "{}", "error", "implicit")),
            F.when(c["primary_key"], row(1, i, 1, "unique", c["name"], "{}", "error", "implicit")))

    def of_rule(r, i):
        p = F.coalesce(r["parameters"], F.lit("{}"))
        least = F.coalesce(F.get_json_object(p, "$.min_count").cast("bigint"), F.lit(1))
        # a parsed document has its keys in order and keeps the types of its values
        params = F.when(r["rule_type"] == "row_count_min", F.to_json(F.struct(least.alias("min_count")))).otherwise(
            F.to_json(F.parse_json(p)))
        several = F.array_join(F.from_json(F.get_json_object(p, "$.columns"), "array<string>"), ",")
        return row(3, i, 0, r["rule_type"], F.coalesce(F.nullif(several, F.lit("")), r["column"]), params, F.coalesce(r["severity"], F.lit("error")), "rule")

    of_table = F.array(
        row(2, 0, 0, "row_count_min", F.lit(None), '{"min_count":1}', "error", "implicit"),
        F.when(F.col("freshness").isNotNull(), row(
            4, 0, 0, "freshness", F.col("freshness.timestamp_column"),
            F.to_json(F.struct(F.col("freshness.max_delay_minutes").alias("max_delay_minutes"))), "error", "freshness")))
    rows = F.concat(F.coalesce(F.flatten(F.transform("columns", of_column)), none), F.coalesce(F.transform("quality_rules", of_rule), none), of_table)
    allrows = dealt.select(*keys, F.explode(rows).alias("e")).filter(F.col("e").isNotNull()).select(*keys, "e.*")
    order_key = F.struct("grp", "pos", "sub")
    merged = allrows.groupBy(*keys, "check_type", "column", "params").agg(
        F.min(order_key).alias("first"),
        F.when(F.count_if(F.col("severity") == "error") > 0, "error").otherwise("warning").alias("severity"),
        # origins come from a fixed, ordered set (their order follows the
        # plan group), so presence flags joined in that order give the
        # merged label without collecting lists
        *[F.max((F.col("origin") == o).cast("int")).alias(f"__o_{o}") for o in ORIGINS],
    )
    merged = merged.withColumn("origin", F.concat_ws("+", *[
        F.when(F.col(f"__o_{o}") == 1, F.lit(o)) for o in ORIGINS])).drop(*[f"__o_{o}" for o in ORIGINS])
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy(F.col("first"))
    numbered = merged.withColumn("seq", F.row_number().over(w)).drop("first")
    base = slug(F.concat_ws("_", "check_type", F.replace(F.col("column"), F.lit(","), F.lit("_"))))
    same = F.count(F.lit(1)).over(Window.partitionBy(*keys, "check_name"))
    place = F.when(same > 1, F.concat(F.lit("_"), F.col("seq").cast("string"))).otherwise("")
    return numbered.withColumn("check_name", base).withColumn("check_name", F.concat("check_name", place))
