"""Mixing sources to target weights by capped water-filling.

A source's target is its weight's share of the total size, but at most
``max_epochs`` times its own size. What the clamped sources cannot take is
shared among the others by weight, and again, until no source is above its
limit. A source then takes whole repetitions of all its documents and a
fractional one: its documents in the order of a seeded hash until the target is
reached; the document at the end is taken in part, so that a source's words
meet its target to the rounding.

The hash order of a source is cut into ranges of about ``RANGE_ROWS``
documents; sums run over ranges first and then inside each range, so a source
that holds most rows is spread over many tasks. DataFrame functions only.

Nulls and ties: a null text has size 0; a null source is a source of its own
and sorts last; equal hashes are ordered by identifier and size; rows that
repeat an identifier count one by one. A source without words has target 0.
An empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import staged

WORD = r"[^\x20\x09-\x0D]+"
MAX_EPOCHS, SEED = 3, 20
RANGE_ROWS = 4096
#: ranges whose sums one task adds up
RANGE_BLOCK = 4096


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: str) -> Column:
    """A key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def cycled_weights(per_source: DataFrame, cycle: int = 3) -> DataFrame:
    """weight 1, 2, ..., cycle, repeating over the sources in code-point order,
    null last. Sources are ranked inside range partitions and the partitions'
    counts are summed before, so no task sees all of them."""
    order = [F.col("source").isNull(), F.col("source")]
    dealt = staged(per_source.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "sources")
    before = dealt.groupBy("_part").agg(F.count("*").alias("_n")).withColumn(
        "_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_row", own).join(before, "_part").withColumn(
        "weight", ((F.coalesce("_before", F.lit(0)) + F.col("_row") - 1) % cycle + 1).cast("double")).drop("_part", "_row", "_n", "_before")


def water_fill(weighted: DataFrame, total: float, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``target`` for rows (source_size, weight). The level is the target per
    weight; each round clamps the sources that it would overfill and raises it
    for the rest. Only sums come to the driver."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level, clamped = 0.0, -1
    while True:
        full = cap <= F.col("weight") * F.lit(level)
        row = weighted.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)), F.count(F.when(full, 1))).first()
        if row[2] == clamped or not row[1]:
            break
        level, clamped = (total - row[0]) / row[1], row[2]
    return weighted.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def mix(docs: DataFrame, weights: DataFrame | None = None, max_epochs: float = MAX_EPOCHS, seed: int = SEED,
        keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, whole
    (repetitions), part (words of one more) and taken, with the ``keep``
    columns. ``weights`` (source, weight) replaces the cycle 1, 2, 3; a source
    that it leaves out has weight 0."""
    # the text too: rows without an identifier, or with the same, are dealt as well
    unit = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source").cast("string"), F.col("text")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rows = staged(docs.select("doc_id", F.col("source").cast("string").alias("source"), words().alias("size"), *keep, unit.alias("_u")), "sizes")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs"))
    if weights is None:
        weighted = cycled_weights(per_source)
    else:
        given = weights.select(_key("source").alias("_k"), F.col("weight").cast("double").alias("weight"))
        weighted = per_source.withColumn("_k", _key("source")).join(given, "_k", "left").drop("_k").fillna(0.0, ["weight"])
    weighted = staged(weighted, "weights")
    total, most = weighted.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.max("_docs"), F.lit(1))).first()
    # the ranges of the hash order, as many as the largest source needs
    ranges = -(-most // RANGE_ROWS)
    rows = rows.withColumn("_k", _key("source")).withColumn("_range", F.floor(F.col("_u") * F.lit(float(ranges))))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    filled = water_fill(weighted, float(total), max_epochs).select(_key("source").alias("_k"), "source_size", "target", whole.alias("whole"))
    # sums run over blocks of ranges, then over the ranges of a block, so that no
    # task sees all ranges of a source
    block = F.floor(F.col("_range") / RANGE_BLOCK)
    sums = staged(rows.groupBy("_k", "_range").agg(F.sum("size").alias("_sum")).withColumn("_block", block), "range-sums")
    ahead = F.sum("_sum").over(Window.partitionBy("_k").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = sums.groupBy("_k", "_block").agg(F.sum("_sum").alias("_sum")).select("_k", "_block", F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    inside = F.sum("_sum").over(Window.partitionBy("_k", "_block").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    places = (sums.join(blocks, ["_k", "_block"]).withColumn("_before", F.col("_ahead") + F.coalesce(inside, F.lit(0))).join(filled, "_k")
              .withColumn("_rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")))
    placed = rows.join(staged(places.drop("_sum", "_block", "_ahead"), "ranges"), ["_k", "_range"])
    order = Window.partitionBy("_k", "_range").orderBy("_u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("_rest") - start))
    return placed.withColumn("part", part).select(
        "doc_id", "size", "source_size", "target", "whole", "part", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"), *keep)


def repeated(docs: DataFrame, weights: DataFrame | None = None, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often
    as it is taken; where it is taken in part, its last copy has the first
    ``part`` words, joined by single spaces. A document without words, or not
    taken, is absent."""
    others = tuple(docs.columns)
    renamed = docs.select("doc_id", "source", "text", *[F.col(c).alias(f"_c{i}") for i, c in enumerate(others)])
    out = mix(renamed, weights, max_epochs, seed, tuple(f"_c{i}" for i in range(len(others))))
    text = f"_c{others.index('text')}"
    copies = F.col("whole") + (F.col("part") > 0).cast("long")
    rows = out.filter((copies > 0) & (F.col("size") > 0)).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    cut = (F.col("_copy") > F.col("whole")) & (F.col("part") < F.col("size"))
    split = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = rows.withColumn(text, F.when(cut, F.array_join(F.slice(split, F.lit(1), F.col("part").cast("int")), " ")).otherwise(F.col(text)))
    return rows.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(others)])
