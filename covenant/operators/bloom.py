"""Foreign keys against a very large reference: block filters before the shuffle.

A Bloom filter is a table of bitmaps here (``bitmap_construct_agg``, 32,768 bits
a block): a key belongs to one block and sets ``HASHES`` bits in it. A key one of
whose bits is not set is certainly not among the keys that the filter was made
of, so its row needs no join. The filter's size follows from a count of the keys
and is checked before anything is broadcast; beyond ``max_bytes`` nothing is
filtered and the plain anti-join does all of it.

``large_orphans`` filters twice. Reference keys that no row refers to are
dropped where they are read (the reference may be far larger than the keys that
refer to it). Of the foreign keys, those that a filter of the remaining reference
keys refuses are orphans already; only the others meet in the exact anti-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covenant.operators.checks import _field, comparable, key_counts
from covenant.plans.pipeline import new_folder

BLOCK_BITS = 32768
BITS_PER_KEY, HASHES = 12, 4
MAX_BYTES = 64 << 20


def blocks_for(keys: int) -> int:
    return max(1, -(-keys * BITS_PER_KEY // BLOCK_BITS))


def _place(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """(block, bits in it) of a key."""
    h = F.xxhash64(key)
    return F.pmod(h, F.lit(blocks)), [F.pmod(F.xxhash64(h, F.lit(i)), F.lit(BLOCK_BITS)) for i in range(HASHES)]


def block_filter(keys: DataFrame, column: str, blocks: int) -> DataFrame:
    """(block, bits) of the keys; a block without keys has no row."""
    block, bits = _place(F.col(column), blocks)
    return keys.select(block.alias("block"), F.explode(F.array(*bits)).alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def may_hold(rows: DataFrame, column: str, made: DataFrame, blocks: int) -> DataFrame:
    """``rows`` with ``may_hold``: false where the filter certainly lacks the key
    (a null key is never held). The filter is broadcast; ``large_orphans`` checks
    its size first."""
    block, bits = _place(F.col(column), blocks)
    byte = lambda bit: F.conv(F.hex(F.substring(F.col("bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.col("bits").isNotNull() & F.col(column).isNotNull()
    for bit in bits:
        hit = hit & (F.getbit(byte(bit), (bit % 8).cast("int")) == 1)
    return rows.withColumn("block", block).join(F.broadcast(made), "block", "left").withColumn("may_hold", F.coalesce(hit, F.lit(False))).drop("block", "bits")


def large_orphans(df: DataFrame, column: str, ref: DataFrame, ref_column: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """JOIN4/RUL9: the result of ``orphan_keys`` (key, n_rows)."""
    spark = df.sparkSession
    of_key, of_ref = comparable(_field(df, column).dataType, _field(ref, ref_column).dataType)
    path = new_folder(spark)  # read three times; the first two pay for the filters
    key_counts(df, [column]).withColumn("__k", of_key(F.col(column))).write.parquet(path)
    keys = spark.read.parquet(path)
    held = ref.select(of_ref(F.col(ref_column)).alias("__k")).filter(F.col("__k").isNotNull())
    blocks = blocks_for(keys.count())
    if blocks * BLOCK_BITS // 8 <= max_bytes:
        held = may_hold(held, "__k", block_filter(keys.filter("__k is not null"), "__k", blocks), blocks).filter("may_hold").select("__k")
    held = held.distinct()
    left = new_folder(spark)
    held.write.parquet(left)
    held = spark.read.parquet(left)
    blocks = blocks_for(held.count())
    if blocks * BLOCK_BITS // 8 > max_bytes:
        return keys.join(held, "__k", "left_anti").select(column, "n_rows")
    tested = may_hold(keys, "__k", block_filter(held, "__k", blocks), blocks)
    sure = tested.filter(~F.col("may_hold")).select(column, "n_rows")
    return sure.unionByName(tested.filter("may_hold").join(held, "__k", "left_anti").select(column, "n_rows"))
