"""Latest row per key (WIN1, WIN2).

``row_number() = 1`` over a window partitioned by the key. Spark plans it
with a *partial* WindowGroupLimit before the exchange and a final one after
it, so every map task ships at most one row per key: a hot key holding a
third of the table costs one row per input partition in the shuffle, not a
third of the table in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RN = "__covenant_rn"


def _order_col(spec) -> Column:
    """Accepts ``Column`` or ``(name, direction, nulls)`` tuples, where
    direction is 'asc'/'desc' and nulls 'first'/'last'."""
    if isinstance(spec, Column):
        return spec
    if isinstance(spec, str):
        return F.col(spec).asc_nulls_last()
    name, direction, nulls = (list(spec) + ["asc", "last"])[:3]
    c = F.col(name)
    if direction == "desc":
        return c.desc_nulls_first() if nulls == "first" else c.desc_nulls_last()
    return c.asc_nulls_first() if nulls == "first" else c.asc_nulls_last()


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence,
                   tie_break: Sequence = ()) -> DataFrame:
    """Keep the first row per ``keys`` under ``order`` (+ ``tie_break``).

    The reference leaves ties unordered (DISTINCT ON / ROW_NUMBER without a
    tie-break); here the caller names the tie-break so results are
    deterministic.
    """
    if not keys:
        raise ValueError("latest_per_key needs at least one key column")
    w = Window.partitionBy(*keys).orderBy(*[_order_col(o) for o in list(order) + list(tie_break)])
    return (df.withColumn(_RN, F.row_number().over(w))
              .filter(F.col(_RN) == 1)
              .drop(_RN))
