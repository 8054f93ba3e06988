"""Running products along sorted groups, over any monoid.

Rows are range-partitioned by (group, order), so a group of any size is dealt
over as many tasks as it fills. Each task forms the products of its own rows;
one row a partition (its last) says what the next partition has to put in
front. These rows, as many as there are partitions, are all that reaches the
driver.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .common import on_workers, pylist, staged

#: columns that the first pass adds for the second
_PART, _OPEN, _LAST = "_scan_part", "_scan_open", "_scan_last"


def running(rows: DataFrame, group: str, order: Sequence, element: Callable[[dict], tuple], unit: tuple,
            times: Callable[[tuple, tuple], tuple], names: Sequence[str], reads: Sequence[str], name: str) -> DataFrame:
    """``rows`` with the long columns ``names``: the product ``times(...)`` of the
    ``element`` of each row of the same ``group`` up to and with this one, in the
    given ``order`` (column expressions over ``rows``; ties are in any order that
    a retry keeps). ``element`` is given the columns ``reads`` of a row; ``times``
    has to be associative with ``unit`` as its neutral element. ``group`` is a
    non-null column. ``rows`` is read twice (its range is sampled first). The
    result is a written table."""
    keep = rows.columns
    keyed = rows.select("*", *[c.alias(f"_scan_k{i}") for i, c in enumerate(order)])
    by = [group, *[f"_scan_k{i}" for i in range(len(order))]]
    dealt = keyed.repartitionByRange(*by).sortWithinPartitions(*by).select(*keep)
    local = T.StructType([*dealt.schema.fields, *[T.StructField(n, T.LongType()) for n in names],
                          T.StructField(_PART, T.IntegerType()), T.StructField(_OPEN, T.BooleanType()), T.StructField(_LAST, T.BooleanType())])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        state, own, opening, held = unit, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield held
            groups, read = pylist(batch, group), {c: pylist(batch, c) for c in reads}
            out = [[] for _ in names]
            open_ = []
            for i, g in enumerate(groups):
                if opening is None:
                    opening = (g,)
                if own != (g,):
                    own, state = (g,), unit
                state = times(state, element({c: read[c][i] for c in reads}))
                open_.append(own == opening)
                for column, value in zip(out, state):
                    column.append(value)
            n = batch.num_rows
            held = pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(c, pa.int64()) for c in out], pa.array([part] * n, pa.int32()), pa.array(open_), pa.array([False] * n)],
                names=[*batch.schema.names, *names, _PART, _OPEN, _LAST])
        if held is not None:  # the last row of the partition is marked
            last = [False] * (held.num_rows - 1) + [True]
            yield pa.RecordBatch.from_arrays([*held.columns[:-1], pa.array(last)], names=held.schema.names)

    scanned = staged(on_workers(dealt, first, local), f"{name}-local")
    front: dict[int, tuple] = {}
    left: tuple | None = None  # (group, product) at the end of the partition before
    lasts = scanned.filter(_LAST).select(_PART, _OPEN, group, *names).orderBy(_PART).collect()
    opens = {r[_PART]: r[group] for r in scanned.filter(_OPEN).groupBy(_PART).agg(F.first(group).alias(group)).collect()}
    for r in lasts:
        product = tuple(r[n] for n in names)
        if left is not None and left[0] == opens[r[_PART]]:
            front[r[_PART]] = left[1]
            if r[_OPEN]:
                product = times(left[1], product)
        left = (r[group], product)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, open_ = pylist(batch, _PART), pylist(batch, _OPEN)
            out = list(zip(*(pylist(batch, n) for n in names)))
            for i, p in enumerate(parts):
                if open_[i] and p in front:
                    out[i] = times(front[p], out[i])
            columns = list(zip(*out)) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(c, pa.int64()) for c in columns]], names=[*keep, *names])

    if not front:
        return scanned.select(*keep, *names)
    return staged(on_workers(scanned, second, T.StructType(local.fields[:-3])), f"{name}-whole")
