"""Exact top-k search by inner product over a pivot-distance index.

An extra component brings all vectors to one length R, the largest: then the
squared distance of query q and vector x is |q|^2 + R^2 - 2 q.x, and the
largest inner products are the nearest neighbours. Vectors are keyed by their
nearest pivot and the distance to it, range-sorted by that key, and cut into
annuli of at most ``ANNULUS_ROWS`` vectors.

Queries are cut into tiles in the same order. A tile of up to ``TILE_ROWS``
queries meets the annuli of a pivot that the triangle inequality leaves open,
from the sorted middle outwards; the k-th best score so far closes annuli, for
each query of its own, whose bound lies below it. The first scores come from
the sample that the pivots are taken from. An annulus is sent to a tile once,
and a tile's queries to each task that has some of its annuli.

Fitting reads a bounded sample (``SAMPLE`` vectors, by hash of the identifier)
for at most ``PIVOTS`` pivots; every vector is indexed and the result is exact.

Nulls and ties: vectors that are null or hold a null or non-finite component
take no part, nor do null identifiers; shorter vectors are padded with zeros.
Equal scores go to the smaller identifier. Rows that repeat an identifier are
separate candidates, and a query with a repeated identifier is answered once,
for one of its vectors (the least); candidates with the query's identifier
are left out. An empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import hash_sample, on_workers, pylist, staged

PIVOTS, SAMPLE = 64, 2048
ANNULUS_ROWS, QUERY_ROWS = 2048, 256
#: queries that a task holds at once (and the bytes of their vectors) while annuli pass by
TILE_ROWS, TILE_BYTES = 1 << 16, 32 << 20
#: tasks that share a tile's annuli, at least; and about the annuli of one such task
SHARDS, SHARD_ANNULI = 16, 1024
#: scores are whole numbers; beyond this product of lengths floats may round
_EXACT = float(2 ** 52)
#: no score; its negative is a long too
_NONE = -(2 ** 63) + 1


def usable(rows: DataFrame, scale: float = 64.0) -> DataFrame:
    """(id, x) with x the whole-number components floor(scale * component)."""
    x = F.transform(F.col("embedding"), lambda c: F.floor(c.cast("double") * F.lit(scale)).cast("double"))
    fine = ~F.exists(F.col("embedding"), lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    return rows.select(F.col("vec_id").cast("long").alias("id"), F.when(F.col("embedding").isNotNull() & fine, x).alias("x")).filter(
        F.col("x").isNotNull() & F.col("id").isNotNull())


def stored(top: float) -> str:
    """The smallest number type that holds whole numbers up to ``top``."""
    return "<i1" if top <= 127 else "<i2" if top <= 32767 else "<f8"


def matrix(lists: list, dim: int) -> np.ndarray:
    out = np.zeros((len(lists), dim))
    for i, v in enumerate(lists):
        out[i, :len(v)] = v
    return out


def fit(vectors: DataFrame, dim: int, pivots: int = PIVOTS, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pivots, sample identifiers, sample vectors): pivots far from each other."""
    rows = hash_sample(vectors, ["id", "x"], sample).orderBy("_rank").collect()
    ids, x = np.array([r["id"] for r in rows], np.int64), matrix([r["x"] for r in rows], dim)
    chosen = [0]
    near = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(pivots, len(x)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen], ids, x


def distances(x: np.ndarray, lift: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of lifted vectors (the square of the extra component in
    ``lift``) to the pivots, which have none. The squares are whole numbers,
    so that only the root is rounded."""
    d = (x * x).sum(1)[:, None] + lift[:, None] + (centres * centres).sum(1)[None, :] - 2 * (x @ centres.T)
    return np.sqrt(np.maximum(d, 0))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers; one beyond a long is held at its end."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < _EXACT:
        return (q @ x.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(q) @ whole(x).T if q.size and x.size else np.zeros((len(q), len(x)), object)
    return np.clip(exact, _NONE + 1, np.iinfo(np.int64).max).astype(np.int64)


def indexed(vectors: DataFrame, centres: np.ndarray, square: float, kind: str, rows: int = ANNULUS_ROWS) -> DataFrame:
    """Annuli (pivot, lo, hi, ids, xs): vectors keyed by pivot and distance, in
    that order, at most ``rows`` of one pivot in each."""
    dim = centres.shape[1]

    def key(batches):
        for batch in batches:
            x = matrix(pylist(batch, "x"), dim)
            d = distances(x, np.maximum(square - (x * x).sum(1), 0), centres)
            pivot = d.argmin(1) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pivot.astype(np.int32)), pa.array(d[np.arange(len(x)), pivot]), batch.column("id"), pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())], names=["pivot", "far", "id", "x"])

    keyed = staged(on_workers(vectors, key, "pivot int, far double, id long, x binary"), "keyed")
    dealt = keyed.repartitionByRange("pivot", "far", "id").sortWithinPartitions("pivot", "far", "id")

    def cut(batches):
        held: list[tuple] = []

        def annulus():
            return pa.RecordBatch.from_arrays([pa.array([held[0][0]], pa.int32()), pa.array([held[0][1]]), pa.array([held[-1][1]]), pa.array([np.array([h[2] for h in held], np.int64).tobytes()], pa.binary()), pa.array([b"".join(h[3] for h in held)], pa.binary())], names=["pivot", "lo", "hi", "ids", "xs"])

        for batch in batches:
            for row in zip(*(pylist(batch, c) for c in ("pivot", "far", "id", "x"))):
                if held and (held[0][0] != row[0] or len(held) == rows):
                    yield annulus()
                    held = []
                held.append(row)
        if held:
            yield annulus()

    return on_workers(dealt, cut, "pivot int, lo double, hi double, ids binary, xs binary")


class Best:
    """The k best (score, smaller identifier) of some queries."""

    def __init__(self, query_ids: np.ndarray, k: int):
        self.query_ids, self.k = query_ids, k
        self.scores = np.zeros((len(query_ids), 0), np.int64)
        self.ids = np.zeros((len(query_ids), 0), np.int64)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` (rows, candidates)."""
        own = self.query_ids[rows][:, None] == ids[None, :]
        scores = np.where(own, _NONE, scores)
        if scores.shape[1] > 4 * self.k:  # keep every score that may still count, ties included
            least = -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1]
            cols = np.flatnonzero((scores >= least[:, None]).any(0))
            scores, ids = scores[:, cols], ids[cols]
        width = self.scores.shape[1]
        all_scores = np.concatenate([self.scores[rows], scores], 1)
        all_ids = np.concatenate([self.ids[rows], np.broadcast_to(ids, scores.shape)], 1)
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, :self.k]
        new = order.shape[1]
        if new > width:
            pad = np.full((len(self.query_ids), new - width), _NONE, np.int64)
            self.scores, self.ids = np.concatenate([self.scores, pad], 1), np.concatenate([self.ids, pad], 1)
        self.scores[rows, :new] = np.take_along_axis(all_scores, order, 1)
        self.ids[rows, :new] = np.take_along_axis(all_ids, order, 1)

    def floor(self) -> np.ndarray:
        """The k-th best score, or the lowest number where there are fewer."""
        if self.scores.shape[1] < self.k:
            return np.full(len(self.query_ids), _NONE)
        return self.scores[:, -1]


def search(vectors: DataFrame, queries: DataFrame, k: int, pivots: int = PIVOTS, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score for rows (id, x) and queries (id, x)."""
    spark = vectors.sparkSession
    vectors, queries = staged(vectors, "vectors"), staged(queries.groupBy("id").agg(F.min("x").alias("x")), "queries")
    norm = F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c)
    top = F.aggregate("x", F.lit(0.0), lambda a, c: F.greatest(a, F.abs(c)))
    dim, square, most = vectors.agg(F.max(F.size("x")), F.max(norm), F.max(top)).first()
    if dim is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    query_dim, query_most = queries.agg(F.max(F.size("x")), F.max(top)).first()
    dim = max(dim, query_dim or 0)
    reach, kind, query_kind = float(np.sqrt(square)), stored(most), stored(query_most or 0.0)
    centres, sample_ids, sample_x = fit(vectors, dim, pivots, sample)
    annuli = staged(indexed(vectors, centres, square, kind).withColumn("annulus", F.monotonically_increasing_id()), "annuli")

    def first(batches):
        """Distances of a query to the pivots, and a floor of its k-th score from the sample."""
        for batch in batches:
            q, ids = matrix(pylist(batch, "x"), dim), batch.column("id").to_numpy()
            if not len(q):
                continue
            best = Best(ids, k)
            best.add(np.arange(len(q)), products(q, sample_x), sample_ids)
            d = distances(q, np.zeros(len(q)), centres)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([v.tobytes() for v in q], pa.binary()), pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1)), pa.array(best.floor())], names=["id", "x", "pivot", "far", "floor"])

    told = staged(on_workers(queries, first, "id long, x binary, pivot int, far double, floor long"), "told")
    tile_rows = max(QUERY_ROWS, min(TILE_ROWS, TILE_BYTES // (8 * dim + 1)))
    tiles = -(-told.count() // tile_rows)
    dealt = told.repartitionByRange(max(1, tiles), "pivot", "far", "id").sortWithinPartitions("pivot", "far", "id")

    def block(batches):
        """Blocks of neighbouring queries, their tile, and for each pivot where its vectors have to lie."""
        seen = 0
        for batch in batches:
            for a in range(0, batch.num_rows, QUERY_ROWS):
                part = batch.slice(a, QUERY_ROWS)
                raw = b"".join(pylist(part, "x"))
                q = np.frombuffer(raw).reshape(part.num_rows, dim)
                floor = part.column("floor").to_numpy()
                d = distances(q, np.zeros(len(q)), centres)
                room = (q * q).sum(1) + square - 2 * floor.astype(float)
                radius = np.where(floor == _NONE, np.inf, np.sqrt(np.maximum(room, 0)) + 1e-6 * (1 + reach))
                spans = [{"pivot": p, "from": float((d[:, p] - radius).min()), "to": float((d[:, p] + radius).max()), "mid": float(d[:, p].mean())} for p in range(len(centres))]
                tile = TaskContext.get().partitionId() << 32 | seen // tile_rows
                seen += part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([tile], pa.int64()), pa.array([part.column("id").to_numpy().tobytes()], pa.binary()), pa.array([q.astype(query_kind).tobytes()], pa.binary()), pa.array([floor.tobytes()], pa.binary()),
                                                  pa.array([spans], pa.list_(pa.struct([("pivot", pa.int32()), ("from", pa.float64()), ("to", pa.float64()), ("mid", pa.float64())])))], names=["tile", "ids", "xs", "floors", "spans"])

    blocks = staged(on_workers(dealt, block, "tile long, ids binary, xs binary, floors binary, spans array<struct<pivot:int,from:double,to:double,mid:double>>"), "blocks")
    # the annuli that are open to a tile are dealt over several tasks, more of them the more annuli there are
    shards = max(SHARDS, -(-annuli.count() // SHARD_ANNULI))
    spans = blocks.select("tile", F.explode("spans").alias("s")).groupBy("tile", F.col("s.pivot").alias("pivot")).agg(
        F.min("s.from").alias("from"), F.max("s.to").alias("to"), F.avg("s.mid").alias("mid"))
    spans = spans.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    rings = annuli.select("annulus", "pivot", "lo", "hi", F.pmod(F.xxhash64("annulus"), F.lit(shards)).cast("int").alias("shard"))
    open_ = rings.join(spans, ["pivot", "shard"]).filter("hi >= `from` and lo <= `to`").select(
        "annulus", "tile", "shard", F.greatest(F.col("lo") - F.col("mid"), F.col("mid") - F.col("hi"), F.lit(0.0)).alias("gap"))
    # a tile's queries go to each of its shards once, an annulus to each tile once
    sent = open_.join(annuli, "annulus").select("tile", "shard", "gap", "annulus", "pivot", "lo", "hi", "ids", "xs", F.lit(None).cast("binary").alias("floors"))
    asked = blocks.join(open_.select("tile", "shard").distinct(), "tile").select(
        "tile", "shard", F.lit(-1.0).alias("gap"), *[F.lit(None).cast(t).alias(c) for c, t in (("annulus", "long"), ("pivot", "int"), ("lo", "double"), ("hi", "double"))], "ids", "xs", "floors")
    # little to read but much to compute: a stated number of partitions, which small sizes do not merge
    parts = min(max(1, tiles) * shards, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    work = asked.unionAll(sent).repartition(parts, "tile", "shard").sortWithinPartitions("tile", "shard", "gap", "annulus")

    def expand(batches) -> Iterator[pa.RecordBatch]:
        """The queries of a tile first, then its annuli from the nearest outwards."""
        own, held = None, []
        best = q = d = floor = both = None

        def done():
            if best is None:
                return
            for a in range(0, len(q), QUERY_ROWS):
                rows = [(int(best.query_ids[i]), int(v), int(s)) for i in range(a, min(a + QUERY_ROWS, len(q))) for v, s in zip(best.ids[i], best.scores[i]) if s != _NONE and s >= floor[i]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if own != (row["tile"], row["shard"]):
                    yield from done()
                    own, held, best = (row["tile"], row["shard"]), [], None
                if row["floors"] is not None:
                    held.append((row["ids"], row["xs"], row["floors"]))
                    continue
                if best is None:
                    ids, xs, floors = (b"".join(c) for c in zip(*held))
                    ids, floor, held = np.frombuffer(ids, np.int64), np.frombuffer(floors, np.int64), []
                    q = np.frombuffer(xs, query_kind).reshape(len(ids), dim).astype(float)
                    d, best = distances(q, np.zeros(len(q)), centres), Best(ids, k)
                    both = (q * q).sum(1) + square
                # triangle inequality: |q - x| is at least the gap between the distances to the pivot
                at = d[:, row["pivot"]]
                gap = np.maximum(np.maximum(row["lo"] - at, at - row["hi"]) - 1e-6 * (1 + reach), 0)
                bound = (both - gap * gap) / 2
                rows = np.flatnonzero(bound >= np.maximum(best.floor(), floor) - 0.5)
                if len(rows):
                    vec = np.frombuffer(row["ids"], np.int64)
                    x = np.frombuffer(row["xs"], kind).reshape(len(vec), dim).astype(float)
                    for a in range(0, len(rows), QUERY_ROWS):
                        some = rows[a:a + QUERY_ROWS]
                        best.add(some, products(q[some], x), vec)
        yield from done()

    found = on_workers(work, expand, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
