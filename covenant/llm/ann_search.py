"""Approximate nearest neighbours by learned partitions.

A neighbour graph over a bounded sample is cut into parts of equal size with
few edges between them (recursive spectral halves, refined by exchanges). A
small classifier learns, from a vector, where its neighbours lie. It then deals
*every* vector to its most probable part, and routes each query to the several
parts that it finds most probable; all vectors of these parts are scored again
exactly, by the cosine of the original vectors in double precision.

How many parts a query visits is measured, not guessed: a tenth of the sample
is held out of the training, and the smallest number is taken that finds
``RECALL`` of the held-out vectors' true neighbours in the sample. (In the whole
table neighbours are nearer than in a sample, so the sample errs on the safe
side.) Vectors without any structure need many of the parts.

A part may hold any share of the vectors: it is dealt into shards of about
``SHARD_BYTES``. A shard's vectors travel once and are held in a task; the
queries of its part stream past them in batches. Of equal vectors in a shard
the ``k + 1`` smallest identifiers are held, which no result can tell from all.

Fitting reads at most ``SAMPLE`` vectors and ``SAMPLE_BYTES``, by hash of the
identifier and the vector. Nulls and ties: vectors that are null, zero, or hold
a null or non-finite component take no part, nor do null identifiers; shorter
vectors are padded with zeros. Equal scores go to the smaller identifier. Rows
that repeat an identifier are separate candidates; a repeated query identifier
is answered once, for the least of its vectors, and candidates with the query's
identifier are left out. An empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import hash_sample, on_workers, pylist, staged

SAMPLE, SAMPLE_BYTES = 8192, 64 << 20
#: sample vectors a part at least, and parts at most
PART_ROWS, PARTS = 64, 64
NEIGHBOURS, HIDDEN, EPOCHS = 10, 128, 30
RECALL = 0.95
SHARD_BYTES = 8 << 20
QUERY_ROWS = 256
_RESULT = "query_id long, rank int, vec_id long, score double"


# ---------------------------------------------------------------- vectors

def usable(rows: DataFrame) -> DataFrame:
    """(id, x) of the rows that take part."""
    c = F.col("embedding")
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == F.lit(float("inf"))))
    some = F.exists(c, lambda v: v != 0)
    return rows.select(F.col("vec_id").cast("long").alias("id"), F.when(c.isNotNull() & ~bad & some, c).alias("x")).filter(
        F.col("x").isNotNull() & F.col("id").isNotNull())


def matrix(lists: list, dim: int) -> np.ndarray:
    out = np.zeros((len(lists), dim))
    for i, v in enumerate(lists):
        out[i, :len(v)] = v
    return out


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def scaled(x: np.ndarray) -> np.ndarray:
    """Each vector times a power of two, so that no square leaves the range of
    doubles; the cosine stays the same."""
    _, power = np.frexp(np.abs(x).max(1, initial=0))
    return np.ldexp(x, -power[:, None])


def units(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.maximum(lengths(x), 1e-300)[:, None]


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of row pairs. Sums run along a row, so a pair's score does not
    depend on what else stands in the matrix."""
    q, x = scaled(q), scaled(x)
    return (q * x).sum(1) / (lengths(q) * lengths(x))


# ---------------------------------------------------------------- fitting

def neighbours(x: np.ndarray, pool: np.ndarray, k: int, own: bool) -> np.ndarray:
    """The ``k`` rows of ``pool`` nearest to each row of unit vectors ``x``;
    with ``own`` the two are the same rows and a row is not its own neighbour."""
    out = np.zeros((len(x), min(k, len(pool) - own)), np.int64)
    for a in range(0, len(x), 1024):
        s = x[a:a + 1024] @ pool.T
        if own:
            s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        if out.shape[1]:
            out[a:a + 1024] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, :out.shape[1]]
    return out


def halves(rows: np.ndarray, cols: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Side (0 or 1) of ``n`` nodes of a graph of symmetric edges: the median of
    the second eigenvector of the normalised graph, then exchanges of the
    nodes that gain most on either side while fewer edges are cut."""
    degree = np.maximum(np.bincount(rows, minlength=n), 1).astype(float)
    root = np.sqrt(degree)
    v = np.random.default_rng(seed).normal(size=n)
    for _ in range(60):
        v -= root * (v @ root) / (root @ root)
        v = v + np.bincount(rows, weights=(v / root)[cols], minlength=n) / root  # shifted, so the largest is wanted
        v /= max(np.linalg.norm(v), 1e-300)
    side = np.zeros(n, np.int64)
    side[np.lexsort((np.arange(n), v / root))[n // 2:]] = 1
    for _ in range(40):
        differ = np.bincount(rows, weights=(side[rows] != side[cols]).astype(float), minlength=n)
        gain = 2 * differ - np.bincount(rows, minlength=n)
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        swaps = min(len(left), len(right))
        use = int((gain[left[:swaps]] + gain[right[:swaps]] > 0).sum())
        best = (side[rows] != side[cols]).sum()
        while use:
            trial = side.copy()
            trial[left[:use]], trial[right[:use]] = 1, 0
            if (trial[rows] != trial[cols]).sum() < best:
                break
            use //= 2
        if not use:
            break
        side = trial
    return side


def balanced_parts(near: np.ndarray, parts: int) -> np.ndarray:
    """Part of each node of the neighbour graph; part sizes differ by at most
    one for each halving. ``parts`` is a power of two."""
    n = len(near)
    a, b = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    rows, cols = np.concatenate([a, b]), np.concatenate([b, a])
    label, level = np.zeros(n, np.int64), 1
    while level < parts:
        new = label * 2
        for p in range(level):
            mine = np.flatnonzero(label == p)
            place = np.full(n, -1)
            place[mine] = np.arange(len(mine))
            inside = (place[rows] >= 0) & (place[cols] >= 0)
            new[mine] += halves(place[rows[inside]], place[cols[inside]], len(mine), level + p)
        label, level = new, level * 2
    return label


@dataclass
class Router:
    """The classifier (one hidden layer) and how many parts a query visits."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    visits: int = 1
    recall: float = 0.0

    @property
    def parts(self) -> int:
        return len(self.b2)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Unnormalised log probabilities of the parts, for unit vectors."""
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts by falling probability."""
        return np.argsort(-self.scores(x), axis=1, kind="stable")


def trained(x: np.ndarray, share: np.ndarray, epochs: int = EPOCHS, hidden: int = HIDDEN) -> Router:
    """Cross-entropy between the classifier and ``share``, the share of each
    vector's neighbours in each part (Adam, seeded batches)."""
    rng = np.random.default_rng(7)
    dim, parts = x.shape[1], share.shape[1]
    w = [rng.normal(size=(dim, hidden)) * np.sqrt(2.0), np.zeros(hidden), rng.normal(size=(hidden, parts)) / np.sqrt(hidden), np.zeros(parts)]
    mean, square = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 256):
            rows = order[a:a + 256]
            h = np.maximum(x[rows] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(1, keepdims=True))
            d = (p / p.sum(1, keepdims=True) - share[rows]) / len(rows)
            dh = (d @ w[2].T) * (h > 0)
            step += 1
            for i, g in enumerate((x[rows].T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                mean[i] = 0.9 * mean[i] + 0.1 * g
                square[i] = 0.999 * square[i] + 0.001 * g * g
                w[i] = w[i] - 0.004 * (mean[i] / (1 - 0.9 ** step)) / (np.sqrt(square[i] / (1 - 0.999 ** step)) + 1e-8)
    return Router(*w)


def fit(vectors: DataFrame, dim: int, k: int, sample: int = SAMPLE, parts: int = PARTS, recall: float = RECALL) -> Router:
    """The router for rows (id, x)."""
    most = max(PART_ROWS, min(sample, SAMPLE_BYTES // (8 * max(1, dim))))
    rows = hash_sample(vectors, ["id", "x"], most).orderBy("_rank").collect()
    x = units(matrix([r["x"] for r in rows], dim))
    _, first = np.unique(x, axis=0, return_index=True)
    x = x[np.sort(first)]  # copies teach nothing more
    held = np.arange(len(x)) % 10 == 9
    train, test = x[~held], x[held]
    wanted = 1
    while wanted * 2 <= min(parts, len(train) // PART_ROWS):
        wanted *= 2
    if wanted == 1:
        return Router(np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1, 1.0)
    near = neighbours(train, train, NEIGHBOURS, own=True)
    label = balanced_parts(near, wanted)
    share = np.zeros((len(train), wanted))
    np.add.at(share, (np.repeat(np.arange(len(train)), near.shape[1]), label[near].ravel()), 1)
    np.add.at(share, (np.arange(len(train)), label), 1)
    router = trained(train, share / share.sum(1, keepdims=True))
    own = router.order(train)[:, 0]
    order = router.order(test)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(wanted)[None, :], 1)
    true = neighbours(test, train, k, own=False)
    at = np.take_along_axis(place, own[true], 1)  # how far down the route each true neighbour lies
    found = np.cumsum(np.bincount(at.ravel(), minlength=wanted)) / max(1, at.size)
    router.visits = min(wanted, int(np.searchsorted(found, recall)) + 1)
    router.recall = float(found[router.visits - 1])
    return router


# ---------------------------------------------------------------- search

class Shard:
    """Vectors of one shard, by identifier; of equal vectors the k + 1 least
    identifiers."""

    def __init__(self, ids: list[int], raw: list[bytes], kind: str, dim: int, k: int):
        held: dict[bytes, int] = {}
        keep = []
        for i in sorted(range(len(ids)), key=lambda i: (ids[i], raw[i])):
            held[raw[i]] = n = held.get(raw[i], 0) + 1
            if n <= k + 1:
                keep.append(i)
        self.ids = np.array([ids[i] for i in keep], np.int64)
        self.x = np.frombuffer(b"".join(raw[i] for i in keep), kind).reshape(len(keep), dim).astype(float)
        self.unit, self.k = units(self.x), k

    def best(self, qids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the query, identifier, score) of each query's k best here."""
        if not len(self.ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        s = units(q) @ self.unit.T
        s[qids[:, None] == self.ids[None, :]] = -np.inf
        k = min(self.k, len(self.ids))
        least = -np.partition(-s, k - 1, axis=1)[:, k - 1]
        # a matrix product rounds by place; everything that near the k-th is scored again
        rows, cols = np.nonzero((s >= least[:, None] - 1e-9) & (s > -np.inf))
        score = cosines(q[rows], self.x[cols])
        order = np.lexsort((self.ids[cols], -score, rows))
        rows, cols, score = rows[order], cols[order], score[order]
        start = np.searchsorted(rows, rows)
        top = np.arange(len(rows)) - start < self.k
        return rows[top], self.ids[cols[top]], score[top]


def search(vectors: DataFrame, queries: DataFrame, k: int, **fitting) -> DataFrame:
    """query_id, rank, vec_id, score for rows (id, x) and queries (id, x)."""
    spark = vectors.sparkSession
    vectors = staged(vectors, "ann-vectors")
    queries = staged(queries.groupBy("id").agg(F.min("x").alias("x")), "ann-queries")
    longest = vectors.agg(F.max(F.size("x"))).first()[0]
    if longest is None:
        return spark.createDataFrame([], _RESULT)
    dim = max(longest, queries.agg(F.max(F.size("x"))).first()[0] or 0)
    kind = "<f4" if vectors.schema["x"].dataType.elementType.simpleString() == "float" else "<f8"
    router = fit(vectors, dim, k, **fitting)

    def dealt(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(pylist(batch, "x"), dim)
            own = router.order(units(x))[:, 0] if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch.column("id"), pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())], names=["part", "id", "x"])

    def routed(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(pylist(batch, "x"), dim)
            to = router.order(units(x))[:, :router.visits] if len(x) else np.zeros((0, router.visits), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([list(map(int, t)) for t in to], pa.list_(pa.int32())), batch.column("id"), pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())], names=["parts", "id", "x"])

    index = staged(on_workers(vectors, dealt, "part int, id long, x binary").withColumn("row", F.monotonically_increasing_id()), "ann-index")
    # at most PARTS rows: how many shards each part needs
    room = max(1, SHARD_BYTES // (np.dtype(kind).itemsize * dim))
    shards = {r["part"]: -(-r["count"] // room) for r in index.groupBy("part").count().collect()}
    count = F.element_at(F.create_map(*[F.lit(v) for p, n in shards.items() for v in (p, int(n))]), F.col("part"))
    data = index.select("part", F.pmod("row", count).cast("int").alias("shard"), F.lit(0).alias("kind"), "id", "x")
    asked = on_workers(queries, routed, "parts array<int>, id long, x binary").select(F.explode("parts").alias("part"), "id", "x")
    asked = asked.withColumn("n", count).filter("n is not null").select("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("shard"), F.lit(1).alias("kind"), "id", "x")
    work = data.unionByName(asked).repartition("part", "shard").sortWithinPartitions("part", "shard", "kind")

    def scored(batches) -> Iterator[pa.RecordBatch]:
        """A shard's vectors come first; its queries stream past them."""
        key, ids, raw, shard = None, [], [], None
        for batch in batches:
            rows = list(zip(*(pylist(batch, c) for c in ("part", "shard", "kind", "id", "x"))))
            asking: list[tuple[int, bytes]] = []

            def answers():
                for a in range(0, len(asking), QUERY_ROWS):
                    some = asking[a:a + QUERY_ROWS]
                    qids = np.array([i for i, _ in some], np.int64)
                    q = np.frombuffer(b"".join(v for _, v in some), kind).reshape(len(some), dim).astype(float)
                    at, found, score = shard.best(qids, q)
                    yield pa.RecordBatch.from_arrays([pa.array(qids[at]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

            for part, number, what, i, v in rows:
                if key != (part, number):
                    if asking:
                        yield from answers()
                    key, ids, raw, shard, asking = (part, number), [], [], None, []
                if what == 0:
                    ids.append(i)
                    raw.append(v)
                else:
                    if shard is None:
                        shard = Shard(ids, raw, kind, dim, k)
                        ids, raw = [], []
                    asking.append((i, v))
            if asking:
                yield from answers()

    found = on_workers(work, scored, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
