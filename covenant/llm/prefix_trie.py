"""Prefix trie over conversations that are rebuilt from two parts.

A conversation ``c`` is rebuilt from the first ``h`` turns of its base (``c`` less
its last two digits) and its own turns after the first ``h``. The rebuilt texts
are never formed. Each turn is hashed once; a sequence of ``n`` turns has the
fingerprint ``(n, sum of hash(i) * B**(i - 1))`` in a field, and two sequences
put together have the product

    (n, x) * (m, y) = (n + m, x + B**n * y)

Running products over the *stored* conversations are formed once
(``scan.running``; a conversation of any length is dealt over many tasks). The
rebuilt prefix that ends at own turn ``k`` is then ``head * suffix``, where the
suffix's product follows from two stored ones: ``(P(k) - P(h)) / B**h``.

Prefixes are grouped by depth and fingerprint (two hashes of 61 bits). A group is
one node if its members agree in their parent's fingerprint and in the hash of
their last turn, and if the turns that stored references of that hash name are
equal as texts; by induction over the depth the prefixes are equal then. If any group
fails, all is done again with other hashes, so the result is exact.

Sums over subtrees take no rounds: a node's smallest member owns it, the nodes
that a conversation owns are the lower end of its path, and a conversation adds
what it owns to each node above.

Nulls and ties: null roles and texts are empty. Turns are ordered by turn number,
null first, then by the first 64 characters of role and text, then by hash (rows
alike in all of that are alike). Rows without ``conv_id`` take no part. Remainders
have the sign of ``conv_id``. A conversation whose rebuilt form has no turn is a
member of the root alone. An empty table gives no nodes.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import on_workers, pylist, staged
from .scan import running

#: turns that a head has at most
MOST = 5
#: conversations a piece when identifiers are joined
PIECE = 4096
_KEY = ["depth", "f1", "f2"]


def ring(seed: int) -> tuple[int, int, int]:
    """(prime, base, base) of the fingerprints; another seed, other hashes."""
    prime = (1 << 61) - 1
    return prime, pow(1_000_003, 3 + seed, prime), pow(998_244_353, 5 + seed, prime)


class Product:
    """Fingerprints as tuples (number of turns, residue, residue)."""

    unit = (0, 0, 0)

    def __init__(self, seed: int):
        self.prime, *self.bases = ring(seed)

    def times(self, x: tuple, y: tuple) -> tuple:
        return (x[0] + y[0], *((a + pow(b, x[0], self.prime) * c) % self.prime for a, b, c in zip(x[1:], self.bases, y[1:])))

    def suffix(self, whole: tuple, head: tuple) -> tuple:
        """``y`` with ``head * y = whole``."""
        return (whole[0] - head[0], *((c - a) * pow(b, -head[0], self.prime) % self.prime for a, b, c in zip(head[1:], self.bases, whole[1:])))

    def without_last(self, whole: tuple, last: tuple) -> tuple:
        return (whole[0] - 1, *((a - pow(b, whole[0] - 1, self.prime) * c) % self.prime for a, b, c in zip(whole[1:], self.bases, last)))


def turns(conversations: DataFrame, seed: int) -> DataFrame:
    """conv, turn, role, text and the turn's two hashes; nulls as stated."""
    prime = ring(seed)[0]
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("conv is not null")
    return rows.select("*", F.pmod(F.xxhash64("role", "text", F.lit(seed)), F.lit(prime)).alias("h1"),
                       F.pmod(F.xxhash64("text", F.lit(seed + 1), "role"), F.lit(prime)).alias("h2"))


def rebuilt_paths(conversations: DataFrame, seed: int) -> DataFrame:
    """A row for each rebuilt conversation and depth: fingerprint (f1, f2), that
    of the parent (p1, p2), hash and length of the last turn, the stored turn
    that it refers to, and whether the conversation ends there."""
    product = Product(seed)
    said = turns(conversations, seed).select("conv", "turn", F.substring("role", 1, 64).alias("r"), F.substring("text", 1, 64).alias("t"), "h1", "h2", F.char_length("text").cast("long").alias("len"))
    stored = running(said, "conv", [F.col(c) for c in ("turn", "r", "t", "h1", "h2")], lambda row: (1, row["h1"], row["h2"]), product.unit, product.times,
                     ("n", "a1", "a2"), ("h1", "h2"), "trie-turns").drop("r", "t")
    head = F.when(F.col("n") <= MOST, F.struct("n", "turn", "h1", "h2", "len", "a1", "a2"))
    convs = stored.groupBy("conv").agg(F.max("n").alias("total"), F.sort_array(F.collect_list(head)).alias("own"))
    convs = convs.withColumn("h", F.crc32(F.col("conv").cast("string")) % F.lit(MOST + 1)).withColumn("base", F.col("conv") - F.col("conv") % 100)
    bases = convs.select(F.col("conv").alias("base"), F.col("own").alias("items"))
    m = F.least(F.col("h"), F.greatest(F.size("items"), F.lit(0)).cast("long"))
    info = staged(convs.join(bases, "base", "left").withColumn("items", F.coalesce("items", F.slice("own", 1, 0))).withColumn("m", m)
                  .withColumn("items", F.slice("items", F.lit(1), F.col("m").cast("int")))
                  .withColumn("length", F.col("m") + F.greatest(F.col("total") - F.col("h"), F.lit(0))), "trie-convs")
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    roots = info.select("conv", zero.alias("depth"), zero.alias("f1"), zero.alias("f2"), none.alias("p1"), none.alias("p2"), none.alias("h1"), none.alias("h2"),
                        zero.alias("len"), none.alias("ref_conv"), none.alias("ref_turn"), (F.col("length") == 0).alias("ends"))
    before = F.get("items", F.col("i") - 1)
    heads = info.select("conv", "base", "length", "items", F.posexplode("items").alias("i", "x")).select(
        "conv", F.col("x.n").alias("depth"), F.col("x.a1").alias("f1"), F.col("x.a2").alias("f2"), F.coalesce(before["a1"], zero).alias("p1"), F.coalesce(before["a2"], zero).alias("p2"),
        F.col("x.h1").alias("h1"), F.col("x.h2").alias("h2"), F.col("x.len").alias("len"), F.col("base").alias("ref_conv"), F.col("x.turn").alias("ref_turn"), (F.col("length") == F.col("x.n")).alias("ends"))
    last, skipped = F.get("items", F.col("m").cast("int") - 1), F.get("own", F.col("h").cast("int") - 1)
    put = info.filter("total > h").select("conv", "h", "m", "length", *[F.coalesce(x[f"a{i}"], zero).alias(f"{c}{i}") for c, x in (("head", last), ("skip", skipped)) for i in (1, 2)])
    own = stored.join(put, "conv").filter("n > h")

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {name: pylist(batch, name) for name in ("n", "h", "m", "a1", "a2", "h1", "h2", "head1", "head2", "skip1", "skip2")}
            out = []
            for i in range(batch.num_rows):
                suffix = product.suffix((c["n"][i], c["a1"][i], c["a2"][i]), (c["h"][i], c["skip1"][i], c["skip2"][i]))
                whole = product.times((c["m"][i], c["head1"][i], c["head2"][i]), suffix)
                out.append((*whole, *product.without_last(whole, (c["h1"][i], c["h2"][i]))[1:]))
            made = [pa.array(v, pa.int64()) for v in (zip(*out) if out else [[]] * 5)]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), *made, *[batch.column(x) for x in ("h1", "h2", "len", "conv", "turn", "length")]],
                                             names=["conv", "depth", "f1", "f2", "p1", "p2", "h1", "h2", "len", "ref_conv", "ref_turn", "length"])

    tails = on_workers(own, combined, "conv long, depth long, f1 long, f2 long, p1 long, p2 long, h1 long, h2 long, len long, ref_conv long, ref_turn long, length long")
    return staged(roots.unionByName(heads).unionByName(tails.withColumn("ends", F.col("depth") == F.col("length")).drop("length")), "trie-paths")


def grouped(paths: DataFrame) -> DataFrame:
    """The nodes: members, smallest member, parent, and whether the members'
    parents and hashes agree; with them the least turn referred to."""
    told, ref = F.struct("p1", "p2", "h1", "h2", "len"), F.struct("ref_conv", "ref_turn")
    out = paths.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv"), F.min(told).alias("told"), F.max(told).alias("most"),
                                   F.min(ref).alias("ref"))
    return staged(out.select(*_KEY, "n_convs", "conv", "told.*", "ref.*", (F.col("told") != F.col("most")).alias("torn")), "trie-nodes")


def disproved(nodes: DataFrame, conversations: DataFrame, seed: int) -> bool:
    """Whether some node holds unequal prefixes: its members differ in parent
    or hash, or turns of equal hash, to which its references may lead, differ
    as texts. Turns are sorted by hash and compared with their neighbours; a hash
    that many turns share spans tasks, whose first and last turns are compared
    in the end."""
    if not nodes.filter("torn").isEmpty():
        return True
    said = turns(conversations, seed).select("h1", "h2", F.xxhash64("conv", "turn").alias("x"), "role", "text")
    dealt = said.repartitionByRange("h1", "h2", "x").sortWithinPartitions("h1", "h2").drop("x")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        differ = False
        for batch in batches:
            for row in zip(*(pylist(batch, c) for c in ("h1", "h2", "role", "text"))):
                differ |= last is not None and last[:2] == row[:2] and last != row
                first, last = first or row, row
        if first:
            yield pa.RecordBatch.from_pylist([dict(zip(("h1", "h2", "role", "text", "differ"), (*row, differ))) for row in (first, last)])

    ends = staged(on_workers(dealt, compared, "h1 long, h2 long, role string, text string, differ boolean"), "trie-compared")
    text = F.struct("role", "text")
    return not ends.groupBy("h1", "h2").agg((F.max("differ") | (F.min(text) != F.max(text))).alias("differ")).filter("differ").isEmpty()


def ends_hashes(paths: DataFrame) -> DataFrame:
    """SHA-256 of the identifiers that end at each node, in numeric order. Pieces
    of the list are made where the sorted rows lie; what one task then reads in
    order for a node is its finished pieces."""
    by = [*_KEY, "conv"]
    dealt = staged(paths.filter("ends").select(*by), "trie-ends").repartitionByRange(*by).sortWithinPartitions(*by)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def piece():
            return (*key, held[0], ",".join(map(str, held)))

        for batch in batches:
            for *node, conv in zip(*(pylist(batch, c) for c in by)):
                if held and (key != tuple(node) or len(held) == PIECE):
                    out.append(piece())
                    held = []
                key = tuple(node)
                held.append(conv)
            if len(out) > PIECE:
                yield pa.RecordBatch.from_pylist([dict(zip((*by, "text"), r)) for r in out])
                out = []
        if held:
            out.append(piece())
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip((*by, "text"), r)) for r in out])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, out = None, None, []
        for batch in batches:
            for *node, text in zip(*(pylist(batch, c) for c in (*_KEY, "text"))):
                if key != tuple(node):
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = tuple(node), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(text.encode())
            if len(out) > PIECE:
                yield pa.RecordBatch.from_pylist([dict(zip((*_KEY, "ends_sha256"), r)) for r in out])
                out = []
        if key is not None:
            out.append((*key, digest.hexdigest()))
            yield pa.RecordBatch.from_pylist([dict(zip((*_KEY, "ends_sha256"), r)) for r in out])

    key_types = "depth long, f1 long, f2 long"
    cut = on_workers(dealt, pieces, f"{key_types}, conv long, text string")
    return on_workers(cut.repartition(*_KEY).sortWithinPartitions(*by), digests, f"{key_types}, ends_sha256 string")


def prefix_trie(conversations: DataFrame, seed: int = 0) -> DataFrame:
    """The nodes of the trie with their counts and subtree sums."""
    paths = rebuilt_paths(conversations, seed)
    nodes = grouped(paths)
    if disproved(nodes, conversations, seed):
        return prefix_trie(conversations, seed + 1)
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(F.count(F.lit(1)).alias("n_children"))
    known = nodes.join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))) \
                 .withColumn("worth", (F.col("n_convs") - 1) * F.col("len")).drop("torn", "h1", "h2", "len")
    known = staged(known, "trie-known")
    # along the nodes that a conversation owns, from the lowest up
    summed = running(known, "conv", [-F.col("depth")], lambda row: (row["worth"],), (0,), lambda x, y: (x[0] + y[0],), ("below",), ("worth",), "trie-sums")
    owners = summed.groupBy("conv").agg(F.min("depth").alias("top"), F.sum("worth").alias("all"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    above = paths.select("conv", *_KEY).join(owners, "conv").groupBy(*_KEY).agg(
        F.sum(F.when(F.col("depth") < F.col("top"), F.col("all")).otherwise(0)).alias("others"), F.sum("leaf").alias("n_leaves"))
    whole = staged(summed.join(above, _KEY, "left").join(ends_hashes(paths), _KEY, "left"), "trie-whole")
    parents = whole.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv").alias("parent_conv_id"))
    return whole.join(parents, ["depth", "p1", "p2"], "left").select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("below") + F.coalesce("others", F.lit(0))).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        F.col("ref_conv").alias("turn_conv_id"), F.col("ref_turn").alias("turn"))
