"""Exact deduplication by owners kept in Patricia tries.

Texts are dealt by (length, content hash). A task inserts the full byte strings
of one length that its hashes cover into one compressed radix trie, whose
terminal nodes hold the owner; strings share the edges of their common
beginnings, and texts are only equal when all their bytes are. A trie beyond
``spill_bytes`` moves its largest subtrees to temporary files of the task and
replays each on its own when the others are done.

Copies fold before that: each task folds the copies that it reads (a bounded
number of bytes of texts at a time) to one row. A text that a task met more than
once may be one that fills a third of the table: its rows are folded again in
groups of ``FAN_IN`` tasks before they meet at their partition, so that not even
one row a task reaches it.

Nulls and ties: a null text counts as empty (so null and empty texts are
copies of each other); a null identifier sorts below all others. Rows that
repeat identifier and text are copies too: ``owners`` has one row for them, with
the payload whose hash is largest (for ``keep="smallest"``: smallest), whatever
order they are read in, and ``membership`` flags every such row of the owner as
kept. An empty table gives an empty result; other columns are ignored or, with
``payload``, carried from the owning row.
"""
from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructType

from .common import NULL_ID, id_or_null, long_id, on_workers, pylist, salted_left_join, staged, utf8, whole_text

SPILL_BYTES = 64 << 20
#: bytes of texts that a task folds at a time, and tasks whose repeated texts are folded together
FOLD_BYTES, FAN_IN = 16 << 20, 64
_NODE_BYTES = 200


class _Node:
    __slots__ = ("label", "children", "value")

    def __init__(self, label: bytes):
        self.label, self.children, self.value = label, {}, None


def _common(a: bytes, b: memoryview) -> int:
    """Length of the longest common prefix, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class PatriciaTrie:
    """Compressed radix trie over byte strings with a value at each terminal.
    ``merge`` joins the value in place with one that arrives for the same string."""

    def __init__(self, merge):
        self.root, self.merge, self.nbytes = _Node(b""), merge, 0

    def insert(self, key: bytes, value) -> None:
        node, rest = self.root, memoryview(key)
        while rest:
            child = node.children.get(rest[0])
            if child is None:
                child = _Node(bytes(rest))
                node.children[rest[0]] = child
                self.nbytes += len(rest) + _NODE_BYTES
                node, rest = child, rest[len(rest):]
                break
            n = _common(child.label, rest)
            if n < len(child.label):  # the edge splits at the first different byte
                upper = _Node(child.label[:n])
                child.label = child.label[n:]
                upper.children[child.label[0]] = child
                node.children[rest[0]] = upper
                self.nbytes += _NODE_BYTES
                child = upper
            node, rest = child, rest[n:]
        node.value = value if node.value is None else self.merge(node.value, value)

    def nodes(self, node: _Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, _Node]]:
        """(string up to and with the node's label, node), the node itself first."""
        stack = [(node or self.root, prefix)]
        while stack:
            node, prefix = stack.pop()
            key = prefix + node.label
            yield key, node
            stack.extend((c, key) for c in node.children.values())

    def items(self, node: _Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, object]]:
        return ((key, n.value) for key, n in self.nodes(node, prefix) if n.value is not None)


def _weight(node: _Node) -> int:
    """Bytes of a subtree as ``insert`` counts them."""
    total, stack = 0, [node]
    while stack:
        node = stack.pop()
        total += len(node.label) + _NODE_BYTES
        stack.extend(node.children.values())
    return total


@dataclass
class Told:
    """What the tries of a task did."""

    tries: int = 0
    branches: int = 0
    spills: int = 0


class SpillingTrie:
    """A trie bounded by ``limit`` bytes: beyond it the largest subtrees below
    the first branching go to temporary files until half is left; later strings
    under their prefixes follow them there, and each file is built again alone
    once the others are done."""

    def __init__(self, merge, limit: int = SPILL_BYTES, told: Told | None = None):
        self.merge, self.limit, self.told = merge, limit, told or Told()
        self.trie, self.spilled = PatriciaTrie(merge), {}
        self.told.tries += 1

    def insert(self, key: bytes, value) -> None:
        for prefix, file in self.spilled.items():
            if key.startswith(prefix):
                pickle.dump((key, value), file)
                return
        self.trie.insert(key, value)
        if self.trie.nbytes > self.limit:
            self._spill()

    def _spill(self) -> None:
        node, prefix = self.trie.root, b""
        while len(node.children) == 1 and node.value is None:
            node = next(iter(node.children.values()))
            prefix += node.label
        sizes = {byte: _weight(child) for byte, child in node.children.items()}
        for byte in sorted(sizes, key=sizes.get, reverse=True):
            if self.trie.nbytes <= self.limit // 2 or len(node.children) == 1 and node.value is None:
                break  # the last string alone stays: nothing to split
            child = node.children.pop(byte)
            file = tempfile.TemporaryFile()
            for item in self.trie.items(child, prefix):
                pickle.dump(item, file)
            self.spilled[prefix + child.label] = file
            self.trie.nbytes -= sizes[byte]
            self.told.spills += 1

    def drain(self) -> Iterator[tuple[bytes, object]]:
        self.told.branches += sum(len(n.children) > 1 for _, n in self.trie.nodes())
        yield from self.trie.items()
        self.trie = PatriciaTrie(self.merge)
        for file in self.spilled.values():
            file.seek(0)
            part = SpillingTrie(self.merge, self.limit, self.told)
            while True:
                try:
                    part.insert(*pickle.load(file))
                except EOFError:
                    break
            file.close()
            yield from part.drain()


def owned(rows: Iterable[tuple[int, bytes, tuple]], merge: Callable, limit: int = SPILL_BYTES, told: Told | None = None) -> Iterator[tuple[bytes, tuple]]:
    """(text, merged value) of rows (length, text, value) that stand together by
    length: a trie for each length."""
    own, trie = None, None
    for n_bytes, text, value in rows:
        if own != n_bytes:
            if trie is not None:
                yield from trie.drain()
            own, trie = n_bytes, SpillingTrie(merge, limit, told)
        trie.insert(text, value)
    if trie is not None:
        yield from trie.drain()


def _later(a, b):
    """(id, tie, count, payload): the larger (identifier, hash of the payload) owns; counts add up."""
    top = a if a[:2] >= b[:2] else b
    return top[0], top[1], a[2] + b[2], top[3]


def _earlier(a, b):
    top = a if a[:2] <= b[:2] else b
    return top[0], top[1], a[2] + b[2], top[3]


def owners(docs: DataFrame, keep: str = "largest", payload: tuple[str, ...] = (), with_text: bool = False,
           spill_bytes: int = SPILL_BYTES) -> DataFrame:
    """One row per distinct text: text_sha256, n_bytes, keep_id, group_size,
    the text with ``with_text``, and the ``payload`` columns of the owner."""
    merge = _later if keep == "largest" else _earlier
    carried = [F.col(c).alias(f"_p{i}") for i, c in enumerate(payload)]
    tie = F.xxhash64(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(map(F.col, payload))]))) if payload else F.lit(0).cast("long")
    rows = docs.select(long_id().alias("_id"), whole_text().alias("_text"), tie.alias("_tie"), *carried)
    rows = rows.select("*", F.octet_length("_text").alias("_len"), F.xxhash64("_text").alias("_hash"), F.sha2("_text", 256).alias("_sha"),
                       F.lit(1).cast("long").alias("_n"), F.lit(-1).cast("long").alias("_group"))
    schema = rows.schema
    extra = [f"_p{i}" for i in range(len(payload))]
    width = range(len(extra))

    def fold(batches):
        """Copies among the rows of a task become one row; at most FOLD_BYTES of
        texts are held. Texts met more than once get the task's group."""
        group = TaskContext.get().partitionId() // FAN_IN
        held: list[pa.RecordBatch] = []
        best: dict[bytes, list] = {}  # text -> [id, tie, batch, row, count]
        size = 0

        def thinned():
            """The batches without the rows that are not best of their text."""
            parts, n = [], 0
            for k, batch in enumerate(held):
                mine = [b for b in best.values() if b[2] == k]
                if mine:
                    parts.append(batch.take(pa.array([b[3] for b in mine], pa.int64())))
                    for b in mine:
                        b[2], b[3], n = -1, n, n + 1
            for b in best.values():
                b[2] = 0
            return pa.Table.from_batches(parts).combine_chunks().to_batches()

        def folded():
            for k, batch in enumerate(held):
                mine = [b for b in best.values() if b[2] == k]
                if mine:
                    out = batch.take(pa.array([b[3] for b in mine], pa.int64()))
                    out = out.set_column(out.schema.get_field_index("_n"), "_n", pa.array([b[4] for b in mine], pa.int64()))
                    yield out.set_column(out.schema.get_field_index("_group"), "_group", pa.array([group if b[4] > 1 else -1 for b in mine], pa.int64()))

        for batch in batches:
            ids, ties, counts = (pylist(batch, c) for c in ("_id", "_tie", "_n"))
            held.append(batch)
            for i, text in enumerate(utf8(batch, "_text")):
                old = best.get(text)
                if old is None:
                    best[text] = [ids[i], ties[i], len(held) - 1, i, counts[i]]
                    size += len(text) + _NODE_BYTES
                else:
                    mine = merge((old[0], old[1], 0, old[2:4]), (ids[i], ties[i], 0, [len(held) - 1, i]))
                    best[text] = [mine[0], mine[1], *mine[3], old[4] + counts[i]]
            if size <= FOLD_BYTES < sum(b.nbytes for b in held):
                held = thinned()
            if size > FOLD_BYTES:
                yield from folded()
                held, best, size = [], {}, 0
        yield from folded()

    out_schema = StructType([f for f in schema.fields if f.name in extra])
    for name, kind in (("text_sha256", "string"), ("n_bytes", "long"), ("keep_id", "long"), ("group_size", "long")):
        out_schema = out_schema.add(name, kind)
    if with_text:
        out_schema = out_schema.add("text", "string")

    def own(batches):
        names = [f.name for f in out_schema.fields]
        arrow: dict = {}

        def rows_of():
            for batch in batches:
                if not arrow:
                    arrow.update({c: batch.schema.field(c).type for c in extra} | {"text_sha256": pa.string(), "n_bytes": pa.int64(), "keep_id": pa.int64(), "group_size": pa.int64()})
                columns = [pylist(batch, c) for c in ("_len", "_id", "_tie", "_n", "_sha", *extra)]
                for text, n_bytes, doc, t, n, *more in zip(utf8(batch, "_text"), *columns):
                    yield n_bytes, text, (doc, t, n, more)

        def emit(done):
            cols = {c: [] for c in names}
            for text, (best, _, n, (sha, *more)) in done:
                for i in width:
                    cols[extra[i]].append(more[i])
                for c, v in (("text_sha256", sha), ("n_bytes", len(text)), ("keep_id", best), ("group_size", n)):
                    cols[c].append(v)
                if with_text:
                    cols["text"].append(text)
            return pa.RecordBatch.from_arrays([pa.array(cols[c], pa.binary()).cast(pa.string()) if c == "text" else pa.array(cols[c], arrow[c]) for c in names], names=names)

        done, held = [], 0
        for item in owned(rows_of(), merge, spill_bytes):
            done.append(item)
            held += _NODE_BYTES + (len(item[0]) if with_text else 0)
            if held > 4 << 20:
                yield emit(done)
                done, held = [], 0
        if done:
            yield emit(done)

    folded = staged(on_workers(rows, fold, schema), "folded")
    again = folded.filter("_group >= 0").repartition("_len", "_hash", "_group")
    folded = folded.filter("_group < 0").unionByName(on_workers(again, fold, schema))
    dealt = folded.repartition("_len", "_hash").sortWithinPartitions("_len", "_hash")
    out = on_workers(dealt, own, out_schema)
    return out.select("text_sha256", "n_bytes", F.col("keep_id"), "group_size", *(["text"] if with_text else []),
                      *[F.col(f"_p{i}").alias(c) for i, c in enumerate(payload)])


def membership(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    copied = staged(owners(docs, keep).filter("group_size > 1"), "owners").select(
        F.col("text_sha256"), F.col("n_bytes"), "keep_id", "group_size")
    rows = docs.select(long_id().alias("_id"), whole_text().alias("_text")).select(
        "_id", F.sha2("_text", 256).alias("text_sha256"), F.octet_length("_text").cast("long").alias("n_bytes"))
    out = salted_left_join(rows, copied, ["text_sha256", "n_bytes"], F.col("_id"))
    return out.select(
        id_or_null("_id").alias("doc_id"),
        F.coalesce("keep_id", "_id").alias("_keep"),
        F.coalesce("group_size", F.lit(1).cast(LongType())).alias("group_size"),
        (F.coalesce("keep_id", "_id") == F.col("_id")).alias("kept"), "text_sha256",
    ).select("doc_id", F.when(F.col("_keep") != NULL_ID, F.col("_keep")).alias("keep_id"), "group_size", "kept", "text_sha256")


def survivors(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The owning rows, with the columns of ``docs`` in their order; a text that
    is null in its row stays null."""
    names = docs.columns
    renamed = docs.select("doc_id", "text", *[F.col(c).alias(f"_c{i}") for i, c in enumerate(names)], F.col("text").isNull().alias("_null"))
    out = owners(renamed, keep, payload=(*(f"_c{i}" for i, c in enumerate(names) if c not in ("doc_id", "text")), "_null"), with_text=True)
    back = {"doc_id": id_or_null("keep_id").cast(docs.schema["doc_id"].dataType), "text": F.when(~F.col("_null"), F.col("text"))}
    return out.select(*[back.get(c, F.col(f"_c{i}")).alias(c) for i, c in enumerate(names)])
