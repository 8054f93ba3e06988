"""Removal of repeated byte strings by a hash-compared suffix sort.

Every byte goes that lies in a ``length``-byte string which also starts
earlier: in a document with a smaller identifier, or before it in the same one.

1. Anchors. Of the ``k``-byte strings inside a window of ``length`` bytes, the
   leftmost with the least hash is the window's anchor, so equal windows have
   the same anchor at the same place, and each window belongs to one anchor.
   The consecutive windows of one anchor make a segment. Batch by batch, equal
   segments (hashes first, then their bytes) fold into their first; of a segment
   that meets others under the same anchor hash, only one row per batch goes on
   to say so. So a passage in a third of all documents costs a row per record
   batch in one partition, which reads its rows as a stream.
2. Under each anchor hash, segments of equal content hash are left for a
   comparison of their bytes, and segments that differ for the suffix sort; all
   others are unique, as their windows occur nowhere else.
3. Comparison: segments that equal an earlier one byte by byte are removed. Of
   a collision of hashes, one segment of each content is sorted as well.
4. Suffix sort. Of the segments left, the suffixes that start at the anchor and
   the reversed prefixes that end there are merge-sorted. Prefix polynomial
   hashes give the common extension of two of them by binary search, so a
   comparison takes logarithmic time; the extensions between neighbours in the
   order are verified byte by byte, and a collision sends its group through
   a sort of the bytes themselves. Two windows are equal when the extensions
   on both sides cover them; of equal windows the earliest stays. Anchors with
   over ``HOT`` segments are split: each window becomes a segment of its own
   under its own hash, copies fold task by task before they are dealt, and the
   bytes of the others are compared as in step 3.
5. A document's removed windows are joined into runs.

Nulls and ties: a null text counts as empty, a null identifier sorts first.
Rows that repeat an identifier are the parts of one document, in the order of
their text, and are returned one by one. An empty table gives an empty result;
other columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import id_or_null, long_id, on_workers, pylist, salted_left_join, slices, staged, utf8, whole_text

LENGTH, K = 100, 32
HOT = 512
PIECE = 1 << 20
#: odd multipliers of the two polynomial hashes
_P, _Q = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: the part of a repeated identifier stands above the start in a position
_PART = 40


def _u(x) -> np.uint64:
    return np.uint64(x % 2 ** 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, _u(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class PrefixHash:
    """Polynomial hashes of all substrings from the hashes of all prefixes."""

    def __init__(self, data: np.ndarray, base: int = _P):
        n = len(data)
        self.back = _powers(pow(base, -1, 2 ** 64), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(base, n + 1)[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.back[start]

    def extension(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Length of the common extension to the right of places a and b, at
        most ``limit``, by binary search over equal hashes."""
        lo, hi = np.zeros(len(a), np.int64), limit.copy()
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = self.of(a, mid) == self.of(b, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo


def segments(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, k: int = K, bits: int = 64) -> tuple[np.ndarray, ...]:
    """For each segment of the pieces that end at ``ends``: anchor hash, content
    hash (of ``bits`` bits), piece, first window, number of windows, and the anchor's
    distance from the first window. No window crosses the end of a piece."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 6
    first, second = PrefixHash(data, _P), PrefixHash(data, _Q)
    n = len(data) - k + 1
    grams = _stir((first.sums[k:] - first.sums[:-k]) * first.back[:n])
    least, place, span, width = grams, np.arange(n, dtype=np.int32), 1, length - k + 1
    while span < width:  # the least of spans that double, the leftmost of equals
        step = min(span, width - span)
        later = least[step:] < least[:-step]
        place = np.where(later, place[step:], place[:-step])
        least = np.where(later, least[step:], least[:-step])
        span += step
    sizes = np.diff(ends, prepend=0)
    inside = np.ones(len(data), bool)
    for end, size in zip(ends.tolist(), sizes.tolist()):
        inside[max(end - size, end - length + 1):end] = False
    window = np.flatnonzero(inside[:len(place)])
    place = place[window].astype(np.int64)
    if not len(window):
        return (np.zeros(0, np.int64),) * 6
    cuts = np.flatnonzero(_runs(place) | np.concatenate([[True], window[1:] != window[:-1] + 1]))
    start, count, anchor = window[cuts], np.diff(cuts, append=len(window)), place[cuts]
    off = anchor - start
    content = _stir(second.of(start, count + length - 1)) ^ _stir(off.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019) + count.astype(np.uint64))
    content >>= np.uint64(64 - bits)
    return grams[anchor].view(np.int64), content.view(np.int64), np.searchsorted(ends, start, "right"), start, count, off


def pieces(text: bytes, length: int = LENGTH, size: int = PIECE) -> Iterator[tuple[int, np.ndarray]]:
    """Overlapping pieces of a long text; each window lies in one of them."""
    for a in range(0, max(1, len(text) - length + 1), size):
        yield a, np.frombuffer(text, np.uint8, min(len(text) - a, size + length - 1), a)


#: kinds of rows: windows to remove; a segment that may be unique; a segment to
#: sort; a segment to sort that tells the others under its anchor hash; a segment
#: to compare with others of its content hash; a single window to compare
_GONE, _ALONE, _SORT, _SIGN, _CHECK, _WINDOW = 0, 1, 2, 3, 4, 5
#: key is the hash where rows have to meet, else it spreads them; s is the content
#: hash, and after step 2 the anchor hash; size holds kind, number of windows and
#: the anchor's distance
_FIELDS = "key long, s long, doc long, pos long, size long"
_NAMES = ["key", "s", "doc", "pos", "size"]


def _runs(*keys: np.ndarray) -> np.ndarray:
    """True where a row's keys differ from the row before."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def _size(kind, n, off) -> np.ndarray:
    return (np.asarray(kind, np.int64) << 48) | (n << 16) | off


def _batch(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_NAMES)


def _spread(doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return _stir(doc.astype(np.uint64) * _u(_P) + pos.astype(np.uint64)).view(np.int64)


def _gone(doc: np.ndarray, pos: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Windows to remove, neighbours joined (at most 2**31 windows a row)."""
    order = np.lexsort((pos, doc))
    doc, pos, n = doc[order], pos[order], n[order]
    new = _runs(doc)
    new[1:] |= pos[1:] != pos[:-1] + n[:-1]
    at = np.flatnonzero(new)
    n = np.add.reduceat(n, at) if len(at) else n
    doc, pos = doc[at], pos[at]
    return _batch(_spread(doc, pos), np.zeros(len(doc), np.int64), doc, pos, _size(_GONE, n, 0))


def _unpacked(batch: pa.RecordBatch) -> list[np.ndarray]:
    key, s, doc, pos, size = (batch.column(c).to_numpy() for c in _NAMES)
    return [key, s, doc, pos, size >> 48, (size >> 16) & 0xFFFFFFFF, size & 0xFFFF]


def _folded(texts: list[bytes], length: int, h, s, doc, pos, n, off, which) -> Iterator[pa.RecordBatch]:
    """The segments of one record batch, equal ones folded into the first.
    Segments of equal hashes and other bytes are kept as different ones."""
    order = np.lexsort((pos, doc, s, h))
    h, s, doc, pos, n, off, which = (x[order] for x in (h, s, doc, pos, n, off, which))
    new_h, new_s = _runs(h), _runs(h, s)
    first = np.maximum.accumulate(np.where(new_s, np.arange(len(h)), 0))
    at, end = pos & ((1 << _PART) - 1), (pos & ((1 << _PART) - 1)) + n + length - 1
    later = np.flatnonzero(~new_s)
    mine, other = (zip(which[i].tolist(), at[i].tolist(), end[i].tolist()) for i in (later, first[later]))
    same = [texts[t][a:b] == texts[u][c:d] for (t, a, b), (u, c, d) in zip(mine, other)]
    new_s[later] = ~np.array(same, bool)
    group = np.cumsum(new_h) - 1
    shared = np.bincount(group, new_s)[group] > 1
    if not new_s.all():
        yield _gone(doc[~new_s], pos[~new_s], n[~new_s])
    far = new_s & (~shared | new_h)
    yield _batch(h[far], s[far], doc[far], pos[far], _size(np.where(shared[far], _SIGN, _ALONE), n[far], off[far]))
    near = new_s & shared & ~new_h
    if near.any():
        yield _batch(_spread(doc[near], pos[near]), h[near], doc[near], pos[near], _size(_SORT, n[near], off[near]))


def anchored(rows: DataFrame, length: int = LENGTH, k: int = K, bits: int = 64) -> DataFrame:
    """Step 1 for rows (doc, part, text)."""

    def run(batches):
        for batch in batches:
            found, held, texts, docs, parts = [], [], [], pylist(batch, "doc"), pylist(batch, "part")
            for some in slices(batch, "text", PIECE):
                for text in utf8(some, "text"):
                    i = len(texts)
                    texts.append(text)
                    for a, data in pieces(text, length):
                        held.append((i, docs[i], (parts[i] << _PART) + a, data))
                        if len(data) >= PIECE:
                            found.append(_together(held, length, k, bits))
                            held = []
                if held:
                    found.append(_together(held, length, k, bits))
                    held = []
            columns = [np.concatenate(c) for c in zip(*found)] if found else []
            if columns and len(columns[0]):
                yield from _folded(texts, length, *columns)

    return on_workers(rows, run, _FIELDS)


def _together(held, length: int, k: int, bits: int) -> tuple[np.ndarray, ...]:
    data = np.concatenate([d for *_, d in held])
    ends = np.cumsum([len(d) for *_, d in held])
    h, s, which, start, n, off = segments(data, ends, length, k, bits)
    texts = np.array([i for i, *_ in held], np.int64)
    docs = np.array([d for _, d, _, _ in held], np.int64)
    base = np.array([p - e + len(d) for (_, _, p, d), e in zip(held, ends.tolist())], np.int64)
    return h, s, docs[which], start + base[which], n, off, texts[which]


def _whole_runs(batches) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys from batches sorted by key, and
    ``None`` for a batch without rows."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            yield None
            continue
        key = batch.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut or (held and held[-1].column("key")[-1].as_py() != key[0]):
            held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def told(marked: DataFrame) -> DataFrame:
    """Step 2: windows to remove, segments to compare (content hash in key,
    anchor hash in s) and segments to sort (anchor hash in s). Rows of an
    anchor hash are a stream: of those read before, only the first of the
    content hash at hand is held."""
    dealt = marked.repartition("key").sortWithinPartitions("key", "s", "doc", "pos")

    def run(batches):
        held, known, sorted_, compared_ = None, False, False, False
        for batch in batches:
            key, s, doc, pos, kind, n, off = _unpacked(batch)
            passed = (kind == _GONE) | (kind == _SORT)
            if passed.any():
                yield _batch(key[passed], s[passed], doc[passed], pos[passed], _size(kind[passed], n[passed], off[passed]))
            rows = [x[~passed] for x in (key, s, doc, pos, kind, n, off)]
            if not len(rows[0]):
                continue
            if held is not None:
                rows = [np.concatenate([[x], y]) for x, y in zip(held, rows)]
            h, s, doc, pos, kind, n, off = rows
            new_h, new_s = _runs(h), _runs(h, s)
            group, run_ = np.cumsum(new_h) - 1, np.cumsum(new_s) - 1
            meets = (np.bincount(group, new_s) > 1) | (np.bincount(group, kind == _SIGN) > 0)
            meets[0] |= known and held is not None
            copied = np.bincount(run_) > 1
            check, sort = ~new_s | copied[run_], new_s & meets[group]
            # the row held has been given out before, as what it was then
            check[0] &= not (held is not None and compared_)
            sort[0] &= not (held is not None and sorted_)
            if check.any():
                yield _batch(s[check], h[check], doc[check], pos[check], _size(_CHECK, n[check], off[check]))
            if sort.any():
                yield _batch(_spread(doc[sort], pos[sort]), h[sort], doc[sort], pos[sort], _size(_SORT, n[sort], off[sort]))
            last = int(np.flatnonzero(new_s)[-1])
            carried = last == 0 and held is not None
            known = bool(meets[-1])
            compared_, sorted_ = bool(copied[-1]) or (carried and compared_), known
            held = [int(x[last]) for x in rows]

    return on_workers(dealt, run, _FIELDS)


class Equal:
    """Rows sorted by (kind, key, doc, pos): which equal an earlier one of their
    key byte by byte. Of a key, one row for each content is held."""

    def __init__(self):
        self.key, self.firsts = None, {}

    def _clash(self) -> list[tuple]:
        return [row for row in self.firsts.values()] if self.key and self.key[0] == _CHECK and len(self.firsts) > 1 else []

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Windows to remove; segments of different content under one hash, to sort."""
        gone, clash = [], []
        rows = zip(*(pylist(batch, c) for c in [*_NAMES, "bytes"]))
        for key, s, doc, pos, size, piece in rows:
            if (size >> 48, key) != self.key:
                clash += self._clash()
                self.key, self.firsts = (size >> 48, key), {}
            if piece in self.firsts:
                gone.append((doc, pos, (size >> 16) & 0xFFFFFFFF))
            else:
                self.firsts[piece] = s, doc, pos, size
        if gone:
            yield _gone(*(np.array(c, np.int64) for c in zip(*gone)))
        yield from self._sorted(clash)

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from self._sorted(self._clash())

    @staticmethod
    def _sorted(clash) -> Iterator[pa.RecordBatch]:
        if clash:
            s, doc, pos, size = (np.array(c, np.int64) for c in zip(*clash))
            yield _batch(_spread(doc, pos), s, doc, pos, (size & ((1 << 48) - 1)) | (_SORT << 48))


def merge_order(hashes: PrefixHash, data: np.ndarray, place: np.ndarray, limit: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge sort, group by group, of the suffixes that start at ``place`` and
    have ``limit`` bytes; rows of a group stand together. Also each suffix's
    common extension with the one before it in its group, else -1. All groups'
    runs of one width merge at once: a suffix finds its place in the other
    run by binary search, and compares by the common extension."""
    m = len(place)
    begin = np.flatnonzero(_runs(group))
    count = np.diff(begin, append=m)
    first, size = np.repeat(begin, count), np.repeat(count, count)
    local = np.arange(m) - first
    order, width = np.arange(m), 1

    def before(a, b, ties):
        ext = hashes.extension(place[a], place[b], np.minimum(limit[a], limit[b]))
        end_a, end_b = ext == limit[a], ext == limit[b]
        x = data[np.minimum(place[a] + ext, len(data) - 1)]
        y = data[np.minimum(place[b] + ext, len(data) - 1)]
        return np.where(end_a & end_b, ties, np.where(end_a, True, np.where(end_b, False, x < y)))

    while m and width < count.max():
        i = np.flatnonzero(size > width)
        run = local[i] // width
        other = run ^ 1
        stop = first[i] + size[i]
        lo = np.minimum(first[i] + other * width, stop)
        hi = np.minimum(lo + width, stop)
        base = lo.copy()
        mine, ties = order[i], (run & 1) == 1
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = before(order[mid], mine[open_], ties[open_])
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        target = first[i] + (run & ~1) * width + (local[i] - run * width) + (lo - base)
        merged = order.copy()
        merged[target] = mine
        order, width = merged, width * 2
    common = np.full(m, -1, np.int64)
    pair = np.flatnonzero(local > 0)
    a, b = order[pair - 1], order[pair]
    common[pair] = hashes.extension(place[a], place[b], np.minimum(limit[a], limit[b]))
    # collision verification: the bytes of all neighbours, and their order
    n = common[pair]
    spot = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    wrong = data[np.repeat(place[a], n) + spot] != data[np.repeat(place[b], n) + spot]
    bad = np.unique(group[pair][np.repeat(np.arange(len(pair)), n)[wrong]])
    ordered = before(a, b, np.ones(len(a), bool))
    bad = np.union1d(bad, group[pair][~ordered])
    for g in bad.tolist():
        at = np.flatnonzero(group == g)
        text = {int(j): data[place[j]:place[j] + limit[j]].tobytes() for j in at}
        own = sorted(text, key=text.get)
        order[at] = own
        for slot, x, y in zip(at[1:].tolist(), own, own[1:]):
            p, q = text[x], text[y]
            common[slot] = next((t for t, (u, v) in enumerate(zip(p, q)) if u != v), min(len(p), len(q)))
    return order, common


def repeats(group: np.ndarray, doc: np.ndarray, pos: np.ndarray, n: np.ndarray, off: np.ndarray, texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of each window that equals an earlier one of its group.
    Rows of a group stand together."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    anchor = np.cumsum(sizes) - sizes + off
    right, right_common = merge_order(PrefixHash(data), data, anchor, sizes - off, group)
    back = data[::-1]
    left, left_common = merge_order(PrefixHash(back), back, len(data) - anchor, off, group)
    by_place = np.lexsort((pos + off, doc))
    m = len(texts)
    out_doc, out_pos = [], []
    run_right, run_left = np.empty(m, np.int64), np.empty(m, np.int64)
    for r in range(int((off - n + 1).min()), int(off.max()) + 1):
        mine = by_place[((off - n + 1 <= r) & (r <= off))[by_place]]
        if len(mine) < 2:
            continue
        # windows r bytes before the anchor are equal when the r bytes on the left and the others on the right are
        run_right[right] = np.cumsum(right_common < length - r)
        run_left[left] = np.cumsum(left_common < r)
        key = run_right[mine] * np.int64(m + 1) + run_left[mine]
        _, earliest = np.unique(key, return_index=True)
        later = np.ones(len(mine), bool)
        later[earliest] = False
        if later.any():
            j = mine[later]
            out_doc.append(doc[j])
            out_pos.append(pos[j] + off[j] - r)
    if not out_doc:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_doc), np.concatenate(out_pos)


def compared(rows: DataFrame, left: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """Steps 3 and 4: windows to remove among the segments left to compare and
    to sort; segments whose hashes collide are returned as ones to sort."""
    kind = F.shiftright("size", 48)
    some = left.select("key", F.col("s").alias("h"), "doc", "pos", "size")
    to_sort = some.filter(kind == _SORT)
    many = staged(to_sort.groupBy("h").count().filter(F.col("count") > hot).select("h", F.lit(True).alias("hot")), "hot")
    flagged = salted_left_join(to_sort, many, ["h"], F.col("pos")).select("key", "h", "doc", "pos", "size", F.coalesce("hot", F.lit(False)).alias("hot"))
    flagged = flagged.unionAll(some.filter(kind == _CHECK).select("*", F.lit(False).alias("hot")))
    per_doc = flagged.groupBy("doc", F.shiftright("pos", _PART).alias("part")).agg(F.collect_list(F.struct("key", "h", "pos", "size", "hot")).alias("segs"))
    texts = rows.join(per_doc, ["doc", "part"]).select("doc", "text", "segs")
    fields, names = _FIELDS + ", bytes binary", [*_NAMES, "bytes"]

    def cut(batches):
        for batch in batches:
            for some in slices(batch, "text", 4 * PIECE):
                out: list[tuple] = []
                single: dict[bytes, tuple] = {}
                gone: list[tuple] = []
                for doc, text, segs in zip(pylist(some, "doc"), utf8(some, "text"), pylist(some, "segs")):
                    for seg in segs:
                        start, n = seg["pos"] & ((1 << _PART) - 1), (seg["size"] >> 16) & 0xFFFFFFFF
                        if not seg["hot"]:
                            key = seg["key"] if seg["size"] >> 48 == _CHECK else seg["h"]
                            out.append((key, seg["h"], doc, seg["pos"], seg["size"], text[start:start + n + length - 1]))
                            continue
                        for i in range(n):
                            piece, own = text[start + i:start + i + length], (doc, seg["pos"] + i)
                            old = single.get(piece)
                            if old is None:
                                single[piece] = own
                            else:
                                single[piece] = min(old, own)
                                gone.append(max(old, own))
                for piece, (doc, pos) in single.items():
                    key = int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "little", signed=True)
                    out.append((key, 0, doc, pos, (_WINDOW << 48) | (1 << 16), piece))
                if gone:
                    g = _gone(*(np.array(c, np.int64) for c in zip(*((d, p, 1) for d, p in gone))))
                    yield pa.RecordBatch.from_arrays([*g.columns, pa.nulls(g.num_rows, pa.binary())], names=names)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 5 else pa.int64()) for i, c in enumerate(zip(*out))], names=names)

    dealt = on_workers(texts, cut, fields).repartition("key").sortWithinPartitions(kind, "key", "doc", "pos")

    def compare(batches):
        equal, found = Equal(), []

        def sorts():
            for whole in batches:
                at = whole.column("size").to_numpy() >> 48
                if (at == _GONE).any():
                    found.append(whole.select(_NAMES).filter(pa.array(at == _GONE)))
                if (at >= _CHECK).any():
                    found.extend(equal.add(whole.filter(pa.array(at >= _CHECK))))
                yield whole.filter(pa.array(at == _SORT))

        for some in _whole_runs(sorts()):
            yield from found
            found.clear()
            if some is None:
                continue
            whole = some.to_batches()[0]
            key, _, doc, pos, _, n, off = _unpacked(whole)
            new = np.flatnonzero(_runs(key))
            a = 0
            for b in [*new[1:].tolist(), len(key)]:  # whole groups, some thousand segments at a time
                if b - a < 4096 and b < len(key) or a == b:
                    continue
                found_doc, found_pos = repeats(key[a:b], doc[a:b], pos[a:b], n[a:b], off[a:b], pylist(whole.slice(a, b - a), "bytes"), length)
                if len(found_doc):
                    yield _gone(found_doc, found_pos, np.ones(len(found_doc), np.int64))
                a = b
        yield from found
        yield from equal.end()

    return on_workers(dealt, compare, _FIELDS)


def parted(docs: DataFrame) -> DataFrame:
    """(doc, part, text): part counts the rows that repeat an identifier."""
    rows = docs.select(long_id().alias("doc"), whole_text().alias("text"))
    if rows.groupBy("doc").count().filter("count > 1").isEmpty():
        return rows.select("doc", F.lit(0).cast("long").alias("part"), "text")
    order = Window.partitionBy("doc").orderBy("text")
    return staged(rows.withColumn("part", F.row_number().over(order).cast("long") - 1).select("doc", "part", "text"), "parts")


def removed_runs(windows: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs [a, b) of bytes that (start, number of windows) cover."""
    out: list[list[int]] = []
    for start, n in sorted(windows):
        end = start + n + length - 1
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def deduplicated(docs: DataFrame, length: int = LENGTH, k: int = K, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256,
    spans (start and end of the removed runs) and, with ``with_text``, the
    bytes that stay as ``kept``."""
    rows = parted(docs)
    marks = staged(told(anchored(rows, length, k)), "marks")
    kind = F.shiftright("size", 48)
    more = staged(compared(rows, marks.filter(kind != _GONE), length), "compared")
    gone = marks.filter(kind == _GONE).unionAll(more.filter(kind == _GONE))
    clash = more.filter(kind == _SORT)
    if not clash.isEmpty():  # with all that they share an anchor hash with
        under = marks.filter(kind == _SORT).join(clash.select("s").distinct(), "s", "left_semi").select(*_NAMES)
        again = under.unionAll(clash).dropDuplicates(["s", "doc", "pos", "size"])
        gone = gone.unionAll(staged(compared(rows, again, length), "clashes"))
    start = F.col("pos").bitwiseAND(F.lit((1 << _PART) - 1))
    per_doc = gone.groupBy("doc", F.shiftright("pos", _PART).alias("part")).agg(
        F.collect_list(F.struct(start.alias("a"), F.shiftright("size", 16).bitwiseAND(F.lit(0xFFFFFFFF)).alias("n"))).alias("gone"))
    joined = rows.join(per_doc, ["doc", "part"], "left").select("doc", "text", "gone")
    fields = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>" + ", kept binary" * with_text
    kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.list_(pa.int64()))] + [pa.binary()] * with_text
    names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"] + ["kept"] * with_text

    def run(batches):
        for batch in batches:
            for some in slices(batch, "text", 4 * PIECE):
                out = []
                for doc, text, windows in zip(pylist(some, "doc"), utf8(some, "text"), pylist(some, "gone")):
                    spans = removed_runs([(w["a"], w["n"]) for w in windows or ()], length)
                    at, kept = 0, []
                    for a, b in spans:
                        kept.append(text[at:a])
                        at = b
                    kept = b"".join([*kept, text[at:]])
                    out.append((doc, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [list(x) for x in spans]) + (kept,) * with_text)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    out = on_workers(joined, run, fields)
    return out.select(id_or_null("doc").alias("doc_id"), *names[1:])
