"""Sequence packing along a space-filling curve.

A document's token ids are hashed to signed vectors of few dimensions and
averaged; the cell of that point has a Hilbert key. Documents are
range-partitioned and sorted by the key, and each partition packs its
documents one after the other along the curve into full sequences, cutting a
document where a sequence ends. Only the last sequence of a partition has
padding.

The tokens are written to the shared folder once (the range sampling then
does not tokenize again) as 16-bit integers where the vocabulary allows.

Nulls and ties: a null text counts as empty and yields the end id alone; equal
keys are ordered by identifier, start, a hash of the tokens and the place in the
written table, so rows that repeat identifier and text may lie in several ranges;
rows that repeat an identifier are packed one by one. Other columns are ignored. An empty table
gives an empty result.
"""
from __future__ import annotations

import base64
import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import on_workers, pylist, slices, staged, whole_text

SEQUENCE, END_ID = 1024, 0
#: tokens in a row between the steps: a long document is several rows, so that ranges of rows are ranges of tokens
BLOCK = 8192
DIMS, BITS = 4, 6


@functools.lru_cache(maxsize=2)
def _encoder(path: str | None):
    """The byte-level BPE of ``byte_bpe_50k.json``, and the same merges on a text
    as one piece. Its ranks file holds the same vocabulary; that reader is
    several times as fast (a test compares the two)."""
    import public_tokenizers as tokenizers
    import tiktoken

    with open(path or tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return [tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            for name, pattern in (("own", tokenizers.PATTERN), ("whole", "(?s:.+)"))]


#: the regex engine of tiktoken gives up in a run of some 1,000,000 blanks
LONG_BLANKS = 100_000
_BLANKS = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"  # its \s; that of re has \x1c-\x1f too


@functools.lru_cache(maxsize=2)
def _long_run(blanks: int) -> re.Pattern:
    return re.compile(f"(?<!{_BLANKS}){_BLANKS}{{{blanks}}}{_BLANKS}*")


def encode(encoders, text: str, blanks: int = LONG_BLANKS) -> list[int]:
    """The ids of ``text``. A run of ``blanks`` or more is one piece of the
    pattern, but for its last character where other text follows."""
    (enc, whole), ids, at = encoders, [], 0
    if len(text) >= blanks:
        for run in _long_run(blanks).finditer(text):
            end = run.end() - (run.end() < len(text))
            ids += enc.encode_ordinary(text[at:run.start()])
            ids += whole.encode_ordinary(text[run.start():end])
            at = end
    return ids + enc.encode_ordinary(text[at:])


@functools.lru_cache(maxsize=2)
def _directions(n_vocab: int, dims: int) -> np.ndarray:
    """For each token id a vector of signs, from a hash of the id."""
    x = np.arange(n_vocab, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return np.stack([((x >> np.uint64(7 * d + 3)) & np.uint64(1)).astype(np.float32) * 2 - 1 for d in range(dims)], 1)


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer cells (rows, dimensions), by
    undoing the curve's rotations from the top bit down and reading the
    transposed coordinates as one Gray-coded number."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            up = (x[i] & q) != 0
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[dims - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def tokenized(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, dims: int = DIMS, bits: int = BITS) -> DataFrame:
    """Blocks of documents: doc_id, start, the document's tokens n (the end id
    included), ids (little-endian, of ``width`` bytes), curve key."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))

    def run(batches):
        encoders = _encoder(tokenizer)
        n_vocab = encoders[0].n_vocab
        signs = _directions(n_vocab + 1, dims)
        width = 2 if max(n_vocab, end_id) < 1 << 16 else 4
        end = np.array([end_id], f"<u{width}")
        names = ["doc_id", "start", "n", "ids", "width", "curve"]
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                points, blocks = [], []
                for k, (doc, text) in enumerate(zip(pylist(part, "doc_id"), pylist(part, "text"))):
                    own = np.array(encode(encoders, text), end.dtype)
                    points.append(signs[own].mean(0) if len(own) else np.zeros(dims, np.float32))
                    own = np.concatenate([own, end])
                    blocks += [(doc, a, len(own), own[a:a + BLOCK].tobytes(), k) for a in range(0, len(own), BLOCK)]
                # short texts lie far out: tanh keeps them on the grid
                cells = np.clip((np.tanh(np.array(points) * 4) + 1) / 2 * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
                curve = hilbert_key(cells, bits)
                doc, start, n, ids, k = zip(*blocks)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(np.full(len(ids), width, np.int32)), pa.array(curve[list(k)])], names=names)

    return on_workers(rows, run, "doc_id long, start long, n long, ids binary, width int, curve long")


def packed(docs: DataFrame, sequence: int = SEQUENCE, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. ``sequence_id`` is unique, not gapless."""
    tokens = staged(tokenized(docs, tokenizer, end_id).withColumn("place", F.monotonically_increasing_id()), "tokens")
    order = ["curve", "doc_id", "start", F.xxhash64("ids"), "place"]
    dealt = tokens.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        number, fill = TaskContext.get().partitionId() << 36, 0
        for batch in batches:
            out: list[tuple] = []
            for doc, start, n, raw, width in zip(*(pylist(batch, c) for c in ("doc_id", "start", "n", "ids", "width"))):
                ids, at = np.frombuffer(raw, f"<u{width}").astype("<u4"), 0
                while at < len(ids):
                    length = min(sequence - fill, len(ids) - at)
                    out.append((doc, start + at, length, zlib.crc32(ids[at:at + length]), n, number, fill))
                    at, fill = at + length, fill + length
                    if fill == sequence:
                        number, fill = number + 1, 0
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 7, names=names)

    return on_workers(dealt, run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
