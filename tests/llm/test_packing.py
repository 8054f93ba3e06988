import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from covenant.llm import packing as P


@pytest.fixture(scope="module")
def encode():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def check(df, encode):
    rows = df.collect()
    out = P.packed(df).collect()
    ids = defaultdict(list)
    for r in rows:
        ids[r["doc_id"]].append(np.array(encode(r["text"]), "<u4"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        assert any(r["doc_tokens"] == len(x) and zlib.crc32(x[r["start"]:r["start"] + r["length"]]) == r["ids_crc32"] for x in ids[r["doc_id"]])
    assert set(pieces) == set(ids)
    for doc, own in pieces.items():
        assert sum(r["length"] for r in own) == sum(map(len, ids[doc]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= 1024
    return out, sequences


def test_documents(documents, encode):
    out, sequences = check(documents, encode)
    total = sum(r["length"] for r in out)
    assert len(sequences) * 1024 - total <= 1024 * 8  # at most one short sequence a partition


def test_odd_rows(odd, encode):
    check(odd, encode)


def test_empty(empty):
    assert P.packed(empty).count() == 0


def test_the_two_readers_of_the_vocabulary_agree(corpus, encode):
    enc = P._encoder(None)
    for text in [t for _, t in corpus] + ["<|endoftext|> a", "  \n\n x", "a" * 3000, "漢字 😀 ß", "\x00\x01", "don't  we'll"]:
        assert P.encode(enc, text) + [0] == encode(text)


def test_hilbert_neighbours_touch():
    """Every step along the curve moves to an adjacent cell, once each."""
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = P.hilbert_key(grid, bits)
        assert sorted(key.tolist()) == list(range(len(grid)))
        steps = np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1)
        assert (steps == 1).all()


def test_neighbours_on_the_curve_are_alike(documents):
    """Documents of one language stand together more than by chance."""
    lang = {r["doc_id"]: r["lang"] for r in documents.collect()}
    rows = sorted(P.tokenized(documents).select("curve", "doc_id").distinct().collect())
    same = np.mean([lang[a[1]] == lang[b[1]] for a, b in zip(rows, rows[1:])])
    share = np.mean([[x == y for x in lang.values()] for y in lang.values()])
    assert same > share + 0.1


def test_long_runs_of_blanks(spark, encode):
    """Runs that the regex engine of tiktoken fails on."""
    rows = [(1, " " * 2_000_000, "x"), (2, "a b" + "\n" * 2_000_000 + "c", "x"), (3, " \u3000\t\n" * 300_000 + " \x1c d", "x")]
    check(spark.createDataFrame(rows, "doc_id long, text string, lang string"), encode)


def test_runs_of_blanks_are_cut_as_the_pattern_does(encode):
    enc = P._encoder(None)
    runs = [" " * 9, "\n" * 9, " \n" * 5, "\u3000" * 9, "\x1c" * 9, " " * 8 + "\x1c" + " " * 9, "\t" * 4]
    for run in runs:
        for text in (run, f"a{run}", f"{run}b", f"a {run}b", f"a{run}. {run}'s{run}漢{run}1", f"{run}<|endoftext|>{run} x"):
            assert P.encode(enc, text, 5) + [0] == P.encode(enc, text, 1 << 30) + [0] == encode(text)


def test_repeated_rows_fill_several_ranges(spark, encode):
    """Rows equal in all columns are no single range."""
    rows = [(None, "the same words again and again " * 20)] * 3000
    setting = "spark.sql.adaptive.coalescePartitions.enabled"  # so small ranges stay apart
    old = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        out, _ = check(spark.createDataFrame(rows, "doc_id long, text string"), encode)
    finally:
        spark.conf.set(setting, old)
    assert len({r["sequence_id"] >> 36 for r in out}) > 2
