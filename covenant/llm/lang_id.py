"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of training text.
The lower-cased words of a text are encoded with every dictionary, block by
block, and the text gets the language with the fewest bytes. The prediction is rejected when the second
best language is nearly as short.

Fitting reads a bounded sample: per language at most ``SAMPLE_DOCS`` labelled
documents in the order of a hash of the identifier; of a text with more than
``PIECES * PIECE`` letters, so many pieces from hashed places anywhere in it.
Texts of ``LONG`` characters come first and shorter ones fill up the sample, so
a language that has short texts only is learned too. More than
``MAX_LANGUAGES`` labels are an error: each text is encoded once per language, so
a column that holds anything else than languages would cost that many times.
Predicting reads every byte of every text, all at one level of compression.

Nulls and ties: a null text, and a text without a letter, is ``und`` with
score 0 and is rejected; rows without a label are not learned from; equal
sizes go to the language that sorts first. With no training rows, every text
is ``und``. Only doc_id, text and lang are read.
"""
from __future__ import annotations

import functools

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .common import hash_sample, on_workers, pylist, slices

SAMPLE_DOCS, PIECES, PIECE = 64, 4, 400
MAX_LANGUAGES = 256
#: characters of a text that is learned from first; shorter ones fill up a language's sample
LONG = 200
BLOCK, LEVEL, MARGIN = 8192, 12, 0.002

#: what is encoded: lower-case letters, with a blank for anything else in ASCII
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def letters(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split())



def held_out(doc_id: str = "doc_id") -> Column:
    """The documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def pieces(text: Column, seed: Column) -> Column:
    """What is learned of a text: its letters, or pieces of them from hashed places."""
    said = F.trim(F.regexp_replace(text, r"\P{L}+", " "))
    room = F.char_length(said) - PIECE + 1
    some = [F.substr(said, F.pmod(F.xxhash64(seed, F.lit(i)), room).cast("int") + 1, F.lit(PIECE)) for i in range(PIECES)]
    return F.when(F.char_length(said) <= PIECES * PIECE, said).otherwise(F.concat_ws("\n", *some))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """language -> dictionary content, learned from the rows that are not held out."""
    train = docs.select("doc_id", "text", "lang").filter(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    if train.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"the labels hold more than {MAX_LANGUAGES} languages")
    kind = F.concat(F.when(F.length("text") >= LONG, "+").otherwise("-"), F.col("lang"))
    chosen = hash_sample(train.withColumn("kind", kind), ["doc_id", "text"], sample_docs, "kind")
    some = chosen.select("lang", "kind", "_rank", pieces(F.col("text"), F.xxhash64("doc_id", "text")).alias("text"))
    # of each language the long texts come first
    rows = sorted(some.collect(), key=lambda r: (r["lang"], r["kind"], r["_rank"]))
    parts: dict[str, list[bytes]] = {}
    for r in rows:
        own = parts.setdefault(r["lang"], [])
        if len(own) < sample_docs:
            own.append(letters(r["text"]))
    return {k: b"\n".join(v) for k, v in sorted(parts.items())}


@functools.lru_cache(maxsize=4)
def _compressors(model: tuple[tuple[str, bytes], ...], level: int) -> list:
    """(language, compressor) for each language."""
    out = []
    for lang, content in model:
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(
            level, dict_size=len(content), source_size=BLOCK, write_content_size=False, write_checksum=False, write_dict_id=False)
        held.precompute_compress(compression_params=how)
        out.append((lang, zstandard.ZstdCompressor(dict_data=held, compression_params=how)))
    return out


def classify(text: str | None, compressors, block: int = BLOCK, margin: float = MARGIN) -> tuple[str, float, bool]:
    """(language, score, rejected). The score is the share of bytes saved
    against the second best language."""
    if not compressors or not text or not any(map(str.isalpha, text)):
        return "und", 0.0, True
    raw = letters(text)
    parts = [raw[i:i + block] for i in range(0, len(raw), block)]
    sizes = [(sum(len(c.compress(p)) for p in parts), lang) for lang, c in compressors]
    if len(sizes) == 1:
        return sizes[0][1], 1.0, False
    (best, lang), (second, _) = sorted(sizes)[:2]
    score = 1 - best / second
    return lang, score, score < margin


def predict(docs: DataFrame, model: dict[str, bytes], keep: tuple[str, ...] = (), text: str = "text",
            level: int = LEVEL, margin: float = MARGIN) -> DataFrame:
    """The ``keep`` columns with lang_pred, score and rejected for every row."""
    frozen = tuple(sorted(model.items()))
    rows = docs.select(*({text: 0} | dict.fromkeys(keep)))
    schema = rows.select(*keep).schema
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("rejected", "boolean")):
        schema = schema.add(name, kind)

    def run(batches):
        compressors = _compressors(frozen, level)
        for batch in batches:
            for part in slices(batch, text, 4 << 20):
                done = [classify(t, compressors, margin=margin) for t in pylist(part, text)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in keep] + [pa.array([d[i] for d in done], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))],
                    names=[*keep, "lang_pred", "score", "rejected"])

    return on_workers(rows, run, schema)


def identified(docs: DataFrame) -> DataFrame:
    """The rows whose language is found, with the columns of ``docs``."""
    cols = tuple(docs.columns)
    renamed = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(cols)])
    out = predict(renamed, fit(docs), tuple(renamed.columns), f"_c{cols.index('text')}")
    return out.filter(~F.col("rejected")).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(cols)])
