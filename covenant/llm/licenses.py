"""License scan over a positional rare-token index, in DataFrame functions.

A template is a licence text or notice with a label and a key phrase; a caller
may give a table of them (``read_templates``). Document frequencies of the
templates' words, counted over all documents, give their inverse document
frequency. Each template is indexed under its rarest words with their places.
A file's occurrences of indexed words meet the postings; a posting at place q
and an occurrence at place p vote for the start p - q. A start where all words
of the key phrase stand is a match when the votes for starts at most ``shift``
words away hold at least ``COVER`` of the rare words' weight, each place of the
template counted once. So words put in or left out move the rest by a few
places and do not break a match.

The base phrases are found in full, word by word, wherever they stand. The
words of a text are kept only where a template or phrase uses them, as
(place, word) in the row itself; only votes are shuffled, by row.

Nulls and ties: a null text counts as empty and has no words, labels '' and
score 0; rows that repeat an identifier are scanned one by one; of equally rare
words the first in the alphabet is taken. An empty table gives an empty
result; other columns are ignored.
"""
from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

from .common import staged
from .license_texts import TEXTS

#: fixed values: the base phrases and their labels
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: label -> (template, key phrase inside it)
TEMPLATES = {
    "apache-2.0": ("licensed under the apache license version 2 0", "apache license version 2 0"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", "cc by nc 4 0"),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", "cc by sa 4 0"),
    "cc0-1.0": ("dedicated to the public domain under cc0 1 0 universal", "cc0 1 0"),
    "gpl-2.0": ("licensed under the gnu general public license version 2", "general public license version 2"),
    "gpl-3.0": ("licensed under the gnu general public license version 3", "general public license version 3"),
    "mit": ("released under the mit license", "mit license"),
    "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    "mpl-2.0": ("subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
}
#: rare words of a template: at least RARE, one of so many words; the shift that
#: its words may have: at least SHIFT, one for so many words
RARE, WORDS_A_RARE, COVER, SHIFT, WORDS_A_SHIFT = 4, 10, 0.75, 2, 10
#: words of all templates together; a table of more is an error
MAX_TEMPLATE_WORDS = 50_000

_MATCHES = "array<struct<label:string,start:int,cover:double>>"
_DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TEMPLATE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def template_words(text: str) -> list[str]:
    return re.findall(_TEMPLATE_WORD, text.lower())


def read_templates(table: DataFrame) -> dict[str, tuple[str, str]]:
    """Templates from a table (label, text, key). The words of all together are
    counted before they are read. A null, or a key phrase that is not in its
    text, is an error; of rows that repeat a label, the least text counts."""
    words = table.agg(F.sum(F.size(F.split("text", _DELIMITERS)))).first()[0] or 0
    if words > MAX_TEMPLATE_WORDS:
        raise ValueError(f"{words} template words, at most {MAX_TEMPLATE_WORDS}")
    rows = table.groupBy("label").agg(F.min(F.struct("text", "key")).alias("t")).collect()
    out = {r["label"]: (r["t"]["text"], r["t"]["key"]) for r in rows}
    for label, (text, key) in out.items():
        if None in (label, text, key) or _at(template_words(text), template_words(key)) is None:
            raise ValueError(f"the key phrase of template {label!r} is not in its text")
    return out


def _at(words: list[str], key: list[str]) -> int | None:
    """Place of the key phrase; None if it is empty or not there."""
    return next((i for i in range(len(words)) if words[i:i + len(key)] == key), None) if key else None


def lowered(text: Column) -> Column:
    """A-Z lower-cased, for words that are looked up in ASCII. Unicode's
    lower-casing differs from that inside words beyond ASCII only, once the two
    letters that it would turn into ASCII are others."""
    return F.lower(F.replace(F.replace(text, F.lit("K"), F.lit("é")), F.lit("İ"), F.lit("é")))


def occurrences(docs: DataFrame, vocabulary: set[str], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """_row, the ``keep`` columns, n_words and hits: (p, w) of each word in the vocabulary."""
    words = F.filter(F.split(lowered(F.col("text")), _DELIMITERS), lambda w: w != "")
    hits = F.filter(F.transform(words, lambda w, i: F.when(w.isin(sorted(vocabulary)), F.struct(i.alias("p"), w.alias("w")))), lambda h: h.isNotNull())
    n = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")
    empty = F.array().cast("array<struct<p:int,w:string>>")
    return docs.select(F.monotonically_increasing_id().alias("_row"), *keep, n.alias("n_words"), F.coalesce(hits, empty).alias("hits"))


def places(phrase: str) -> Column:
    """Word places where the phrase's words stand one after the other."""
    words = phrase.split()

    def start(h: Column, i: Column) -> Column:
        found = h["w"] == words[0]
        for k, word in enumerate(words[1:], 1):
            other = F.get(F.col("hits"), i + k)
            found = found & F.coalesce((other["w"] == word) & (other["p"] == h["p"] + k), F.lit(False))
        return F.when(found, h["p"].cast("long"))

    return F.filter(F.transform("hits", start), lambda p: p.isNotNull())


def word_weights(hits: DataFrame, vocabulary: set[str]) -> dict[str, float]:
    """Inverse document frequency of each word of the vocabulary (which bounds what comes here)."""
    seen = hits.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["w"]))).alias("w")).groupBy("w").count().collect()
    total, counts = hits.count(), {r["w"]: r["count"] for r in seen}
    return {w: math.log((total + 1) / (counts.get(w, 0) + 1)) + 1e-9 for w in vocabulary}


def postings(weights: dict[str, float], templates: dict[str, tuple[str, str]], rare: int = RARE) -> list[tuple[str, str, int, float, bool]]:
    """(word, label, place, share of the rare words' weight, in the key phrase):
    a template's rarest words, and the words of its key phrase."""
    out = []
    for label, (text, key) in sorted(templates.items()):
        words, key_words = template_words(text), template_words(key)
        at = _at(words, key_words)
        first = sorted(range(len(words)), key=lambda i: (-weights[words[i]], words[i], i))[:max(rare, len(words) // WORDS_A_RARE)]
        total = sum(weights[words[i]] for i in first)
        for i, word in enumerate(words):
            mandatory = at <= i < at + len(key_words)
            if i in first or mandatory:
                out.append((word, label, i, weights[word] / total if i in first else 0.0, mandatory))
    return out


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[x for label, value in sorted(pairs.items()) for x in (F.lit(label), value)])


def matched(rows: DataFrame, templates: dict[str, tuple[str, str]], rare: int = RARE, cover: float = COVER, shift: int = SHIFT) -> DataFrame:
    """_row and matches (label, start of the template, cover) of ``occurrences``."""
    if not templates:
        return rows.select("_row", F.array().cast(_MATCHES).alias("matches")).limit(0)
    vocabulary = {w for text, _ in templates.values() for w in template_words(text)}
    index = postings(word_weights(rows, vocabulary), templates, rare)
    sizes = {label: len(template_words(text)) for label, (text, _) in templates.items()}
    shifts = _literal_map({label: F.lit(max(shift, n // WORDS_A_SHIFT) if shift else 0) for label, n in sizes.items()})
    needed = _literal_map({label: F.lit(len(template_words(key))) for label, (_, key) in templates.items()})

    # postings by word: literals, as many as the templates have rare and key words
    by_word: dict[str, list] = {}
    for word, label, at, share, mandatory in index:
        by_word.setdefault(word, []).append(F.struct(F.lit(label).alias("label"), F.lit(at).alias("q"), F.lit(share).alias("share"), F.lit(int(mandatory)).alias("key")))
    lookup = F.create_map(*[x for word, found in sorted(by_word.items()) for x in (F.lit(word), F.array(*found))])

    # templates whose key words all occur; the others cannot match
    present = F.array_distinct(F.transform("hits", lambda h: h["w"]))
    whole = [F.when(F.size(F.array_except(F.array(*[F.lit(w) for w in sorted(set(template_words(key)))]), "_present")) == 0, F.lit(label))
             for label, (_, key) in sorted(templates.items())]
    some = rows.withColumn("_present", present).withColumn("_open", F.array_compact(F.array(*whole))).filter(F.size("_open") > 0)
    hits = some.select("_row", "_open", F.explode(F.filter("hits", lambda h: h["w"].isin(sorted(by_word)))).alias("h"))
    votes = hits.select("_row", "_open", "h", F.explode(lookup[F.col("h")["w"]]).alias("v")).filter(F.array_contains("_open", F.col("v.label"))).select(
        "_row", F.col("v.label").alias("label"), (F.col("h.p") - F.col("v.q")).alias("start"), F.col("v.q").alias("q"), F.col("v.share").alias("share"), F.col("v.key").alias("key"))
    # a start has at most as many votes as its template has words
    starts = votes.groupBy("_row", "label", "start").agg(
        F.sum("key").alias("keys"), F.collect_list(F.when(F.col("share") > 0, F.struct("q", "share"))).alias("found"))
    # stretches as wide as the shift: what may count for a start is in its own or a neighbour
    width = shifts[F.col("label")] + 1
    near = starts.withColumn("_own", F.floor(F.col("start") / width)).select("*", F.explode(F.array(F.col("_own") - 1, F.col("_own"), F.col("_own") + 1)).alias("stretch"))
    around = near.groupBy("_row", "label", "stretch").agg(F.collect_list(F.struct("start", "_own", "keys", "found")).alias("near")).withColumn("_shift", shifts[F.col("label")])
    complete = F.filter("near", lambda x: (x["_own"] == F.col("stretch")) & (x["keys"] == needed[F.col("label")]))
    seen = around.withColumn("_start", F.explode(F.transform(complete, lambda x: x["start"]))).withColumn("_votes", F.array_distinct(F.flatten(F.transform(
        F.filter("near", lambda x: F.abs(x["start"] - F.col("_start")) <= F.col("_shift")), lambda x: x["found"]))))
    held = seen.withColumn("cover", F.aggregate("_votes", F.lit(0.0), lambda total, v: total + v["share"])).filter(F.col("cover") >= cover - 1e-9)
    return held.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("label", F.col("_start").alias("start"), F.least("cover", F.lit(1.0)).alias("cover")))).alias("matches"))


def scan(docs: DataFrame, templates: dict[str, tuple[str, str]] | None = None, rare: int = RARE, cover: float = COVER, shift: int = SHIFT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, and matches: (label, start, cover) of each template found."""
    templates = {**TEMPLATES, **TEXTS} if templates is None else templates
    vocabulary = {w for text, _ in templates.values() for w in template_words(text)} | {w for p in PHRASES for w in p.split()}
    rows = staged(occurrences(docs, vocabulary), "hits")
    matches = matched(rows, templates, rare, cover, shift)

    base = {label: places(phrase) for phrase, label in PHRASES.items()}
    out = rows.select("_row", "doc_id", "n_words", *[c.alias(f"_{label}") for label, c in base.items()])
    every = F.concat(*[F.col(f"_{label}") for label in base])
    base_labels = F.concat(*[F.when(F.size(f"_{label}") > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for label in base])
    out = out.join(matches, "_row", "left").withColumn("matches", F.coalesce("matches", F.array().cast(_MATCHES)))
    n_base = F.size(every)
    return out.select(
        "doc_id", "n_words", n_base.cast("long").alias("n_base"), F.array_min(every).alias("first_word"), F.array_max(every).alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, F.transform("matches", lambda m: m["label"])))), ",").alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("matches", lambda m: m["cover"])), F.lit(0.0))).alias("score"),
        "matches")
