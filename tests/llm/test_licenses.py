import math
import random
import re

import pytest

from covenant.llm import licenses as L


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found, labels = [], set()
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                found.append(i)
                labels.add(label)
    return len(words), len(found), min(found, default=None), max(found, default=None), ",".join(sorted(labels))


def check(df):
    out = L.scan(df).collect()
    base = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in out), key=str)
    assert base == sorted(((r["doc_id"], *brute(r["text"])) for r in df.collect()), key=str)
    for r in out:
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert r["labels"] == ",".join(sorted(set(filter(None, r["labels"].split(",")))))
    return {r["doc_id"]: r for r in out}


def test_documents(documents):
    out = check(documents)
    for r in documents.collect():
        if re.search(r"Licensed under the Apache License, Version 2\.0", r["text"] or ""):
            assert "apache-2.0" in out[r["doc_id"]]["labels"]
        if re.search(r"Released under the MIT License\.", r["text"] or ""):
            assert "mit" in out[r["doc_id"]]["labels"].split(",")


def test_odd_rows(odd):
    check(odd)


def test_phrases_at_borders(spark):
    texts = ["cc by", "CC-BY cc by", "cc\nby.cc", "all rights reserved all rights reserved", "General Public  License", "generál public license",
             "ccby cc by4", "Keep cc by", "cc İ by", "É cc by É", "cc" + " x" * 5000 + " cc by", "all all rights reserved", ""]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_templates_need_their_key_phrase_in_place(spark):
    texts = ["Licensed under the Apache License, Version 2.0", "licensed under the license apache version 2 0", "apache", "The MIT License", "mit of license",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "Mozilla Public License v 2 0 " * 3,
             "This work is licensed under the GNU General Public License, version 3."]
    out = check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    labels = [out[i]["labels"] for i in range(len(texts))]
    assert labels[0] == "apache-2.0" and labels[1] == labels[2] == labels[4] == ""
    assert labels[5] == "mit-text" and labels[7] == "gpl,gpl-3.0"


def plain_scan(rows, templates, shift=L.SHIFT):
    """(doc, label, start) by looking at every place of every text."""
    words = {i: re.findall(L._TEMPLATE_WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) for i, text in rows}
    vocabulary = {w for text, _ in templates.values() for w in L.template_words(text)}
    weight = {w: math.log((len(rows) + 1) / (sum(w in set(x) for x in words.values()) + 1)) + 1e-9 for w in vocabulary}
    out = set()
    for label, (text, key) in templates.items():
        t, k = L.template_words(text), L.template_words(key)
        at = next(i for i in range(len(t)) if t[i:i + len(k)] == k)
        rare = sorted(range(len(t)), key=lambda i: (-weight[t[i]], t[i], i))[:max(L.RARE, len(t) // L.WORDS_A_RARE)]
        drift = max(shift, len(t) // L.WORDS_A_SHIFT) if shift else 0
        for i, own in words.items():
            for p in range(len(own)):
                if own[p:p + len(k)] == k:
                    start = p - at
                    seen = [q for q in rare if any(0 <= start + q + d < len(own) and own[start + q + d] == t[q] for d in range(-drift, drift + 1))]
                    if sum(weight[t[q]] for q in seen) >= L.COVER * sum(weight[t[q]] for q in rare) - 1e-9:
                        out.add((i, label, start))
    return out


def found(df, *args):
    return {(r["doc_id"], m["label"], m["start"]) for r in L.scan(df, *args).collect() for m in r["matches"]}


def edited(text, rng, n):
    """A text with n words put in and n left out."""
    words = text.split()
    for _ in range(n):
        del words[rng.randrange(len(words))]
        words.insert(rng.randrange(len(words)), rng.choice(["really", "software", "x"]))
    return " ".join(words)


def test_whole_texts_with_words_put_in_and_left_out(spark):
    rng = random.Random(4)
    templates = {**L.TEMPLATES, **L.TEXTS}
    texts = [t for t, _ in templates.values()]
    rows = [edited(t, rng, n) for t in texts for n in (0, 1, 3)]
    rows += [" ".join(rng.choice(["license", "the", "software", "mit", "version", "2", "0", "public"]) for _ in range(200)) for _ in range(10)]
    rows += ["nothing " * 30 + t + " more " + t for t in texts] + ["words of no licence " * 20] * 20
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = found(df)
    assert out == plain_scan(rows, templates)
    for i, label in enumerate(templates):
        assert (3 * i, label, 0) in out, label
    labels = {r["doc_id"]: r["labels"].split(",") for r in L.scan(df).collect()}
    one_edit = [label in labels[3 * i + 1] for i, label in enumerate(templates) if label in L.TEXTS]
    assert sum(one_edit) >= len(one_edit) - 1
    some = {"mit": L.TEMPLATES["mit"], "isc-text": L.TEXTS["isc-text"]}
    assert found(df, some, L.RARE, L.COVER, 0) == plain_scan(rows, some, 0)


def test_templates_from_a_table(spark, monkeypatch):
    table = spark.createDataFrame([("own", "This file belongs to Nobody, take it away", "belongs to nobody"), ("own", "a belongs to nobody", "belongs to nobody")], "label string, text string, key string")
    templates = L.read_templates(table)
    assert list(templates) == ["own"]
    df = spark.createDataFrame([(1, "This file really belongs to nobody; take it away"), (2, "belongs to"), (3, None)], "doc_id long, text string")
    out = {r["doc_id"]: r["labels"] for r in L.scan(df, templates).collect()}
    assert out == {1: "own", 2: "", 3: ""}
    assert L.read_templates(table.limit(0)) == {} and [r["labels"] for r in L.scan(df, {}).collect()] == [""] * 3
    with pytest.raises(ValueError):
        L.read_templates(spark.createDataFrame([("x", "some text", "other")], "label string, text string, key string"))
    monkeypatch.setattr(L, "MAX_TEMPLATE_WORDS", 5)
    with pytest.raises(ValueError):
        L.read_templates(table)


def test_empty(empty):
    assert L.scan(empty).count() == 0


def test_no_python_on_the_executors(documents, capsys):
    L.scan(documents).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
