import hashlib
import random
import re

import numpy as np
import pytest

from covenant.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and P.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]


@pytest.fixture(scope="module")
def model(spark):
    return P.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def check(df, model):
    out = P.scan(df, model).collect()
    exp = []
    for r in df.collect():
        base = brute(r["text"] or "")
        exp.append((r["doc_id"], *[sum(s[0] == k for s in base) for k in P.KINDS], hashlib.sha256(P.joined(base).encode()).hexdigest()))
        mine = [x for x in out if x["doc_id"] == r["doc_id"]]
        assert any(set(map(tuple, base)) <= {(k, int(a), int(b)) for k, a, b in (s.split(":") for s in x["spans"].split(",") if s)} for x in mine)
    assert sorted(((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in out), key=str) == sorted(exp, key=str)
    return out


def test_documents(documents, model):
    check(documents, model)


def test_odd_rows(odd, model):
    check(odd, model)


def test_empty(empty, model):
    assert P.scan(empty, model).count() == 0
    assert P.fit(empty) is None
    assert P.spans("a@b.c", None) == ([("email", 0, 5)],) * 2


@pytest.mark.parametrize("letters", ["a1@.-+ ()9_%25\n", "0123456789 -.+()"])
def test_base_patterns(letters):
    random.seed(9)
    for _ in range(20_000):
        text = "".join(random.choice(letters) for _ in range(random.randint(0, 50)))
        assert P.base_spans(text) == brute(text), text


def test_the_field_finds_held_out_entities(spark, model):
    """Base spans of documents outside the sample, by the field alone, and
    keys, which no base pattern knows; numbers that fail their check stay out."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id >= 5000 and text rlike '[0-9@]'").select("text").collect()
    found = missed = wrong = keys = 0
    for r in docs:
        text = r["text"]
        silver = P._silver(text)
        field = set(model.found(text))
        found += sum(s in field for s in silver)
        missed += sum(s not in field for s in silver)
        wrong += sum(not any(a < s[2] and s[1] < b for _, a, b in silver) for s in field)
        keys += sum(s[0] == "secret" for s in field)
    assert found / (found + missed) > 0.95 and keys > 10
    assert wrong <= 0.03 * found


def test_clean_text_is_left_alone(model):
    for text in ("Chapter 12 has 3 parts and 1999 pages.", "Version 1.2.3 of 2024-01-02", "In 1984, 5 of 10 people", "a " * 1000):
        assert P.spans(text, model) == ([], [])


def test_windows_reach_every_candidate(model):
    random.seed(2)
    for _ in range(200):
        text = " ".join(random.choice(["word", "a@b.example.com", "12", "+1 (234) 555-6789", "x1", "."]) for _ in range(random.randint(1, 400)))
        tokens = [m.span() for m in P._TOKEN.finditer(text)]
        whole = {(tokens[i][0], tokens[j - 1][1]) for i, j in P.candidates(text, tokens)}
        parts = {(w[i][0], w[j - 1][1]) for w in P.windows(text) for i, j in P.candidates(text, w)}
        assert whole <= parts


def test_long_texts_take_time_in_proportion(model):
    for text in ("a" * 500_000, "1" * 300_000, "1." * 50_000, "a@" * 50_000, "+1 ((" * 5_000, "a." * 200_000):
        P.spans(text, model)


def whole_window(model, text, tokens):
    """The dynamic program with all values and links of a window at hand."""
    segs = P.candidates(text, tokens)
    if not segs:
        return []
    scores = model.scores(text, tokens, segs) - P.CAUTION
    n, kinds = len(tokens), len(P.TYPES) + 1
    value, back = np.full((n + 1, kinds), -np.inf), {}
    value[0, 0] = 0
    for end in range(1, n + 1):
        step = value[end - 1] + model.pairs[:, 0]
        value[end, 0], back[end, 0] = step.max(), (end - 1, int(step.argmax()), None)
        for s, (i, j) in enumerate(segs):
            if j == end and scores[s].max() > -20:
                for t in range(kinds - 1):
                    step = value[i] + model.pairs[:, t + 1] + scores[s, t]
                    if step.max() > value[end, t + 1]:
                        value[end, t + 1], back[end, t + 1] = step.max(), (i, int(step.argmax()), (P.TYPES[t], tokens[i][0], tokens[j - 1][1]))
    out, at = [], (n, int(value[n].argmax()))
    while at[0]:
        link = back[at]
        out += [link[2]] if link[2] else []
        at = link[:2]
    return out[::-1]


WORDS = ["word", "a@b.example.com", "12", "+1 (234) 555-6789", "x1", ".", "10.0.0.1", "4111 1111 1111 1111", "token=", "9f86d081884c7d659a2feaa0c55ad015", "12,34,56", "2024-01-02", "1;2;3", "=", "\n"]


def test_the_stream_gives_what_the_whole_window_gives(model, monkeypatch):
    random.seed(5)
    for part in (8, 40, 4096):
        monkeypatch.setattr(P, "PART", part)
        for _ in range(120):
            text = random.choice([" ", ",", ""]).join(random.choice(WORDS) for _ in range(random.randint(1, 160)))
            want = [s for w in P.windows(text) for s in whole_window(model, text, w)]
            assert list(model.found(text)) == want, text


def test_the_best_labelling_of_all(model):
    """Against an enumeration of all segmentations of short windows."""
    random.seed(6)
    some = 0
    for _ in range(300):
        text = " ".join(random.choice(WORDS) for _ in range(random.randint(1, 3)))
        for tokens in P.windows(text):
            segs = P.candidates(text, tokens)
            scores = model.scores(text, tokens, segs) - P.CAUTION if segs else []
            arcs = [(i, j, t + 1, scores[s][t]) for s, (i, j) in enumerate(segs) for t in range(len(P.TYPES)) if scores[s][t] > -20]
            if len(arcs) > 14:
                continue

            def every(at, prior):
                if at == len(tokens):
                    yield 0.0, ()
                    return
                for total, rest in every(at + 1, 0):
                    yield total + model.pairs[prior, 0], rest
                for i, j, t, score in arcs:
                    if i == at:
                        for total, rest in every(j, t):
                            yield total + model.pairs[prior, t] + score, ((P.TYPES[t - 1], tokens[i][0], tokens[j - 1][1]), *rest)

            totals = {}
            for total, spans in every(0, 0):
                totals[spans] = max(total, totals.get(spans, total))
            best = tuple(model.best(text, tokens))
            some += bool(best)
            assert totals[best] > max(totals.values()) - 1e-9, text
    assert some > 50


def test_a_text_of_figures_is_held_in_part(model):
    """One window of any length: what is held of it does not grow."""
    random.seed(7)
    text = "\n".join(",".join(str(random.randint(0, 99_999)) for _ in range(12)) for _ in range(3000))
    most, pieces, stream = 0, 0, P.Decoder(model, text)
    for tokens, ends in P.parts(text):
        stream.feed(tokens)
        most, pieces = max(most, len(stream.tokens) + len(stream.back) + len(stream.value) + len(stream.ending)), pieces + 1
        assert not ends or pieces > 10
    assert pieces > 10 and most < 200


def test_a_sample_is_taken_from_anywhere_in_a_text(spark):
    head = "plain words " * 3000
    rows = [(i, head + f"mail someone{i}@mail.example.com or call now " * 400) for i in range(80)]
    assert P.fit(spark.createDataFrame(rows, "doc_id long, text string"), sample_chars=4000) is not None
