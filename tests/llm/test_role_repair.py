import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from covenant.llm import role_repair as R

SCHEMA = "conv_id long, turn long, role string, text string"
VIABLE, WHOLE = re.compile(r"s?(ua)*u?"), re.compile(r"(s?(ua)+)?")
BLANKS = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, repaired) of rows (role, text, fault): a search by cost and
    audit over (row, roles so far), straight from the rules."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, kept = heapq.heappop(heap)
        if i == len(rows) and WHOLE.fullmatch(roles):
            return cost, audit, kept
        if (i, roles) in seen:
            continue
        seen.add((i, roles))

        def go(more, letter, i, role, item):
            if VIABLE.fullmatch(roles + role):
                # after an even number of turns what went before no longer matters
                heapq.heappush(heap, (cost + more, audit + letter, i, re.sub(r"^(s?ua)(ua)+", r"\1", roles + role), kept + item))

        for r in ("user", "assistant"):
            go(5, "I", i, r[0], ((r, ""),))
        if i < len(rows):
            role, text, fault = rows[i]
            go(2, "D", i + 1, "", ())
            if fault not in ("blank", "duplicate"):
                stays = 5 if fault == "truncated" else 0
                if role[:1] and role[:1] in "sua":
                    go(stays, "K", i + 1, role[:1], ((role, text),))
                for r in ("user", "assistant"):
                    go(stays + 1, "R", i + 1, r[0], ((r, text),))


def brute(table):
    convs = {}
    for c, t, r, x in table:
        r, x = " " if r is None else r, " " if x is None else x
        rows = convs.setdefault(c, [])
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 0:
            continue
        x = "" if kind == 1 else x.translate({ord(m): None for m in ".!?"}) if kind == 2 else x
        rows += [(t is not None, t or 0, "user" if kind == 4 else r, x, t)] * (2 if kind == 3 else 1)
    out = []
    for c, rows in convs.items():
        rows.sort(key=lambda r: r[:4])
        turns = [r[4] for r in rows if r[4] is not None]
        faulty, seen = [], set()
        for _, _, r, x, _ in rows:
            bare = x.rstrip(BLANKS)
            fault = "blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((r, x))
            faulty.append((r, x, fault))
        count = [sum(f[2] == k for f in faulty) for k in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:]))
        cost, audit, kept = cheapest(faulty)
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *count, illegal, cost, audit,
                    hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return sorted((tuple(r) for r in R.repaired(df).select(*names).collect()), key=repr)


TEXTS = ["Fine.", "Cut off", "", "  \t", "Yes!", "Why? \n", "Fine.", None, "\x1f."]


def table(seed, convs, most):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant"] * 3 + ["system", "tool", "User", "", None]) if rng.random() < 0.4 else ("user", "assistant")[t % 2]
            rows.append((c, t + (t > 3) * 2, role, rng.choice(TEXTS) if rng.random() < 0.4 else f"Text {c} {t}."))
    return rows


ODD = [(None, 0, "user", "Who?"), (None, None, "assistant", "Me."), (-7, None, None, None), (-7, 2, "user", "a."), (-7, 2, "user", "a."), (-7, 2, "assistant", "b."),
       (9_000_000_000, 5, "system", "Long." + " " * 3000), (9_000_000_001, 1, "x" * 90, "z" * 90), (500, 12, "assistant", "é𝒳.")]


@pytest.mark.parametrize("chunk", [4096, 3])
def test_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(R, "CHUNK", chunk)
    rows = table(1, 120, 9) + ODD
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", conv string, n int").repartition(5)
    assert got(df) == brute(rows)


def test_long_conversation_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(R, "CHUNK", 50)
    monkeypatch.setattr(R, "PIECE_BYTES", 200)
    rows = [(1, t, r, x) for _, t, r, x in itertools.islice(((0, i, random.Random(i).choice(["user", "assistant", "system"]), f"T {i % 90}" + "." * (i % 3)) for i in range(1200)), 1200)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert got(df) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_empty(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_every_conversation_is_returned(spark):
    gone = [(c, 0, "user", "x.") for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:5]
    assert [r[1:] for r in got(spark.createDataFrame(gone, SCHEMA))] == [(0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())] * 5


def test_tables_accept_the_grammar():
    for n in range(7):
        for word in map("".join, itertools.product("sua", repeat=n)):
            stack = R.BOTTOM
            for token in word:
                stack = stack and R.shifted(stack, token)
            assert bool(stack and R.shifted(stack, R.END)) == bool(WHOLE.fullmatch(word)), word


def test_steps_equal_the_search():
    """Codes of every kind, up to four rows, against the search."""
    kinds = [(r, f) for r in ("system", "user", "assistant", "tool") for f in ("", "blank", "truncated")]
    rng = random.Random(3)
    for n in range(5):
        words = list(itertools.product(kinds, repeat=n)) if n < 3 else [tuple(rng.choice(kinds) for _ in range(n)) for _ in range(1500)]
        for word in words:
            codes = bytes(("suat".index(r[0])) * 4 + ["", "blank", "duplicate", "truncated"].index(f) for r, f in word)
            found, _ = R.parsed(codes, 0)
            cost, ways, tail = R.routed([{0: found}])
            audit = "".join(R.edits(codes, 0, ways[0][1])) + tail
            assert (cost, audit) == cheapest([(r, "t.", f) for r, f in word])[:2], word
