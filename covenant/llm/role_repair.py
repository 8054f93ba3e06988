"""Repair of conversations by generalised LR parsing with weighted edits.

The role grammar ``(s?(ua)+)?`` is written as productions, from which the LR
tables are built. A conversation's rows are read one by one; for every top of the
graph-structured stack the parser keeps the row (a shift of its role), reroles it
(a shift of another), deletes it (no shift), after any inserts (shifts that read
nothing). A stack is a chain of shared nodes. Tops in the same LR state have the
same continuations in this grammar, so equal tops are merged: the least (cost,
audit) stays, with its links.

Audits are compared without writing them out. Inserts belong to the row that they
stand before, so after a row no audit is the beginning of another, and the order
of two audits is decided by the order of the tops that they come from, else by
the letters since. A top therefore carries its cost and its rank only.

A conversation of any length is cut into chunks of ``CHUNK`` rows. A chunk is
parsed from each top that may enter it, which gives (cost, rank) for each top
that leaves it; these small tables are put together along the conversation, and
each chunk then knows its way in and out and writes its own part of the audit.
The repaired texts pass one digest a conversation, in order (a SHA-256 allows
nothing else), as a stream of rows or, for many chunks, of finished pieces.

A row's fault is the first of: blank (no character but ASCII white space),
duplicate (role and text stood before in the conversation; compared by SHA-256),
truncated (the last character that is no such white space is not ``. ! ?``).
Blank and duplicate rows have to be deleted; a truncated row that stays adds 5.

Nulls and ties: a null role or text is one space, as is a null identifier or turn
in the text that picks the damage; a null ``conv_id`` is a conversation. Rows are
ordered by turn, null first, then by the first 64 characters of role and text,
then by hash. A conversation without rows has zeros and the digest of nothing. An
empty table gives no rows. Roles other than those that begin with s, u or a have
to be reroled or deleted.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import on_workers, pylist, staged
from .scan import running

#: (left side, right side); the first symbol is the start
GRAMMAR = (("S", ("H", "B")), ("S", ()), ("H", ("s",)), ("H", ()), ("B", ("B", "P")), ("B", ("P",)), ("P", ("u", "a")))
TOKENS = "sua"
END = "$"
KEEP, REROLE, DELETE, INSERT, STAYS_TRUNCATED = 0, 1, 2, 5, 5
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
ROLES = {"u": "user", "a": "assistant"}
CHUNK = 4096
PIECE_BYTES = 1 << 20


class Tables:
    """SLR(1) tables of a grammar."""

    def __init__(self, grammar=GRAMMAR):
        self.rules = (("<", (grammar[0][0],)), *grammar)
        left = {a for a, _ in self.rules}
        empty, first, follow = set(), {a: set() for a in left}, {a: set() for a in left}
        follow["<"].add(END)

        def size():
            return len(empty) + sum(map(len, first.values())) + sum(map(len, follow.values()))

        before = -1
        while before != size():
            before = size()
            for a, right in self.rules:
                if all(x in empty for x in right):
                    empty.add(a)
                for x in right:
                    first[a] |= first.get(x, {x})
                    if x not in empty:
                        break
                after = set(follow[a])
                for x in reversed(right):
                    if x in left:
                        follow[x] |= after
                        after = (after | first[x]) if x in empty else set(first[x])
                    else:
                        after = {x}

        def closed(items):
            items = set(items)
            todo = list(items)
            while todo:
                rule, dot = todo.pop()
                right = self.rules[rule][1]
                if dot < len(right):
                    for i, (a, _) in enumerate(self.rules):
                        if a == right[dot] and (i, 0) not in items:
                            items.add((i, 0))
                            todo.append((i, 0))
            return frozenset(items)

        start = closed([(0, 0)])
        states, self.go, self.reduce = {start: 0}, {}, {}
        todo = [start]
        while todo:
            state = todo.pop()
            # in a fixed order: the numbers of the states have to be the same in every process
            for x in sorted({self.rules[r][1][d] for r, d in state if d < len(self.rules[r][1])}):
                to = closed((r, d + 1) for r, d in state if d < len(self.rules[r][1]) and self.rules[r][1][d] == x)
                if to not in states:
                    states[to] = len(states)
                    todo.append(to)
                self.go[states[state], x] = states[to]
            for r, d in state:
                if d == len(self.rules[r][1]):
                    for x in follow[self.rules[r][0]]:
                        self.reduce[states[state], x] = r


TABLES = Tables()
#: a stack: (LR state, stack below); nodes are shared between stacks
BOTTOM = (0, None)


def shifted(stack: tuple, token: str) -> tuple | None:
    """The stack after the reductions that ``token`` calls for and its shift;
    None where it cannot follow. At the end: the stack, where it accepts."""
    while True:
        state = stack[0]
        if token != END and (state, token) in TABLES.go:
            return (TABLES.go[state, token], stack)
        rule = TABLES.reduce.get((state, token))
        if rule is None:
            return None
        if rule == 0:
            return stack
        left, right = TABLES.rules[rule]
        for _ in right:
            stack = stack[1]
        stack = (TABLES.go[stack[0], left], stack)


def _tops() -> dict[int, tuple]:
    """A stack for each top that a row can leave, by LR state."""
    found, todo = {BOTTOM[0]: BOTTOM}, [BOTTOM]
    while todo:
        stack = todo.pop()
        for token in TOKENS:
            to = shifted(stack, token)
            if to is not None and to[0] not in found:
                found[to[0]] = to
                todo.append(to)
    return found


TOPS = _tops()
#: the token that may follow a top, of those that can be inserted or reroled to
NEXT = {top: next(t for t in ROLES if shifted(stack, t)) for top, stack in TOPS.items()}


def merged(found: dict, stack: tuple, cost: int, rank: int, letters: str, came: int) -> bool:
    """Put a stack to those found, by its top; the least (cost, audit) stays."""
    old = found.get(stack[0])
    if old is None or (cost, rank, letters) < old[1:4]:
        found[stack[0]] = (stack, cost, rank, letters, came)
        return True
    return False


def inserted(tops: tuple) -> dict:
    """The tops with those that inserts lead to."""
    found = {stack[0]: (stack, cost, rank, "", stack[0]) for stack, cost, rank in tops}
    grown = True
    while grown:
        grown = False
        for stack, cost, rank, letters, came in list(found.values()):
            for token in ROLES:
                to = shifted(stack, token)
                if to is not None and merged(found, to, cost + INSERT, rank, letters + "I", came):
                    grown = True
    return found


def read(tops: tuple, code: int) -> tuple[int, tuple, dict]:
    """One row: (cost that all share, tops after it, top -> (top before, letters)).
    ``tops`` are (stack, cost, rank)."""
    token, fault = (TOKENS + "-")[code // 4], code % 4
    found: dict = {}
    for stack, cost, rank, letters, came in inserted(tops).values():
        merged(found, stack, cost + DELETE, rank, letters + "D", came)
        if fault in (FINE, TRUNCATED):
            stays = STAYS_TRUNCATED if fault == TRUNCATED else 0
            for to in {token, *ROLES} - {"-"}:
                after = shifted(stack, to)
                if after is not None:
                    merged(found, after, cost + stays + (KEEP if to == token else REROLE), rank, letters + ("K" if to == token else "R"), came)
    least = min(f[1] for f in found.values())
    order = sorted(found.values(), key=lambda f: f[2:4])
    return least, tuple((f[0], f[1] - least, i) for i, f in enumerate(order)), {f[0][0]: (f[4], f[3]) for f in order}


_READ: dict = {}


def parsed(codes: bytes, entry: int) -> tuple[dict[int, tuple[int, int]], list[dict]]:
    """Top that leaves -> (cost, rank), and for each row top -> (top before,
    letters). A row's step depends on the tops' relative costs only; the few
    steps that occur are kept."""
    tops, total, back = ((TOPS[entry], 0, 0),), 0, []
    for code in codes:
        step = _READ.get((tops, code))
        if step is None:
            step = _READ[tops, code] = read(tops, code)
        total += step[0]
        tops = step[1]
        back.append(step[2])
    return {stack[0]: (total + cost, rank) for stack, cost, rank in tops}, back


def edits(codes: bytes, entry: int, leave: int) -> list[str]:
    """The letters of each row of a chunk, on the best way from ``entry`` to ``leave``."""
    _, back = parsed(codes, entry)
    out = []
    for step in reversed(back):
        leave, letters = step[leave]
        out.append(letters)
    return out[::-1]


def ended(tops: tuple) -> tuple[int, int, str]:
    """(cost, top before, letters inserted at the end) of the best accepted stack."""
    cost, _, letters, came = min((f[1], f[2], f[3], f[4]) for f in inserted(tops).values() if shifted(f[0], END) is not None)
    return cost, came, letters


def routed(tables: list[dict]) -> tuple[int, list[tuple[int, int]], str]:
    """Chunk tables (entry -> leave -> (cost, rank)) put together: the cost, each
    chunk's (entry, leave), and the letters at the end."""
    tops = {BOTTOM[0]: (0, 0)}
    back = []
    for table in tables:
        found: dict = {}
        for entry, (cost, rank) in tops.items():
            for leave, (more, inner) in table[entry].items():
                if leave not in found or (cost + more, rank, inner) < found[leave][:3]:
                    found[leave] = (cost + more, rank, inner, entry)
        order = sorted(found, key=lambda x: found[x][1:3])
        tops = {leave: (found[leave][0], i) for i, leave in enumerate(order)}
        back.append({leave: found[leave][3] for leave in found})
    cost, leave, letters = ended(tuple((TOPS[x], c, r) for x, (c, r) in tops.items()))
    ways = []
    for step in reversed(back):
        ways.append((step[leave], leave))
        leave = step[leave]
    return cost, ways[::-1], letters


# ------------------------------------------------------------------ Spark

def _id(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage: conv (a space: null), turn, role, text."""
    kind = F.crc32(F.concat(_id("conv_id"), F.lit(":"), _id("turn"))) % 20
    role, text = _id("role"), _id("text")
    rows = conversations.select(
        _id("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), kind.alias("kind"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.filter("kind <> 0").select("conv", "turn", "role", "text", copies.alias("copy")).drop("copy")


def placed(rows: DataFrame) -> DataFrame:
    """Rows with their place (from 1), chunk, role token, and fault but for
    duplicates; a written table."""
    keys = [F.col("turn"), F.substring("role", 1, 64), F.substring("text", 1, 64), F.xxhash64("role", "text")]
    rows = running(rows, "conv", keys, lambda row: (1,), (0,), lambda x, y: (x[0] + y[0],), ("n",), (), "repair-rows")
    bare = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    token = F.instr(F.lit(TOKENS), F.substring("role", 1, 1))
    token = F.when((F.col("role") == "") | (token == 0), len(TOKENS)).otherwise(token - 1)
    fault = F.when(bare == "", BLANK).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    return rows.select("*", F.floor((F.col("n") - 1) / CHUNK).cast("long").alias("chunk"), token.alias("token"), fault.alias("fault"),
                       F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("same"))


def coded(rows: DataFrame) -> DataFrame:
    """(conv, chunk, codes): a byte a row, its role token and its first fault."""
    seen = rows.groupBy("conv", "same").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times")
    told = rows.select("conv", "n", "chunk", "token", "fault", "same").join(seen, ["conv", "same"], "left")
    fault = F.when((F.col("fault") != BLANK) & (F.col("first") < F.col("n")), DUPLICATE).otherwise(F.col("fault"))
    byte = F.struct("n", (F.col("token") * 4 + fault).cast("byte").alias("code"))
    return told.groupBy("conv", "chunk").agg(F.sort_array(F.collect_list(byte)).alias("rows")).select("conv", "chunk", F.col("rows.code").alias("codes"))


def _codes(batch: pa.RecordBatch) -> list[bytes]:
    return [bytes(c) for c in pylist(batch, "codes")]


_TOTALS = ("blank", "duplicate", "truncated", "illegal")
_WAY = "conv string, chunk long, chunks long, entry int, leave int, tail string, cost long, blank long, duplicate long, truncated long, illegal long"


def tabled(chunks: DataFrame) -> DataFrame:
    """Each chunk's counts, first and last token and its (entry, leave, cost, rank) rows."""
    legal = {TOKENS.index(a) * 4 + TOKENS.index(b) for a, b in ("su", "ua", "au")}
    ways = pa.list_(pa.struct([("entry", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32())]))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, chunk, codes in zip(pylist(batch, "conv"), pylist(batch, "chunk"), _codes(batch)):
                found = [{"entry": e, "leave": x, "cost": c, "rank": r} for e in (TOPS if chunk else (BOTTOM[0],)) for x, (c, r) in parsed(codes, e)[0].items()]
                faults, tokens = [c % 4 for c in codes], [c // 4 for c in codes]
                illegal = sum(a == len(TOKENS) or b == len(TOKENS) or a * 4 + b not in legal for a, b in zip(tokens, tokens[1:]))
                out.append((conv, chunk, found, *(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), illegal, tokens[0], tokens[-1]))
            columns = list(zip(*out)) if out else [[] for _ in range(9)]
            types = [pa.string(), pa.int64(), ways, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["conv", "chunk", "ways", *_TOTALS, "head", "last"])

    made = on_workers(chunks, tables, "conv string, chunk long, ways array<struct<entry:int,leave:int,cost:long,rank:int>>, blank long, duplicate long, truncated long, illegal long, head int, last int")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def conversation():
            whole = []
            for row in held:
                table: dict = {}
                for w in row["ways"]:
                    table.setdefault(w["entry"], {})[w["leave"]] = (w["cost"], w["rank"])
                whole.append(table)
            cost, ways, letters = routed(whole)
            total = [sum(row[t] for row in held) for t in _TOTALS]
            total[3] += sum(a["last"] == len(TOKENS) or b["head"] == len(TOKENS) or a["last"] * 4 + b["head"] not in legal for a, b in zip(held, held[1:]))
            return [(row["conv"], row["chunk"], len(held), *way, letters if row is held[-1] else "", cost, *total) for row, way in zip(held, ways)]

        def out(rows):
            names = [f.split()[0] for f in _WAY.split(", ")]
            types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        ready: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["conv"] != row["conv"]:
                    ready += conversation()
                    held = []
                    if len(ready) > CHUNK:
                        yield out(ready)
                        ready = []
                held.append(row)
        if held:
            ready += conversation()
        if ready:
            yield out(ready)

    return on_workers(made.repartition("conv").sortWithinPartitions("conv", "chunk"), joined, _WAY)


def applied(rows: DataFrame, chunks: DataFrame, ways: DataFrame) -> DataFrame:
    """(conv, audit, repaired_sha256): every chunk's edits stand before its rows."""

    def lettered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: pylist(batch, n) for n in ("conv", "chunk", "chunks", "entry", "leave", "tail")}
            found = [",".join([*edits(codes, c["entry"][i], c["leave"][i]), c["tail"][i]]) for i, codes in enumerate(_codes(batch))]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("chunk"), batch.column("chunks"), batch.column("entry"), pa.array(found, pa.string())], names=["conv", "chunk", "chunks", "entry", "letters"])

    todo = on_workers(ways.join(chunks, ["conv", "chunk"]), lettered, "conv string, chunk long, chunks long, entry int, letters string")
    none = F.lit(None)
    marks = todo.select("conv", "chunk", F.lit(0).cast("long").alias("n"), "letters", none.cast("string").alias("role"), none.cast("string").alias("text"), "chunks", "entry")
    texts = rows.select("conv", "chunk", "n", none.cast("string").alias("letters"), "role", "text", none.cast("long").alias("chunks"), none.cast("int").alias("entry"))
    work = marks.unionByName(texts).repartition("conv", "chunk").sortWithinPartitions("conv", "chunk", "n")
    names = ["conv", "chunk", "piece", "audit", "sha", "bytes"]

    def batch_of(rows):
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A conversation of one chunk is finished here; a longer one leaves its
        chunk's part of the audit and pieces of its repaired bytes."""
        out: list[tuple] = []
        key = chunks_ = top = plan = at = digest = None
        held, size, piece = [], 0, 0

        def say(role: str, text: str):
            nonlocal size
            raw = f"\n{role}:{text}".encode()
            held.append(raw)
            size += len(raw)

        def flush():
            nonlocal held, size, piece
            raw = b"".join(held)
            if digest is not None:
                digest.update(raw if piece else raw[1:])
            elif raw:
                out.append((*key, piece + 1, None, None, raw))
            piece += bool(raw)
            held, size = [], 0

        def edit(letters: str, role: str | None, text: str | None):
            nonlocal top
            for letter in letters:
                if letter == "D":
                    continue
                token = role[:1] if letter == "K" else NEXT[top]
                say(role if letter == "K" else ROLES[token], "" if letter == "I" else text)
                top = shifted(TOPS[top], token)[0]

        def finish():
            edit(plan[-1], None, None)
            flush()
            if digest is not None:
                out.append((*key, 0, "".join(plan), digest.hexdigest(), None))
            else:
                out.append((*key, 0, "".join(plan), None, None))

        for batch in batches:
            c = {n: pylist(batch, n) for n in ("conv", "chunk", "letters", "role", "text", "chunks", "entry")}
            for i in range(batch.num_rows):
                if c["letters"][i] is not None:
                    if key is not None:
                        finish()
                    key, chunks_, top = (c["conv"][i], c["chunk"][i]), c["chunks"][i], c["entry"][i]
                    plan, at, piece = c["letters"][i].split(","), 0, 0
                    digest = hashlib.sha256() if chunks_ == 1 else None
                else:
                    edit(plan[at], c["role"][i], c["text"][i])
                    at += 1
                    if size > PIECE_BYTES:
                        flush()
            if out:
                yield batch_of(out)
                out = []
        if key is not None:
            finish()
            yield batch_of(out)

    made = staged(on_workers(work, repaired, "conv string, chunk long, piece long, audit string, sha string, bytes binary"), "repair-pieces")
    whole = made.filter("sha is not null").select("conv", "audit", F.col("sha").alias("repaired_sha256"))
    several = made.filter("sha is null").repartition("conv").sortWithinPartitions("conv", "chunk", "piece")

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, digest, letters, begun = None, None, [], False

        def done():
            return pa.RecordBatch.from_arrays([pa.array([own]), pa.array(["".join(letters)]), pa.array([digest.hexdigest()])], names=["conv", "audit", "repaired_sha256"])

        for batch in batches:
            for conv, audit, raw in zip(*(pylist(batch, c) for c in ("conv", "audit", "bytes"))):
                if own != conv:
                    if own is not None:
                        yield done()
                    own, digest, letters, begun = conv, hashlib.sha256(), [], False
                if raw is None:
                    letters.append(audit)
                else:
                    digest.update(raw if begun else raw[1:])
                    begun = True
        if own is not None:
            yield done()

    return whole.unionByName(on_workers(several, digested, "conv string, audit string, repaired_sha256 string"))


def repaired(conversations: DataFrame) -> DataFrame:
    """A row for each conversation: faults, the cheapest edits and the digest of
    what they leave."""
    rows = placed(damaged(conversations))
    chunks = staged(coded(rows), "repair-chunks")
    ways = staged(tabled(chunks), "repair-ways")
    gaps = rows.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    totals = ways.filter("chunk = 0").select("conv", "cost", *_TOTALS)
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("conv", _id("conv_id"))
    out = every.join(gaps, "conv", "left").join(totals, "conv", "left").join(applied(rows, chunks, ways), "conv", "left")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", *_TOTALS, "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
