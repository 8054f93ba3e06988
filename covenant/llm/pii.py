"""Personal data: base patterns, and a semi-Markov conditional random field.

Base patterns find e-mail addresses, IP addresses, card numbers and phone
numbers in whole texts. They are fixed; the field only adds spans beside them.

The field labels segments of tokens, not tokens: features are taken from a
whole candidate span (length, digits, separators, checksum, octets, letter case,
the words before it), and a pair of weights per pair of neighbouring types joins them.
Dynamic programming over segments of at most ``MAX_TOKENS`` tokens chooses
boundaries and types together. A segment may only hold an entity if it has a
digit or an at sign, so stretches of plain words can have but one labelling,
and the program runs on the windows around such tokens, as a stream: of a window
of any length only some thousand tokens are held.

It is trained by conditional likelihood on a bounded sample: ``SAMPLE_DOCS``
documents by hash of the identifier, of which ``SAMPLE_CHARS`` characters from a
hashed place anywhere in the text, with a digit or at sign in them; their labels are the base spans and keys
that are assigned to a name such as token or password. What cannot be of a type
(an address without four parts, a card that fails its checksum, a phone number
of eight digits) has no weight for it. Prediction covers
every character of every text.

Nulls and ties: a null text counts as empty and has no spans; rows that repeat
an identifier are scanned one by one; of equally good labellings the one that
starts fewer entities is taken. A table without such samples trains nothing,
and only base spans are found. An empty table gives an empty result; other
columns are ignored.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import hash_sample, on_workers, pylist, slices, whole_text

KINDS = ("email", "ip", "card", "phone")
#: what the field knows beside the base kinds
TYPES = (*KINDS, "secret")
MAX_TOKENS = 16
SAMPLE_DOCS, SAMPLE_CHARS = 240, 10_000
EPOCHS, RATE, DECAY = 40, 1.0, 1e-3
#: an entity has to be this much likelier, in log odds, than plain text
CAUTION = 1.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits either matches from its first digit or not at all
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"[0-9]+")
_KEY = re.compile(r"""(?:token|secret|password|passwd|api[_ -]?key)\s*[=:]\s*["']?([A-Za-z0-9_+/=-]{16,})""", re.I)

_NEVER = -1e9

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, from one at sign to the next, so that
    long runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _digits(text: str) -> str:
    return "".join(_NUMBER.findall(text))


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start; end exclusive."""
    out: list[Span] = [("email", a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 13 <= m.end() - m.start() <= 37 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def _silver(text: str) -> list[Span]:
    spans = base_spans(text)
    return spans + [("secret", m.start(1), m.end(1)) for m in _KEY.finditer(text) if not any(a < m.end(1) and m.start(1) < b for _, a, b in spans)]


_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_ANCHOR = re.compile(r"[0-9@]")
_CONTEXT = 4
#: beyond so many tokens a window ends where it may
_WINDOW = 256
#: tokens that are decoded at a time, and tokens that a candidate's first one looks ahead
PART, _AHEAD = 4096, MAX_TOKENS + 3


def parts(text: str) -> Iterator[tuple[list[tuple[int, int]], bool]]:
    """Token places around digits and at signs, in pieces of about ``PART``
    (tokens, whether the window ends with them); the stretches between hold no
    entity. A window only ends at a blank beside a token with letters, which no
    candidate crosses, some tokens after the last anchor; these tokens lead the
    next window, as what stands before it. A text dense in figures is one window
    of any length."""
    if not _ANCHOR.search(text):
        return
    tokens: list[tuple[int, int]] = []
    held = 0  # tokens of this window in earlier pieces
    idle, some, wordy = 0, False, False
    for m in _TOKEN.finditer(text):
        here = bool(_ANCHOR.search(m[0]))
        was, wordy = wordy, m[0][0].isalpha()
        if idle >= _CONTEXT and tokens and m.start() > tokens[-1][1] and (was or wordy):
            if some and (held + len(tokens) >= _WINDOW or idle >= MAX_TOKENS):
                yield tokens, True
                some, held = False, 0
            if not some:
                tokens = tokens[-_CONTEXT:]
        if len(tokens) >= PART + _CONTEXT:  # the last ones stay, for the next window to begin with
            if some:
                yield tokens[:-_CONTEXT], False
                held += len(tokens) - _CONTEXT
                tokens = tokens[-_CONTEXT:]
            else:  # plain words without a place to end: what lies this far back touches no candidate
                tokens = tokens[-_AHEAD:]
        tokens.append((m.start(), m.end()))
        some, idle = some or here, 0 if here else idle + 1
    if some:
        yield tokens, True


def windows(text: str) -> Iterator[list[tuple[int, int]]]:
    """The windows of ``parts``, each as a whole."""
    held: list[tuple[int, int]] = []
    for tokens, ends in parts(text):
        held += tokens
        if ends:
            yield held
            held = []


def candidates(text: str, tokens: list[tuple[int, int]], first: int = 0, last: int | None = None) -> list[tuple[int, int]]:
    """Segments (first token, token after the last) that may be an entity: not
    longer than the bound, whole at both ends, with a digit or at sign.
    Blanks may only stand between tokens without letters, of which there have to
    be seven digits, or four parts between dots, and 19 digits at most once
    there is a blank. Only segments whose first token is in [first, last)."""
    out = []
    marks = [text[a:b] for a, b in tokens]
    anchored = [bool(_ANCHOR.search(m)) for m in marks]
    digits = [sum(map(m.count, "0123456789")) if x else 0 for m, x in zip(marks, anchored)]
    solid = [m[0].isalnum() for m in marks]
    wordy = [x and d < len(m) for m, x, d in zip(marks, solid, digits)]
    tight = [i + 1 < len(tokens) and tokens[i][1] == tokens[i + 1][0] for i in range(len(tokens))]
    for i in range(first, len(tokens) if last is None else last):
        if not solid[i] and marks[i] not in "+(" or i and tight[i - 1] and (solid[i - 1] or marks[i - 1] in ".-_@+%/"):
            continue  # inside a run that has begun before
        seen = letters = blank = at = False
        n = dots = 0
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            if j > i and not tight[j - 1]:
                gap = text[tokens[j - 1][1]:tokens[j][0]]
                if gap != " " or letters or at or wordy[j] or not (digits[j - 1] or digits[j] or marks[j] == "("):
                    break
                blank = True
            seen, letters, at = seen or anchored[j], letters or wordy[j], at or marks[j] == "@"
            n, dots = n + digits[j], dots + (marks[j] == ".")
            if blank and (letters or at or n > 19):
                break
            if not seen or not solid[j] or not (letters or at or n >= 7 or dots == 3):
                continue
            if tight[j] and (solid[j + 1] or marks[j + 1] in "@-_" or marks[j + 1] == "." and tight[j + 1] and solid[j + 2]):
                continue  # the run goes on
            out.append((i, j + 1))
    return out


#: digits and ASCII letters as classes
_SHAPE = str.maketrans({**{c: "9" for c in "0123456789"}, **{chr(c): "a" for c in range(97, 123)}, **{chr(c): "A" for c in range(65, 91)}})
_GROUP = re.compile("9+")


def context(text: str, tokens: list[tuple[int, int]], i: int) -> list[str]:
    """Features of what stands before token i."""
    start = tokens[i][0]
    words = [text[a:b].lower() for a, b in tokens[max(0, i - _CONTEXT):i]]
    word = next((w for w in reversed(words) if w[0].isalpha()), "")
    return [f"named={word in ('token', 'secret', 'password', 'passwd', 'key')}", f"assigned={'=' in words or ':' in words}",
            f"ahead={text[start - 1] if start and not text[start - 1].isalnum() else ''}"]


def features(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> list[str]:
    """Whole-span features of the segment of tokens i to j."""
    span = text[tokens[i][0]:tokens[j - 1][1]]
    shape = span.translate(_SHAPE)
    n, size = shape.count("9"), len(span)
    lower, upper = shape.count("a"), shape.count("A")
    others = "".join(sorted(set(shape) - set("9aA")))
    out = ["bias", f"digits={min(n, 21)}", f"size={min(size, 48) // 4}", f"others={others[:8]}", f"tokens={min(j - i, 12)}",
           f"mix={n > 0}{upper > 0}{lower > 0}"]
    if "@" in span:
        left, _, right = span.partition("@")
        out.append(f"at={bool(left)}{'.' in right}{'@' in right}")
    if n + lower + upper == size and (lower or upper):
        out.append(f"hex={not span.strip('0123456789abcdefABCDEF')}{size >= 32}{size >= 16}{n * 4 >= size}")
    if not lower and not upper:
        parts = span.split(".")
        if len(parts) > 1:
            out.append(f"octets={len(parts)}{all(p.isascii() and p.isdigit() and len(p.lstrip('0')) <= 3 and int(p.lstrip('0') or 0) <= 255 for p in parts)}")
        if 13 <= n <= 19:
            out.append(f"luhn={luhn(_digits(span))}")
        out.append(f"plus={span[0] == '+'}{9 <= n <= 15}")
        out.append(f"groups={'-'.join(str(len(g)) for g in _GROUP.findall(shape))[:16]}")
    return out


def possible(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> list[bool]:
    """For each type, whether the segment may be of it at all."""
    span = text[tokens[i][0]:tokens[j - 1][1]]
    shape = span.translate(_SHAPE)
    n, letters = shape.count("9"), any(map(str.isalpha, span))
    left, sign, right = span.partition("@")
    parts = span.split(".")
    return [
        bool(left and sign and "." in right and "@" not in right),
        len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts),
        not letters and 13 <= n <= 19 and luhn(_digits(span)),
        not letters and 9 <= n <= 15 and len(parts) < 4,
        letters and n >= 3 and len(span) >= 16 and not sign,
    ]


class SemiMarkov:
    """Weights of whole-span features by type and of pairs of types; type 0 is
    a single plain token."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, pairs: np.ndarray):
        self.names, self.weights, self.pairs = names, weights, pairs

    def scores(self, text: str, tokens, segs) -> np.ndarray:
        out = np.zeros((len(segs), len(TYPES)))
        last, before = -1, []
        for s, (i, j) in enumerate(segs):
            if i != last:
                last, before = i, context(text, tokens, i)
            ids = [self.names[f] for f in (*features(text, tokens, i, j), *before) if f in self.names]
            out[s] = np.where(possible(text, tokens, i, j), self.weights[ids].sum(0), _NEVER)
        return out

    def best(self, text: str, tokens: list[tuple[int, int]]) -> list[Span]:
        """The best labelling of a window."""
        stream = Decoder(self, text)
        return [*stream.feed(tokens), *stream.end()]

    def found(self, text: str) -> Iterator[Span]:
        """The best labelling of each window of a text, as it becomes certain."""
        stream = Decoder(self, text)
        for tokens, ends in parts(text):
            yield from stream.feed(tokens)
            if ends:
                yield from stream.end()
                stream = Decoder(self, text)


class Decoder:
    """The dynamic program over one window, a piece at a time. A segment spans
    at most MAX_TOKENS tokens, so only that many rows of values go on. Links back
    are kept from the last place that all labellings still open have in common:
    what lies before it is certain and is given out."""

    def __init__(self, model: SemiMarkov, text: str):
        self.model, self.text = model, text
        self.tokens: list[tuple[int, int]] = []
        self.base = 0  # place of the first token held
        self.seeded = self.done = 0  # first tokens whose candidates are known; places whose values are
        start = np.full(len(TYPES) + 1, -np.inf)
        start[0] = 0
        self.value = {0: start}
        self.back: dict[int, list] = {0: [None] * (len(TYPES) + 1)}
        self.ending: dict[int, list] = {}
        self.certain = (0, 0)  # a node of every open labelling

    def feed(self, tokens: list[tuple[int, int]]) -> list[Span]:
        self.tokens += tokens
        size = self.base + len(self.tokens)
        if size - _AHEAD <= self.seeded:
            return []
        self._seed(size - _AHEAD)
        self._forward(self.seeded)
        live = [(p, k) for p in self.value for k in range(len(TYPES) + 1) if self.value[p][k] > -np.inf]
        return self._settle(live)

    def end(self) -> list[Span]:
        size = self.base + len(self.tokens)
        self._seed(size)
        self._forward(size)
        return self._settle([(size, int(self.value[size].argmax()))])

    def _seed(self, to: int) -> None:
        """Candidates that begin before the token at ``to``, with their scores."""
        segs = candidates(self.text, self.tokens, self.seeded - self.base, to - self.base)
        if segs:
            scores = self.model.scores(self.text, self.tokens, segs) - CAUTION
            for s in np.flatnonzero(scores.max(1) > -20).tolist():
                i, j = segs[s]
                self.ending.setdefault(self.base + j, []).append((self.base + i, scores[s], self.tokens[i][0], self.tokens[j - 1][1]))
        self.seeded = to
        drop = to - _CONTEXT - 1 - self.base
        if drop > 0:
            self.tokens, self.base = self.tokens[drop:], self.base + drop

    def _forward(self, to: int) -> None:
        pairs, types = self.model.pairs, len(TYPES)
        for end in range(self.done + 1, to + 1):
            row, links = np.full(types + 1, -np.inf), [None] * (types + 1)
            step = self.value[end - 1] + pairs[:, 0]
            prior = int(step.argmax())
            row[0], links[0] = step[prior], (end - 1, prior, None)
            for start, score, a, b in self.ending.pop(end, ()):
                step = self.value[start][:, None] + pairs[:, 1:] + score
                prior = step.argmax(0)
                for t in range(types):
                    if step[prior[t], t] > row[t + 1]:
                        row[t + 1], links[t + 1] = step[prior[t], t], (start, int(prior[t]), (TYPES[t], a, b))
            self.value[end], self.back[end] = row, links
            self.value.pop(end - MAX_TOKENS, None)
        self.done = max(self.done, to)

    def _settle(self, live: list[tuple[int, int]]) -> list[Span]:
        """The spans up to the last node that all labellings from the ``live``
        nodes have in common."""
        nodes = set(live)
        while len(nodes) > 1:  # all of them lead back to the certain node
            top = max(nodes)
            nodes.remove(top)
            nodes.add(self.back[top[0]][top[1]][:2])
        node = nodes.pop()
        out, at = [], node
        while at != self.certain:
            link = self.back[at[0]][at[1]]
            if link[2] is not None:
                out.append(link[2])
            at = link[:2]
        for place in [p for p in self.back if p < node[0]]:
            del self.back[place]
        self.certain = node
        return out[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis)
    safe = np.where(np.isfinite(top), top, 0)
    return safe + np.log(np.exp(x - np.expand_dims(safe, axis)).sum(axis) + 1e-300)


def train(texts: list[str], epochs: int = EPOCHS) -> SemiMarkov | None:
    """Conditional likelihood by gradient ascent. Each window is a lattice of
    plain tokens and candidate segments; forward and backward sums give the
    chance of each segment and of each pair of types."""
    names: dict[str, int] = {}
    data = []
    for text in texts:
        truth = {(a, b): TYPES.index(kind) for kind, a, b in _silver(text)}
        for tokens in windows(text):
            segs = candidates(text, tokens)
            if not segs:
                continue
            ids = [[names.setdefault(f, len(names)) for f in (*features(text, tokens, i, j), *context(text, tokens, i))] for i, j in segs]
            gold = [truth.get((tokens[i][0], tokens[j - 1][1]), -1) for i, j in segs]
            never = np.array([[0 if x else _NEVER for x in possible(text, tokens, i, j)] for i, j in segs])
            gold = [g if g >= 0 and not never[s, g] else -1 for s, g in enumerate(gold)]
            data.append((len(tokens), segs, ids, gold, never))
    if not any(g >= 0 for *_, gold, _ in data for g in gold):
        return None
    types = len(TYPES)
    weights, pairs = np.zeros((len(names), types)), np.zeros((types + 1, types + 1))
    seen_w, seen_p = np.full_like(weights, 1e-8), np.full_like(pairs, 1e-8)
    for _ in range(epochs):
        grad_w, grad_p = -DECAY * weights, -DECAY * pairs
        for n, segs, ids, gold, never in data:
            scores = np.array([weights[x].sum(0) for x in ids]) + never
            cuts = sorted({0, n, *(i for i, _ in segs), *(j for _, j in segs)})
            at = {c: k for k, c in enumerate(cuts)}
            arcs = [(at[i], at[j], s) for s, (i, j) in enumerate(segs)]
            into: list[list[tuple[int, int]]] = [[] for _ in cuts]
            out_of: list[list[tuple[int, int]]] = [[] for _ in cuts]
            for a, b, s in arcs:
                into[b].append((a, s))
                out_of[a].append((b, s))
            gaps = np.diff(cuts)
            low = -1e30
            fore = np.full((len(cuts), types + 1), low)
            fore[0, 0] = 0
            stay = pairs[0, 0]
            for k in range(1, len(cuts)):
                fore[k, 0] = _log_sum(fore[k - 1] + pairs[:, 0], 0) + (gaps[k - 1] - 1) * stay
                if into[k]:
                    rows = np.stack([_log_sum(fore[a][:, None] + pairs[:, 1:], 0) + scores[s] for a, s in into[k]])
                    fore[k, 1:] = _log_sum(rows, 0)
            aft = np.full((len(cuts), types + 1), low)
            aft[-1] = 0
            for k in range(len(cuts) - 2, -1, -1):
                rows = [pairs[:, 0] + (gaps[k] - 1) * stay + aft[k + 1, 0]]
                for b, s in out_of[k]:
                    rows.append(_log_sum(pairs[:, 1:] + (scores[s] + aft[b, 1:])[None, :], 1))
                aft[k] = _log_sum(np.stack(rows), 0)
            total = _log_sum(fore[-1], 0)
            for a, b, s in arcs:
                joint = np.exp(np.minimum(0, fore[a][:, None] + pairs[:, 1:] + (scores[s] + aft[b, 1:])[None, :] - total))
                grad_p[:, 1:] -= joint
                grad_w[ids[s]] -= joint.sum(0)
            for k in range(1, len(cuts)):
                joint = np.exp(np.minimum(0, fore[k - 1] + pairs[:, 0] + (gaps[k - 1] - 1) * stay + aft[k, 0] - total))
                grad_p[:, 0] -= joint
                grad_p[0, 0] -= (gaps[k - 1] - 1) * joint.sum()
            # the labelling of the sample
            chosen = sorted((i, j, s) for s, (i, j) in enumerate(segs) if gold[s] >= 0)
            prior, place = 0, 0
            for i, j, s in chosen:
                if i < place:
                    continue
                if i > place:
                    grad_p[prior, 0] += 1
                    grad_p[0, 0] += i - place - 1
                    prior = 0
                grad_p[prior, gold[s] + 1] += 1
                grad_w[ids[s], gold[s]] += 1
                prior, place = gold[s] + 1, j
            if place < n:
                grad_p[prior, 0] += 1
                grad_p[0, 0] += n - place - 1
        seen_w += grad_w ** 2
        seen_p += grad_p ** 2
        weights += RATE * grad_w / np.sqrt(seen_w)
        pairs += RATE * grad_p / np.sqrt(seen_p)
    return SemiMarkov(names, weights, pairs)


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> SemiMarkov | None:
    text = whole_text()
    place = F.pmod(F.xxhash64("doc_id", F.char_length(text)), F.greatest(F.char_length(text) - sample_chars + 1, F.lit(1))).cast("int") + 1
    some = docs.select("doc_id", F.substr(text, place, F.lit(sample_chars)).alias("text")).filter(F.col("text").rlike("[0-9@]"))
    rows = hash_sample(some, ["doc_id", "text"], sample_docs).orderBy("_rank").collect()
    return train([r["text"] for r in rows])


def spans(text: str, model: SemiMarkov | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans): the field's spans that overlap no base span are added."""
    base = base_spans(text)
    if model is None:
        return base, base
    found = list(model.found(text))
    if not found:
        return base, base
    taken = sorted((a, b) for _, a, b in base)
    added, k = [], 0
    for span in sorted(found, key=lambda x: x[1]):
        while k < len(taken) and taken[k][1] <= span[1]:
            k += 1
        if not any(a < span[2] and span[1] < b for a, b in taken[k:k + 4]):
            added.append(span)
    return base, sorted(base + added, key=lambda x: (TYPES.index(x[0]), x[1]))


def joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def scan(docs: DataFrame, model: SemiMarkov | None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans,
    n_added, for every row."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = rows.select("doc_id").schema
    for name, kind in ([(f"n_{k}", "long") for k in KINDS] + [("base_sha256", "string"), ("spans", "string"), ("n_added", "long")]):
        schema = schema.add(name, kind)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                found = [spans(t or "", model) for t in pylist(part, "text")]
                counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *counts, pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]),
                     pa.array([joined(every) for _, every in found]), pa.array([len(every) - len(base) for base, every in found], pa.int64())],
                    names=schema.names)

    return on_workers(rows, run, schema)
