"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds to them.

The field labels a window of tokens with non-overlapping segments (email, ip, card, phone; all
else is outside). Its features look at a whole candidate span at once: digit count, grouping,
separators, checksum, octet range, what stands around it. A dynamic program over segments of
bounded length finds the best boundaries and types together, holding a few tokens of a window however
long it is; training maximises the likelihood of complete segmentations with the matching forward and
backward sums.

No table has labels for this, so the field is trained on sentences generated here, with fixed
seed: the entity types in many spellings, among dates, versions, amounts and serial numbers.
That bounds training at EXAMPLES sentences, whatever the corpus.

Spans of the fixed patterns always stay. A segment of the field is added under its type if its
score passes MARGIN and it overlaps no fixed span.

Defined cases: a null text counts as empty; an empty text has no spans; every row is scanned
by itself, so repeated rows give equal results; a null doc_id is returned as it is; columns
other than doc_id and text are ignored; an empty table gives an empty result. Offsets are code
points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import deque
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import text_or_empty

KINDS = ("email", "ip", "card", "phone")

# The base patterns. E-mail and IP are taken apart, since as one pattern each they
# would read a long run of their characters again from every place in it.
LOCAL_BACKWARDS = re.compile(r"[A-Za-z0-9._%+-]*")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

EXAMPLES = 400
EPOCHS = 6
#: Most tokens, and characters, of an entity.
SPAN_TOKENS, SPAN_CHARS = 16, 254
#: Log-odds that an added segment must reach.
MARGIN = 3.0
#: Tokens after which choices are given out.
SETTLE = 1024
#: Characters of context on either side of a digit group or an @.
CONTEXT = 24


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str):
    """Leftmost matches: an @, all that can stand before it (back to the last match), and a domain behind it."""
    done, at = 0, text.find("@")
    while at >= 0:
        local = LOCAL_BACKWARDS.match(text[done:at][::-1]).end()
        domain = DOMAIN.match(text, at + 1) if local else None
        if domain:
            yield at - local, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def ips(text: str):
    """Leftmost matches: of a dotted chain of numbers four at a time, those of octets."""
    for m in DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        at, parts = m.start(), m[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) < 4 for p in four):
                yield at, end
            at = end + 1


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, in order."""
    out = [(a, 0, e) for a, e in emails(text)]
    if "." in text:
        out += [(a, 1, e) for a, e in ips(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _digits(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


# ---------------------------------------------------------------- features of whole spans

TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|.", re.S)
CUES = {
    "tel": "phone", "phone": "phone", "call": "phone", "fax": "phone", "mobile": "phone",
    "mail": "email", "email": "email", "contact": "email", "ip": "ip", "host": "ip", "server": "ip",
    "card": "card", "visa": "card", "credit": "card",
}


def span_features(text: str, start: int, end: int, cue: str) -> list[str]:
    """Names of what holds for text[start:end] as one segment."""
    s = text[start:end]
    groups = re.findall(r"[0-9]+", s)
    n = sum(map(len, groups))
    letters = sum(c.isalpha() for c in s)
    out = [f"digits{min(n, 20)}", f"groups{min(len(groups), 6)}", "shape" + "-".join(str(min(len(g), 9)) for g in groups[:6])]
    seps = set(re.sub(r"[A-Za-z0-9]", "", s))
    out += [f"sep{c}" for c in sorted(seps & set(" .-()+/:@_,"))]
    out.append("pure" if not letters else "letters")
    if s[0] in "+(":
        out.append("opens" + s[0])
    if 14 <= n <= 19:
        out.append("luhn" if luhn("".join(groups)) else "noluhn")
    if len(groups) == 4 and "." in seps and not letters:
        out.append("octets" if all(len(g) < 4 and int(g) < 256 for g in groups) else "nooctets")
    if letters:
        user = re.fullmatch(r"[\w.%+-]+ ?(@|\(at\)|\[at\]| at ) ?[\w-]+(( ?(\.|\(dot\)|\[dot\]| dot ) ?)[\w-]+)+", s)
        out.append("address" if user else "noaddress")
    before, after = text[start - 1 : start], text[end : end + 1]
    out.append("joined" if before.isalnum() or after.isalnum() or before in ("-", "+", "@", "/") and before else "free")
    if after and after in "-@/" or after == "." and text[end + 1 : end + 2].isalnum():
        out.append("goeson")
    if cue:
        out.append("cue" + cue)
    return out


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches that may hold an entity: digit groups and @ signs with their context, merged."""
    out: list[tuple[int, int]] = []
    for m in SEED.finditer(text):
        a, b = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        while a > 0 and text[a - 1].isalnum() and m.start() - a < 2 * CONTEXT:
            a -= 1
        while b < len(text) and text[b].isalnum() and b - m.end() < 2 * CONTEXT:
            b += 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SEED = re.compile(r"@|\(at\)|\[at\]| at [A-Za-z0-9-]+ dot |[0-9](?:[\x20().-]{0,2}[0-9]){6,}")


def candidates(text: str, a: int, b: int) -> tuple[list[re.Match], list[tuple[int, int, list[str]]]]:
    """Tokens of text[a:b], and (first token, token after the last, features) of all spans that could be entities."""
    tokens = list(TOKEN.finditer(text, a, b))
    spans, cue, cues = [], "", []
    for t in tokens:
        cues.append(cue)
        if t[0].isalpha():
            cue = CUES.get(t[0].lower(), "")
    for i, t in enumerate(tokens):
        first = t[0]
        if not (first.isalnum() and first.isascii() or first in "+("):
            continue
        digits, at = 0, False
        for j in range(i, min(len(tokens), i + SPAN_TOKENS)):
            part = tokens[j][0]
            if "\n" in part or not part.isascii() or tokens[j].end() - t.start() > SPAN_CHARS:
                break
            if part[0].isdigit():
                digits += len(part)
            at |= part in ("@", "at")
            if part.isalnum() and (digits >= 7 or at and j >= i + 2):
                spans.append((i, j + 1, span_features(text, t.start(), tokens[j].end(), cues[i])))
    return tokens, spans


def _starts(near: deque[tuple[str, int, str]]) -> list[int]:
    """Places in near, in order, at which a span that ends with its last token may start (as candidates() has them)."""
    out, digits, at = [], 0, False
    end = near[-1][1] + len(near[-1][0])
    for i in range(len(near) - 1, -1, -1):
        part, start, _ = near[i]
        if "\n" in part or not part.isascii() or end - start > SPAN_CHARS:
            break
        if part[0].isdigit():
            digits += len(part)
        at |= part in ("@", "at")
        if (part.isalnum() or part in "+(") and (digits >= 7 or at and i <= len(near) - 3):
            out.append(i)
    return out[::-1]


def _settled(back: dict[int, tuple[int, int, int, int, float]], ends: set[int]):
    """Takes out of back, and gives in order, the choices before the last token that the best ways to all ends pass."""
    while len(ends) > 1:
        last = max(ends)
        ends.discard(last)
        ends.add(back[last][0] if last in back else last - 1)
    at, out = min(ends), []
    passed, first = at, min(back, default=at + 1)
    while at >= first:
        if at in back:
            out.append(back[at][1:])
            at = back[at][0]
        else:
            at -= 1
    for k in [k for k in back if k <= passed]:
        del back[k]
    yield from out[::-1]


# ---------------------------------------------------------------- the field


class SemiMarkov:
    """Weights by (kind, feature) and by kind, and sums over segmentations of a token window."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.w = weights or {}

    def score(self, kind: str, features: list[str]) -> float:
        w = self.w
        return w.get(kind, -2.0) + sum(w.get(f"{kind}|{f}", 0.0) for f in features)

    def lattice(self, n: int, spans) -> list[list[tuple[int, int, float, int]]]:
        """By end token: (start token, kind, score, number of the span)."""
        ends: list[list[tuple[int, int, float, int]]] = [[] for _ in range(n + 1)]
        for k, (i, j, features) in enumerate(spans):
            for kind, name in enumerate(KINDS):
                ends[j].append((i, kind, self.score(name, features), k))
        return ends

    def best(self, n: int, spans) -> list[tuple[int, int, int, float]]:
        """(start token, end token, kind, score) of the best segmentation's entities."""
        if not spans:
            return []
        ends, value, back = self.lattice(n, spans), [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            value[j] = value[j - 1]
            for i, kind, s, _ in ends[j]:
                if value[i] + s > value[j]:
                    value[j], back[j] = value[i] + s, (i, kind, s)
        out, j = [], n
        while j:
            if back[j] and value[j] > value[j - 1]:
                i, kind, s = back[j]
                out.append((i, j, kind, s))
                j = i
            else:
                j -= 1
        return out[::-1]

    def decode(self, text: str, a: int, b: int):
        """(start, end, kind, score), in characters, of what best() finds in text[a:b]. Spans are scored as the program
        reaches their end, and choices that all ways on have in common are given out, so that a few tokens are held."""
        near: deque[tuple[str, int, str]] = deque(maxlen=SPAN_TOKENS)  # the last tokens: text, start, cue before them
        values: deque[float] = deque([0.0], maxlen=SPAN_TOKENS + 1)
        back: dict[int, tuple[int, int, int, int, float]] = {}  # by end token: start token, start, end, kind, score
        cue, n = "", 0
        for m in TOKEN.finditer(text, a, b):
            part = m[0]
            near.append((part, m.start(), cue))
            n += 1
            best, choice = values[-1], None
            if part.isalnum() and part.isascii():
                for i in _starts(near):
                    first, start, own_cue = near[i]
                    features = span_features(text, start, m.end(), own_cue)
                    for kind, name in enumerate(KINDS):
                        s = self.score(name, features)
                        total = values[i - len(near)] + s
                        if total > best:
                            best, choice = total, (n - (len(near) - i), start, m.end(), kind, s)
            values.append(best)
            if choice:
                back[n] = choice
            if part.isalpha():
                cue = CUES.get(part.lower(), "")
            if n % SETTLE == 0:
                yield from _settled(back, set(range(n - SPAN_TOKENS, n + 1)))
        yield from _settled(back, {n})

    def expected(self, n: int, spans) -> list[tuple[int, int, float]]:
        """(span, kind, probability) of every candidate under the field."""
        ends = self.lattice(n, spans)
        forward = np.zeros(n + 1)
        for j in range(1, n + 1):
            forward[j] = np.logaddexp.reduce([forward[j - 1], *(forward[i] + s for i, _, s, _ in ends[j])])
        starts: list[list[tuple[int, int, float, int]]] = [[] for _ in range(n + 1)]
        for j, group in enumerate(ends):
            for i, kind, s, k in group:
                starts[i].append((j, kind, s, k))
        backward = np.zeros(n + 1)
        for i in range(n - 1, -1, -1):
            backward[i] = np.logaddexp.reduce([backward[i + 1], *(backward[j] + s for j, _, s, _ in starts[i])])
        return [
            (k, kind, math.exp(min(0.0, forward[i] + s + backward[j] - forward[n])))
            for j, group in enumerate(ends)
            for i, kind, s, k in group
        ]


def _example(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A generated sentence and its (start, kind, end)."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuvz") for _ in range(rng.randint(2, 9)))

    def card() -> str:
        while True:
            x = d(rng.choice((15, 16, 16, 16)))
            if luhn(x):
                sep = rng.choice(("", " ", "-"))
                return sep.join(x[i : i + 4] for i in range(0, len(x), 4))

    def serial() -> str:
        while True:
            x = d(rng.choice((14, 15, 16, 17)))
            if not luhn(x):
                return x

    entity = [
        lambda: (0, f"{word()}.{d(2)}@{word()}{d(1)}.{word()}.com"),
        lambda: (0, f"{word()}{rng.choice((' at ', ' (at) ', '(at)', '[at]'))}{word()}{rng.choice((' dot ', ' (dot) ', '.', '[dot]'))}{rng.choice(('com', 'org', 'net'))}"),
        lambda: (1, ".".join(str(rng.randint(0, 255)) for _ in range(4))),
        lambda: (2, card()),
        lambda: (3, f"+{rng.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}"),
        lambda: (3, f"({d(3)}) {d(3)}-{d(4)}"),
        lambda: (3, f"{rng.randint(2, 9)}{d(2)}-{d(3)}-{d(4)}"),
        lambda: (3, f"{rng.randint(2, 9)}{d(2)}.{d(3)}.{d(4)}"),
        lambda: (3, f"+{rng.randint(1, 99)} {d(3)} {d(3)} {d(4)}"),
        lambda: (3, f"00{rng.randint(30, 49)} {d(3)} {d(7)}"),
    ]
    other = [
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}",
        lambda: f"{rng.randint(10, 28)}.{rng.randint(10, 12)}.{rng.randint(1990, 2030)}",
        lambda: f"{rng.randint(1, 20)}.{rng.randint(0, 99)}.{d(4)}.{d(3)}",
        serial, lambda: d(rng.choice((7, 8, 9, 10, 11, 12, 13, 20, 24))),
        lambda: f"{d(3)} {d(3)} {d(3)}", lambda: f"{d(4)} {d(4)}", lambda: f"{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}",
        lambda: f"@{word()} {word()}", lambda: f"{word()} at {word()} {word()}", lambda: f"{d(2)}:{d(2)}:{d(2)}.{d(6)}",
        lambda: f"{word()}{d(8)}{word()}", lambda: f"{d(5)}-{d(5)}-{d(5)}", lambda: f"{d(6)}.{d(4)}",
        lambda: f"{rng.randint(256, 999)}.{rng.randint(256, 999)}.{d(3)}.{d(3)}",
    ]
    text, spans = "", []
    cue_of = {0: ("mail", "contact"), 1: ("ip", "host"), 2: ("card", "visa"), 3: ("call", "phone", "tel")}
    for _ in range(rng.randint(1, 3)):
        text += " ".join(word() for _ in range(rng.randint(1, 4))) + " "
        if rng.random() < 0.55:
            kind, s = rng.choice(entity)()
            if rng.random() < 0.3:
                text += rng.choice(cue_of[kind]) + rng.choice((" ", ": "))
            spans.append((len(text), kind, len(text) + len(s)))
        else:
            s = rng.choice(other)()
        text += s + rng.choice((" ", " ", ", ", ". "))
    return text + word(), spans


@cache
def trained(examples: int = EXAMPLES, epochs: int = EPOCHS, seed: int = 7) -> dict[str, float]:
    """Weights that make the generated segmentations likely (stochastic gradient with adaptive steps)."""
    rng = random.Random(seed)
    data = []
    for _ in range(examples):
        text, gold = _example(rng)
        tokens, spans = candidates(text, 0, len(text))
        at = {(tokens[i].start(), tokens[j - 1].end()): k for k, (i, j, _) in enumerate(spans)}
        data.append((len(tokens), spans, {at[(s, e)]: kind for s, kind, e in gold if (s, e) in at}))
    field = SemiMarkov({k: -2.0 for k in KINDS})
    w, seen = field.w, {}
    for _ in range(epochs):
        for n, spans, gold in data:
            grad: dict[str, float] = {}
            for k, kind, p in field.expected(n, spans):
                g = (gold.get(k) == kind) - p
                if abs(g) > 1e-4:
                    for f in (KINDS[kind], *(f"{KINDS[kind]}|{x}" for x in spans[k][2])):
                        grad[f] = grad.get(f, 0.0) + g
            for f, g in grad.items():
                seen[f] = seen.get(f, 0.0) + g * g
                w[f] = w.get(f, 0.0) + 0.5 * g / math.sqrt(1e-6 + seen[f]) - 1e-4 * w.get(f, 0.0)
    return w


def all_spans(text: str, field: SemiMarkov, fixed: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out = list(fixed)
    starts = [x[0] for x in fixed]
    reach = list(accumulate((x[2] for x in fixed), max))  # furthest end of the fixed spans so far
    for a, b in windows(text):
        for s, e, kind, score in field.decode(text, a, b):
            before = bisect_left(starts, e)  # fixed spans that begin before its end
            if score >= MARGIN and not (before and reach[before - 1] > s):
                out.append((s, kind, e))
    out.sort()
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: a row for each row of docs."""
    ship(docs.sparkSession)
    weights = trained()

    def scanned(batches):
        field = SemiMarkov(weights)
        for batch in batches:
            counts, base, spans = [[] for _ in KINDS], [], []
            for text in batch.column(1).to_pylist():
                fixed = fixed_spans(text)
                for k, column in enumerate(counts):
                    column.append(sum(x[1] == k for x in fixed))
                base.append(hashlib.sha256(joined(fixed).encode()).hexdigest())
                spans.append(joined(all_spans(text, field, fixed)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select("doc_id", F.col("text")).select("doc_id", text_or_empty().alias("text")).mapInArrow(scanned, schema)
