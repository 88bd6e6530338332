"""Toxicity by a weighted finite-state pattern grammar.

A clause is read by a composition of transducers: one turns words into insults and one into
threats, with weights (a threat weighs more behind a word of intent), one finds the targets,
and further ones mark what stands under a negation, inside reported speech, and aimed at a
target. The heaviest path says what the clause amounts to; a document is scored by its matched
clauses: for insults and threats, what those of each reading add up to, and the heaviest
clause, which weighs as much as its heaviest hit that is neither negated nor reported. An insult without a target is a clause of its own reading (plain), since an epithet
alone can be one; what it weighs is learned like the rest.

What is learned, and from what: the insult machine's words and stems with their weights, at
most MAX_ENTRIES, and the weights of the readings (logistic regression). Both come from a
bounded sample of the labelled rows outside the held-out fold: FIT_TOXIC toxic and FIT_CLEAN
others, the first by a hash of doc_id; their texts stay on the executors. labels, lang, source
and doc_id are no inputs of a score.

Defined cases: a null or empty text has no clause and gets the intercept's score; every row is
scored by itself, so repeated rows score alike; a null doc_id is not held out; labels that
repeat a document count once (toxic if any says so), null labels not at all; with no labels,
or none of one class, the seed words alone score; columns other than doc_id and text are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import discard, materialize, text_or_empty
from .transducers import Transducer

FOLDS, HELD_OUT = 5, 0
#: Bounds of the labelled sample that is fitted.
FIT_TOXIC, FIT_CLEAN = 2_000, 5_000
#: Stems of these lengths are learned besides whole words.
STEMS = (4, 5, 6)
#: A learned entry needs so many toxic rows, such log odds and such a log-likelihood ratio.
MIN_ROWS, MIN_ODDS, MIN_RATIO, MAX_ENTRIES = 3, 2.5, 16.0, 2_000

# Seed words of the grammar, in four languages.
INSULTS = "idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb filthy vermin coward dummkopf abschaum versager imbécile ordure crétin imbécil basura escoria"
THREATS = "kill hurt destroy crush beat strangle burn töten umbringen vernichten tuer détruire matar destruir"
TARGETS = "you your yours they them he him she her du dich dir ihr euch sie tu te toi vous ils eux tú usted ustedes ellos"
INTENTS = "will shall gonna going i'll we'll werde werden wirst vais va allons voy vamos"
NEGATIONS = "not no never nobody isn't aren't wasn't don't doesn't nicht kein keine nie niemals pas jamais aucun nunca jamás tampoco"
REPORTS = "said says claimed called quoted wrote reported sagte sagt schrieb nannte dit disait appelé écrit dijo dice escribió llamó"
SEED_WEIGHT = 1.5

CLAUSE = re.compile(r"[^.!?;:\n]+")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”«»„]")
#: Tokens under a negation, behind a word of intent, and from a target to what is aimed at it.
NEGATION_REACH, INTENT_REACH, TARGET_REACH = 3, 4, 4
QUOTES = set("\"“”«»„")


# ---------------------------------------------------------------- the grammar


# Symbols are (kind, marks, value). Words come in as ("word", {}, word); hits leave as
# ("insult" or "threat", marks, weight).
HITS = ("insult", "threat")
PLAIN_MARK: frozenset = frozenset()


def insults(weight: Callable[[str], float]) -> Transducer:
    """Words with a weight become insults."""

    def arcs(state, symbol):
        kind, mark, word = symbol
        w = weight(word) if kind == "word" else 0.0
        yield (("insult", mark, w) if w > 0 else symbol), 0.0, state

    return Transducer(0, arcs)


def threats_of(weights: dict[str, float]) -> Transducer:
    """State: tokens still under a word of intent. Words with a weight become threats, half as heavy again under intent."""
    intents = frozenset(INTENTS.split())

    def arcs(left, symbol):
        kind, mark, word = symbol
        if kind == "word" and word in intents:
            yield symbol, 0.0, INTENT_REACH
        elif kind == "word" and word in weights:
            yield ("threat", mark, weights[word] * (1.5 if left else 1.0)), 0.0, max(0, left - 1)
        else:
            yield symbol, 0.0, max(0, left - 1)

    return Transducer(0, arcs)


def targets() -> Transducer:
    """Words for whom something is aimed at."""
    words = frozenset(TARGETS.split())

    def arcs(state, symbol):
        yield (("target", symbol[1], symbol[2]) if symbol[0] == "word" and symbol[2] in words else symbol), 0.0, state

    return Transducer(0, arcs)


def negation() -> Transducer:
    """State: tokens still under a negation. Hits in reach are marked."""
    words = frozenset(NEGATIONS.split())

    def arcs(left, symbol):
        kind, mark, value = symbol
        if kind == "word" and value in words:
            yield symbol, 0.0, NEGATION_REACH
        elif kind in HITS and left:
            yield (kind, mark | {"negated"}, value), 0.0, left - 1
        else:
            yield symbol, 0.0, max(0, left - 1)

    return Transducer(0, arcs)


def reported() -> Transducer:
    """State: inside reported speech. A reporting verb opens it up to the clause's end, a quote toggles it."""
    words = frozenset(REPORTS.split())

    def arcs(inside, symbol):
        kind, mark, value = symbol
        if kind == "word" and value in words:
            yield symbol, 0.0, True
        elif kind == "word" and value in QUOTES:
            yield symbol, 0.0, not inside
        elif kind in HITS and inside:
            yield (kind, mark | {"reported"}, value), 0.0, inside
        else:
            yield symbol, 0.0, inside

    return Transducer(False, arcs)


def aimed() -> Transducer:
    """State: tokens since a target, and tokens in which a target must still come (a guess). A
    hit takes a target in reach behind it for certain, or guesses one ahead; only paths whose
    guess comes true may end, and they weigh more."""

    def arcs(state, symbol):
        since, due = state
        kind, mark, value = symbol
        if due == 1 and kind != "target":
            return
        later = 0 if kind == "target" else max(0, due - 1)
        since = 0 if kind == "target" else min(since + 1, TARGET_REACH + 1)
        if kind not in HITS:
            yield symbol, 0.0, (since, later)
        elif since <= TARGET_REACH:
            yield (kind, mark | {"aimed"}, value), 0.5, (since, later)
        else:
            yield symbol, 0.0, (since, later)
            yield (kind, mark | {"aimed"}, value), 0.5, (since, min(later, TARGET_REACH) if later else TARGET_REACH)

    return Transducer((TARGET_REACH + 1, 0), arcs, lambda s: float("-inf") if s[1] else 0.0)


#: What a hit can amount to.
READINGS = ("plain", "aimed", "negated", "reported")
#: For each kind of hit and reading the weight of its clauses, then all weight, and the heaviest clause.
FEATURES = len(HITS) * len(READINGS) + 2


def reading(mark: frozenset) -> str:
    return next((r for r in ("negated", "reported", "aimed") if r in mark), "plain")


class Grammar:
    """The composed machine over its words and stems; finds the clauses that can match and reads them."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], threats: dict[str, float]):
        self.words, self.stems, self.threats = words, stems, threats
        self.lengths = sorted({len(s) for s in stems}, reverse=True)
        self.parts = threats_of(threats), insults(self.weight), targets(), negation(), reported(), aimed()
        self.machine = reduce(Transducer.__matmul__, self.parts)
        self.automaton = ahocorasick.Automaton()
        for entry in (*words, *stems, *threats):
            self.automaton.add_word(entry, len(entry))
        if len(self.automaton):
            self.automaton.make_automaton()

    def weight(self, word: str) -> float:
        """Of an insult."""
        return max(self.words.get(word, 0.0), *(self.stems.get(word[:n], 0.0) for n in self.lengths if len(word) >= n), 0.0)

    def hit_places(self, low: str) -> list[int]:
        """Where an entry begins a word."""
        if not len(self.automaton):
            return []
        out = []
        for end, n in self.automaton.iter(low):
            at = end - n + 1
            if not at or not low[at - 1].isalpha():
                out.append(at)
        return out

    def read(self, clause: str) -> list[tuple[str, frozenset, float]]:
        """The hits of the heaviest path."""
        words = [("word", PLAIN_MARK, w) for w in WORD.findall(clause)]
        return [x for x in self.machine.best_path(words)[1] if x[0] in HITS]

    def features(self, text: str) -> list[float]:
        low = text.lower()
        total = {(k, r): 0.0 for k in HITS for r in READINGS}
        heaviest, done = 0.0, 0
        for at in sorted(self.hit_places(low)):
            if at < done:
                continue
            begin = max(done, 1 + max(low.rfind(c, done, at) for c in ".!?;:\n"))
            clause = CLAUSE.match(low, begin)
            done = clause.end()
            live = 0.0
            for kind, mark, w in self.read(clause[0]):
                r = reading(mark)
                total[kind, r] += w
                live = max(live, w if r in ("plain", "aimed") else 0.0)
            heaviest = max(heaviest, live)
        return [*map(math.log1p, total.values()), math.log1p(sum(total.values())), heaviest]


# ---------------------------------------------------------------- fitting


def held_out_fold() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def fit_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic of the bounded sample."""
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .where(~held_out_fold())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    first = F.xxhash64("doc_id")
    part = [known.where(cond).orderBy(first).limit(n) for cond, n in ((F.col("toxic") > 0, FIT_TOXIC), (F.col("toxic") <= 0, FIT_CLEAN))]
    # At most FIT_TOXIC + FIT_CLEAN rows of two numbers.
    sample = F.broadcast(part[0].union(part[1]))
    return docs.select("doc_id", "text").join(sample, "doc_id").select(text_or_empty().alias("text"), (F.col("toxic") > 0).cast("int").alias("toxic"))


def learn_entries(rows: DataFrame, n_toxic: int, n_clean: int) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems that set toxic rows apart: their log odds."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0)))
    stem = lambda n: F.transform(F.filter("w", lambda x: F.length(x) >= n), lambda x: F.concat(F.lit("s"), F.substring(x, 1, n)))
    each = rows.select("toxic", words.alias("w")).select(
        "toxic",
        F.explode(F.array_distinct(F.concat(F.transform("w", lambda x: F.concat(F.lit("w"), x)), *[stem(n) for n in STEMS]))).alias("entry"),
    )
    a, b = F.col("a"), F.col("b")
    odds = F.log((a + 0.5) / (n_toxic + 1.0)) - F.log((b + 0.5) / (n_clean + 1.0))
    part = lambda x, n: F.when(x > 0, x * F.log(x * (n_toxic + n_clean) / (n * (a + b)))).otherwise(0.0)
    found = (
        each.groupBy("entry")
        .agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
        .where(a >= MIN_ROWS)
        .select("entry", odds.alias("odds"), (2 * (part(a, n_toxic) + part(b, n_clean))).alias("ratio"))
        .where((F.col("odds") >= MIN_ODDS) & (F.col("ratio") >= MIN_RATIO))
        .orderBy(F.desc("ratio"), "entry")
        .limit(MAX_ENTRIES)
        .collect()
    )
    return (
        {r["entry"][1:]: r["odds"] for r in found if r["entry"][0] == "w"},
        {r["entry"][1:]: r["odds"] for r in found if r["entry"][0] == "s"},
    )


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Weights and (last) intercept by Newton's method, ridge on the weights."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], ridge * len(x) / 100)
    pull[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull) + 1e-9 * np.eye(len(w)), x.T @ (y - p) - pull * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def seeds() -> tuple[dict[str, float], dict[str, float]]:
    return dict.fromkeys(INSULTS.split(), SEED_WEIGHT), dict.fromkeys(THREATS.split(), SEED_WEIGHT)


def _read(parts, column: int, keep):
    """A task's function: features of the texts in a column, handed to keep(batch, features)."""

    def run(batches):
        grammar = Grammar(*parts)
        for batch in batches:
            yield keep(batch, np.array([grammar.features(t or "") for t in batch.column(column).to_pylist()]).reshape(-1, FEATURES))

    return run


def fit(docs: DataFrame, labels: DataFrame) -> tuple[tuple, np.ndarray]:
    """The parts of the grammar, and the weights of its features with (last) the intercept."""
    ship(docs.sparkSession)
    insult, threat = seeds()
    rows = materialize(fit_rows(docs, labels), "toxicity-sample")
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        weights = np.zeros(FEATURES + 1)
        weights[:2], weights[4:6], weights[-3:] = (0.5, 1.0), (0.5, 1.0), (1.0, 0.5, -2.5)
        return (insult, {}, threat), weights
    words, stems = learn_entries(rows, counts[1], counts[0])
    parts = ({**{w: x for w, x in words.items() if w not in threat}, **{w: max(x, words.get(w, 0.0)) for w, x in insult.items()}}, stems, threat)

    def keep(batch, x):
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["toxic", "x"])

    # A row of FEATURES numbers for each of the FIT_TOXIC + FIT_CLEAN texts at most.
    found = rows.select("text", "toxic").mapInArrow(_read(parts, 0, keep), "toxic int, x array<double>").toArrow()
    x, y = np.array(found.column("x").to_pylist()), np.array(found.column("toxic").to_pylist(), float)
    discard(rows)
    order = np.lexsort((*x.T, y))  # sums do not depend on the order of tasks
    return parts, logistic(x[order], y[order])


def _probability(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))


def score(docs: DataFrame, parts: tuple, weights: np.ndarray) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def keep(batch, x):
        p = _probability(x, weights)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
        )

    return docs.select("doc_id", held_out_fold().alias("held_out"), "text").mapInArrow(
        _read(parts, 2, keep), f"doc_id {kind}, held_out boolean, score double, predicted int"
    )


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, *fit(docs, labels))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that are predicted toxic."""
    parts, weights = fit(docs, labels)
    at = docs.columns.index("text")
    return docs.mapInArrow(_read(parts, at, lambda batch, x: batch.filter(pa.array(_probability(x, weights) < 0.5))), docs.schema)
