"""Product codes of vectors: integer codebooks fitted by Yinyang Lloyd rounds.

A vector's components become integers (a step of 1 / SCALE), and the vector PARTS equal consecutive parts. Each
part position has a codebook, started from the smallest vec_ids; a round assigns every part to
the nearest entry and moves the entries to the floored means; after the last round parts are assigned once more.

Only the first assignment compares a part with all entries. The entries of a position are clustered into GROUPS
groups once. Each part keeps its entry and one lower bound for each group, the distance to the
nearest entry there other than its own, and both are written beside it after each round. When entries
have moved, a bound falls by the furthest move in its group, the distance to the own entry is taken anew, and
only groups whose bound no longer exceeds it are scanned. Bounds are whole numbers, rounded to the
safe side, and are compared in integers, squared; an equal bound counts as failed, so a tie always meets the exact
comparison, which the lower index wins.

Codebooks (ENTRIES times the vector's length) travel with the tasks and come back as sums for each
entry, summed in each task first. All else stays in tables.

Defined cases: a row whose vector is null or holds a null or non-finite component is left out, and so
are rows with a component of LIMIT / SCALE or more, whose squares would not fit 64 bits, and rows whose vector is not as long as that
of the smallest vec_id; a length that PARTS does not divide is filled with zeros; repeated vec_ids are rows of their own (ordered by
their components where they name entries); a row without vec_id is coded but names no entry; with fewer than
ENTRIES rows there are as many entries; where no row has a vec_id, or the table is empty, the result is empty; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import discard, materialize, release, small_or_plain

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Groups of entries that share a bound.
GROUPS = 8
#: Components below this can be squared and summed in 64 bits.
LIMIT = 1 << 27
#: Broadcast limit for the sums of labels.
BROADCAST_LABELS = 100_000
_FAR = np.int64(1) << np.int64(62)


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, label, x: the rows that are kept, components as integers."""
    fits = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LIMIT / SCALE)
    rows = vectors.select("vec_id", "label", "embedding").where(F.col("embedding").isNotNull() & F.forall("embedding", fits))
    return rows.select("vec_id", "label", F.transform("embedding", lambda v: F.floor(v.cast("double") * SCALE).cast("int")).alias("x"))


def first_books(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> tuple[np.ndarray, int]:
    """(codebooks (parts, entries, components of a part), length of the vectors)."""
    found = [r["x"] for r in rows.where("vec_id IS NOT NULL").orderBy("vec_id", "x").limit(entries).select("x").collect()]
    if not found:
        return np.zeros((parts, 0, 0), np.int64), 0
    width = len(found[0])
    while sum(len(x) == width for x in found) < len(found):  # rows of other lengths are no rows of this table
        found = [r["x"] for r in rows.where((F.size("x") == width) & F.col("vec_id").isNotNull()).orderBy("vec_id", "x").limit(entries).select("x").collect()]
    return _parts(np.array(found, np.int64).reshape(len(found), width), parts).transpose(1, 0, 2).copy(), width


def _parts(x: np.ndarray, parts: int) -> np.ndarray:
    """(rows, parts, components of a part), filled with zeros."""
    each = -(-x.shape[1] // parts)
    if each * parts != x.shape[1]:
        x = np.hstack([x, np.zeros((len(x), each * parts - x.shape[1]), np.int64)])
    return x.reshape(len(x), parts, each)


def entry_groups(book: np.ndarray, groups: int = GROUPS) -> list[np.ndarray]:
    """Entries of one codebook, clustered: lists of their indices, none empty."""
    n = len(book)
    centres = book[np.linspace(0, n - 1, min(groups, n)).astype(int)].astype(float)
    own = np.zeros(n, int)
    for _ in range(5):
        own = ((book[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in np.unique(own):
            centres[g] = book[own == g].mean(axis=0)
    return [np.flatnonzero(own == g) for g in np.unique(own)]


def _root(d: np.ndarray) -> np.ndarray:
    """Whole numbers no greater than the square roots."""
    return np.maximum(np.sqrt(d.astype(np.float64)).astype(np.int64) - (d >= 1 << 50), 0)


def _squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows and entries, exact."""
    out = np.zeros((len(x), len(book)), np.int64)
    for i in range(book.shape[1]):
        out += (x[:, i, None] - book[None, :, i]) ** 2
    return out


class Yinyang:
    """Assignment of parts to entries of moved codebooks, by the bounds of an earlier assignment."""

    def __init__(self, books: np.ndarray, groups: list[list[np.ndarray]], drift: np.ndarray | None = None):
        """drift (parts, entries): how far each entry has moved since the bounds were set, rounded up."""
        self.books, self.groups, self.drift = books, groups, drift
        self.most = max(map(len, groups), default=0)
        self.scanned = 0  #: distances taken by scans

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entries, squared distances, bounds) of x (rows, parts, components), everything compared."""
        n, parts = x.shape[:2]
        code, square = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.int64)
        low = np.zeros((n, parts, self.most), np.int64)
        rows = np.arange(n)
        for p, groups in enumerate(self.groups):
            d = _squares(x[:, p], self.books[p])
            self.scanned += d.size
            best = d.argmin(axis=1)
            code[:, p], square[:, p] = best, d[rows, best]
            d[rows, best] = _FAR
            for g, members in enumerate(groups):
                low[:, p, g] = _root(d[:, members].min(axis=1))
        return code, square, low

    def again(self, x: np.ndarray, code: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same from an earlier (code, low): only groups whose bound fails are scanned."""
        code, low = code.copy(), low.copy()
        square = np.zeros(code.shape, np.int64)
        for p, groups in enumerate(self.groups):
            book, part, old = self.books[p], x[:, p], code[:, p].astype(np.int64)
            own = ((part - book[old]) ** 2).sum(axis=1)
            best, least = old.copy(), own.copy()
            group_of = np.zeros(len(book), np.int64)
            for g, members in enumerate(groups):
                group_of[members] = g
            looked = np.zeros((len(part), len(groups)), bool)
            second = {}
            for g, members in enumerate(groups):
                bound = low[:, p, g] - self.drift[p, members].max()
                low[:, p, g] = np.maximum(bound, 0)
                rows = np.flatnonzero(low[:, p, g] ** 2 <= least)
                if not len(rows):
                    continue
                looked[rows, g] = True
                d = _squares(part[rows], book[members])
                self.scanned += d.size
                at = d.argmin(axis=1)
                index, value = members[at], d[np.arange(len(rows)), at]
                d[np.arange(len(rows)), at] = _FAR
                low[rows, p, g] = _root(value)
                second[g] = (rows, index, _root(d.min(axis=1)))
                better = (value < least[rows]) | (value == least[rows]) & (index < best[rows])
                best[rows[better]], least[rows[better]] = index[better], value[better]
            for g, (rows, index, runner_up) in second.items():
                mine = index == best[rows]
                low[rows[mine], p, g] = runner_up[mine]
            # A group that was not scanned now holds the entry that was left.
            left = np.flatnonzero((best != old) & ~looked[np.arange(len(part)), group_of[old]])
            low[left, p, group_of[old[left]]] = np.minimum(low[left, p, group_of[old[left]]], _root(own[left]))
            code[:, p], square[:, p] = best, least
        return code, square, low


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


STATE = "code binary, low binary, error long"


def assigned(rows: DataFrame, step: Yinyang, width: int, parts: int = PARTS, again: bool = False) -> DataFrame:
    """rows (x and, from an earlier assignment, code and low) with code, low and error of this one."""
    names = [c for c in rows.columns if c not in ("code", "low", "error")]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _parts(_matrix(batch.column("x"), width), parts)
            if again:
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, parts)
                low = np.frombuffer(b"".join(batch.column("low").to_pylist()), "<i4").reshape(n, parts, step.most).astype(np.int64)
                code, square, low = step.again(x, code, low)
            else:
                code, square, low = step.first(x)
            low = np.minimum(low, (1 << 31) - 1).astype("<i4")
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array([r.tobytes() for r in code], pa.binary()), pa.array([r.tobytes() for r in low], pa.binary()),
                 pa.array(square.sum(axis=1))],
                names=[*names, "code", "low", "error"],
            )

    return rows.select(*names, *(["code", "low"] if again else [])).mapInArrow(run, f"{kinds}, {STATE}")


def moved(state: DataFrame, books: np.ndarray, width: int) -> np.ndarray:
    """Codebooks of the floored means of the parts assigned to each entry; unused entries stay. Each task sends a
    row for each component of an entry, so what is summed and collected follows the codebooks alone."""
    parts, entries, each = books.shape

    def sums(batches):
        total, n = np.zeros((parts, entries, each), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _parts(_matrix(batch.column(0), width), parts)
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, parts)
            for p in range(parts):
                np.add.at(total[p], code[:, p], x[:, p])
                n[p] += np.bincount(code[:, p], minlength=entries)
        p, e = np.nonzero(n)
        at = (np.repeat(p * entries + e, each), np.tile(np.arange(each), len(p)))
        flat = total.reshape(-1, each)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[0]), pa.array(at[1]), pa.array(flat[at]), pa.array(n.ravel()[at[0]])], names=["entry", "i", "s", "n"]
        )

    found = state.select("x", "code").mapInArrow(sums, "entry long, i long, s long, n long").groupBy("entry", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    out = books.copy()
    flat = out.reshape(-1, each)
    for r in found.collect():  # a row for each component of the codebooks at most
        flat[r["entry"], r["i"]] = r["s"] // r["n"]
    return out


def _drift(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """How far each entry moved, rounded up."""
    square = ((after - before) ** 2).sum(axis=2)
    return np.array([[math.isqrt(int(d) - 1) + 1 if d else 0 for d in row] for row in square], np.int64).reshape(square.shape)


def codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, x, code (an entry a byte), error of every kept row; the final codebooks)."""
    spark = vectors.sparkSession
    ship(spark)
    rows = integers(vectors)
    books, width = first_books(rows, parts, entries)
    if not books.size:
        return spark.createDataFrame([], f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema.fields)}, code binary, error long"), books
    groups = [entry_groups(b) for b in books]
    state = materialize(assigned(rows.where(F.size("x") == width), Yinyang(books, groups), width, parts), "codes-state")
    for _ in range(rounds):
        after = moved(state, books, width)
        step, books = Yinyang(after, groups, _drift(books, after)), after
        following = materialize(assigned(state, step, width, parts, again=True), "codes-state")
        discard(state)
        release(spark)
        state = following
    return state.drop("low"), books


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()


def digest(vectors: DataFrame) -> DataFrame:
    """vec_id, code (hex), error, label_error, codebooks_sha256 of every kept row."""
    rows, books = codes(vectors)
    totals = materialize(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "codes-labels").withColumnRenamed("label", "of")
    totals = small_or_plain(totals, totals.count(), BROADCAST_LABELS)
    return rows.join(totals, rows["label"].eqNullSafe(totals["of"])).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256")
    )


def _round(k: int) -> str:
    """near{k}: the nearest entry of each part in book{k}; book{k + 1}: its floored means."""
    return f"""
near{k} AS (SELECT x.r, x.p, min(list_sum(list_transform(list_zip(x.s, b.s), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * {ENTRIES} + b.e) AS de
  FROM parts x JOIN book{k} b USING (p) GROUP BY x.r, x.p),
mean{k} AS (SELECT p, e, list(c ORDER BY i) AS s FROM (
  SELECT n.p, n.de % {ENTRIES} AS e, i, floor(sum(x.s[i]) / count(*))::BIGINT AS c
  FROM near{k} n JOIN parts x USING (r, p), LATERAL (SELECT unnest(range(1, len(x.s) + 1)) AS i) GROUP BY ALL) GROUP BY p, e),
book{k + 1} AS (SELECT b.p, b.e, coalesce(m.s, b.s) AS s FROM book{k} b LEFT JOIN mean{k} m USING (p, e))"""


ORACLE = f"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT r, vec_id, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS s FROM kept, (SELECT unnest(range({PARTS})) AS p)),
book0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, s FROM parts
  WHERE r IN (SELECT r FROM kept ORDER BY vec_id LIMIT {ENTRIES})),
{",".join(_round(k) for k in range(ROUNDS + 1))},
coded AS (SELECT r, string_agg(printf('%02x', de % {ENTRIES}), '' ORDER BY p) AS code, sum(de // {ENTRIES})::BIGINT AS error FROM near{ROUNDS} GROUP BY r),
hashed AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, i)) AS h FROM (SELECT p, e, unnest(s) AS c, generate_subscripts(s, 1) AS i FROM book{ROUNDS}))
SELECT k.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, h AS codebooks_sha256
FROM kept k JOIN coded c USING (r), hashed
"""
