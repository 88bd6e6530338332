import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from ravelin.llm import vector_codes as V
from tests.conftest import TESTDATA

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=str)


def brute(vectors):
    """Codes by comparing every part with every entry in each round."""
    kept = [(i, [math.floor(256 * np.float32(x).item()) for x in v], label) for i, v, label in vectors
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted([(i, v) for i, v, _ in kept if i is not None])[: V.ENTRIES]
    w = len(seeds[0][1]) // V.PARTS
    part = lambda v, p: tuple(v[p * w : p * w + w])
    books = [[part(v, p) for _, v in seeds] for p in range(V.PARTS)]
    near = lambda s, p: min((sum((a - b) ** 2 for a, b in zip(s, e)), k) for k, e in enumerate(books[p]))
    for _ in range(V.ROUNDS):
        after = []
        for p in range(V.PARTS):
            members = {}
            for _, v, _ in kept:
                members.setdefault(near(part(v, p), p)[1], []).append(part(v, p))
            after.append([tuple(sum(c) // len(c) for c in zip(*members[k])) if k in members else e for k, e in enumerate(books[p])])
        books = after
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    coded = []
    for i, v, label in kept:
        best = [near(part(v, p), p) for p in range(V.PARTS)]
        coded.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), label))
    total = {}
    for _, _, e, label in coded:
        total[label] = total.get(label, 0) + e
    return sorted(((i, c, e, total[label], sha) for i, c, e, label in coded), key=str)


def test_equals_sql(spark):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{TESTDATA}/embeddings.parquet'")
    assert rows(V.digest(spark.read.parquet(f"{TESTDATA}/embeddings.parquet"))) == sorted(db.sql(V.ORACLE).fetchall(), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    """Coarse values make ties everywhere; nulls, broken rows, repeated ids and vectors, few and many rows."""
    rng = random.Random(seed)
    n = (300, 40, 200)[seed]
    value = lambda: rng.choice([-1, 0, 1]) / 256 if seed == 0 else rng.gauss(0, 0.3)
    vectors = [(rng.choice([None, i, i, i, i // 2 + 1000]), [value() for _ in range(32)], rng.choice([None, 1, 2])) for i in range(n)]
    vectors += [vectors[0], (5, None, 1), (6, [None] * 32, 1), (7, [float("nan")] + [0.0] * 31, 2), (8, [float("inf")] + [0.0] * 31, None)]
    rng.shuffle(vectors)
    df = spark.createDataFrame(vectors, SCHEMA).withColumn("code", V.F.lit(1)).withColumn("low", V.F.lit("x")).withColumn("of", V.F.lit(2))
    assert rows(V.digest(df)) == brute(vectors)


@pytest.mark.parametrize("seed", range(4))
def test_bounds_skip_and_stay_right(seed):
    """After moves of the entries the bounds are below the true distances, most groups are skipped, and nothing changes."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(-400, 400, (40, 16, 4))
    x = centres[rng.integers(0, 40, 3000)] + rng.integers(-30, 30, (3000, 16, 4))
    books = x[:64].transpose(1, 0, 2).copy()
    groups = [V.entry_groups(b) for b in books]
    assert all(sorted(np.concatenate(g).tolist()) == list(range(64)) for g in groups)
    code, square, low = V.Yinyang(books, groups).first(x)
    for move in (12, 3, 0):
        after = books + rng.integers(-move, move + 1, books.shape)
        step = V.Yinyang(after, groups, V._drift(books, after))
        code, square, low = step.again(x, code, low)
        plain = V.Yinyang(after, groups).first(x)
        assert (code == plain[0]).all() and (square == plain[1]).all()
        for p in range(16):
            d = V._squares(x[:, p], after[p])
            d[np.arange(len(x)), code[:, p]] = V._FAR
            for g, members in enumerate(groups[p]):
                assert (low[:, p, g] ** 2 <= d[:, members].min(axis=1)).all()
        books = after
        assert step.scanned < 0.6 * x.shape[0] * 16 * 64
    assert step.scanned < 0.4 * x.shape[0] * 16 * 64


def test_edges(spark):
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert rows(V.digest(make([]))) == []
    assert rows(V.digest(make([(None, [0.5] * 16, 1)]))) == []
    one = rows(V.digest(make([(1, [0.5] * 16, None), (2, [0.5] * 32, None), (3, [1e30] * 16, 1)])))
    assert [r[:4] for r in one] == [(1, "00" * 16, 0, 0)]
    uneven = rows(V.digest(make([(1, [0.5] * 20, 4), (2, [0.25] * 20, 4)])))
    assert [r[:4] for r in uneven] == [(1, "00" * 16, 0, 0), (2, "01" * 10 + "00" * 6, 0, 0)]
