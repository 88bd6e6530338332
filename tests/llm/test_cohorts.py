import datetime as dt
import random
import zlib

import duckdb
import pytest

from ravelin.llm import cohorts as C
from tests.conftest import TESTDATA

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
T = dt.datetime


def rows(df):
    return sorted((r.state, r.segment, r.cohort, r.period, r.users, r.users_crc32, r.moved, r.cents) for r in df.collect())


def brute(clicks, clients):
    """The matrix by the definition, client by client."""
    import math

    source = {}
    for client, s in clients:
        if client is not None and s is not None:
            source[client] = min(s, source.get(client, s))
    known, out = {0: [], 1: []}, {}
    for c in set(clicks):
        click_id, ts, arrived, client, kind, value, _ = c
        if ts is None or client is None:
            continue
        h = zlib.crc32(str(click_id).encode()) if click_id is not None else 1
        if arrived is not None and arrived + dt.timedelta(days=h % 100 if h % 3 == 0 else 0) < T(2024, 2, 1):
            known[0].append(c)
        known[1].append(c)
    starts = {s: {} for s in known}
    for s, cs in known.items():
        for c in cs:
            if c[4] == "error":
                starts[s][c[3]] = min(c[1], starts[s].get(c[3], c[1]))
    cohort = lambda t: ((t - T(1970, 1, 1)) // dt.timedelta(days=1)) // 7
    for s, cs in known.items():
        for c in cs:
            start = starts[s].get(c[3])
            if start and c[1] >= start:
                cell = (s, source.get(c[3], ""), cohort(start), (c[1] - start) // dt.timedelta(days=7))
                users, cents = out.setdefault(cell, (set(), []))
                users.add(c[3])
                cents.append(0 if c[5] is None or not math.isfinite(c[5]) else math.floor(100 * c[5] + 0.5))
    moved = lambda u: u in starts[0] and u in starts[1] and cohort(starts[0][u]) != cohort(starts[1][u])
    return sorted((*cell, len(u), sum(zlib.crc32(str(x).encode()) for x in u), sum(map(moved, u)), sum(cents)) for cell, (u, cents) in out.items())


def test_equals_sql(spark):
    db = duckdb.connect()
    for t in ("clicks", "clients"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{TESTDATA}/{t}.parquet'")
    clicks, clients = (spark.read.parquet(f"{TESTDATA}/{t}.parquet") for t in ("clicks", "clients"))
    want = sorted(db.sql(C.ORACLE).fetchall())
    assert rows(C.retention(clicks, clients)) == want and any(w[6] for w in want)


@pytest.mark.parametrize("hot", [False, True])
def test_equals_brute_force(spark, hot, monkeypatch):
    """Nulls, repeated and late rows, exact period bounds; hot: most clicks of one client, in many slices."""
    rng = random.Random(11 + hot)
    clicks = []
    for i in range(1500):
        client = rng.choice([7] * 30 + [None, 0, 1, 2, 3, 4, 5, 6, 8, 9]) if hot else rng.choice([None, *range(12)])
        ts = T(2024, 1, 1) + dt.timedelta(days=rng.choice([0, 7, 14, 40, rng.random() * 150]), microseconds=rng.choice([-1, 0, 0, 1]))
        late = rng.choice([0.01, 0.01, 3, 60])
        clicks.append((
            rng.choice([None, i, i, i]), rng.choice([ts] * 20 + [None]), rng.choice([ts + dt.timedelta(days=late)] * 20 + [None]), client,
            rng.choice(["error", "view", "view", "buy", None]), rng.choice([None, float("nan"), float("inf"), 1.005, -0.125, 250.0, rng.random() * 100]), rng.choice([None, "{}"]),
        ))
    clicks += rng.sample(clicks, 200)
    clients = [(c, rng.choice([None, "web", "crm"])) for c in (None, *range(10))] + [(3, "app"), (4, None)]
    if hot:
        monkeypatch.setattr(C, "SLICES_A_BUCKET", 16)
    left = spark.createDataFrame(clicks, CLICKS).withColumn("slice", C.F.lit("x")).withColumn("segment", C.F.lit(1))
    right = spark.createDataFrame(clients, "client_id long, source string").withColumn("slices", C.F.lit(1))
    # NaN rows differ by identity in Python's set, equal rows were sampled as the same objects.
    assert rows(C.retention(left, right)) == brute(clicks, clients)
    if hot:
        written = C.tables(left, right)
        assert written[1].where("sliced").count() > 8
        assert {r.client_id for r in written[1].where("sliced").collect()} >= {7}


def test_joins_move_no_rows(spark):
    """The joins and each client's aggregation run inside the buckets."""
    clicks, clients = (spark.read.parquet(f"{TESTDATA}/{t}.parquet") for t in ("clicks", "clients"))
    parts = C.client_cells(*C.tables(clicks, clients))
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan


def test_edges(spark):
    empty = spark.createDataFrame([], CLICKS)
    clients = spark.createDataFrame([], "client_id long, source string")
    assert rows(C.retention(empty, clients)) == []
    one = (1, T(2024, 1, 5), T(2024, 1, 5), 3, "error", None, None)
    nothing = spark.createDataFrame([one, one, (2, T(2024, 1, 4), None, 3, "view", 1.0, None), (3, None, None, None, None, None, None)], CLICKS)
    assert rows(C.retention(nothing, clients)) == brute([one], [])
    assert len(rows(C.retention(nothing, clients))) == 2
