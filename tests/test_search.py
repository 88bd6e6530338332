"""Search against brute force: the k best kept in tasks, blocks, passes, masks, ties, nulls."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ravelin import catalog
from ravelin.operators import codes, search
from ravelin.operators.best import Best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5)), max_size=120), st.integers(1, 6), st.integers(0, 20))
def test_the_best_of_all_that_is_offered(rows, k, slack):
    best = Best(4, k)
    best.full = slack
    for i, (query, score) in enumerate(rows):
        if score >= best.floor[query]:
            best.offer(np.array([query]), np.array([-i]), np.array([float(score)]))
    got = [(q, s, i) for b in best.batches(np.arange(4)) for q, i, s in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    want = [(q, float(s), -i) for q in range(4) for s, i in sorted(((s, i) for i, (p, s) in enumerate(rows) if p == q), key=lambda x: (-x[0], -x[1]))[:k]]
    assert sorted(got) == sorted(want)


def keyed(df):
    return sorted((r.query_id, r["rank"], r.id, r.score) for r in df.collect())


def texts_and_queries(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["all"] * 20
    text = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(i, text(rng.choice([0, 1, 5, 40])), rng.randrange(8)) for i in range(150)] + [(150, "ALL " * 3000, 7), (151, None, 7), (None, "all", 7)]
    asked = [(i, text(rng.choice([0, 2, 9])), rng.choice([0, 1, 5])) for i in range(25)] + [(25, None, 0), (26, "nowhere", 0)]
    return rows, asked, spark.createDataFrame(rows, "id long, text string, bits long").repartition(5), spark.createDataFrame(asked, "query_id long, text string, need long")


def by_hand(rows, asked, k, masked):
    out = []
    for query, text, need in asked:
        own = Counter((text or "").lower().split())
        scored = []
        for i, t, bits in rows:
            if i is not None and (not masked or bits & need == need):
                other = Counter((t or "").lower().split())
                score = float(sum(n * other[w] for w, n in own.items()))
                scored += [(-score, i)] if score else []
        out += [(query, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("masked", [False, True])
@pytest.mark.parametrize("pass_bytes", [1, 2000, 1 << 20])
def test_sparse_search(spark, monkeypatch, masked, pass_bytes):
    monkeypatch.setattr(search, "PASS_BYTES", pass_bytes)
    rows, asked, texts, queries = texts_and_queries(spark, 5)
    if pass_bytes == 1:
        asked = asked[:4] + asked[25:]
        queries = queries.where("query_id < 4 or query_id >= 25")
    got = search.sparse_topk(queries if masked else queries.drop("need"), texts, 7)
    assert keyed(got) == by_hand(rows, asked, 7, masked)


def test_sparse_search_of_nothing(spark):
    _, _, texts, queries = texts_and_queries(spark, 6)
    assert search.sparse_topk(queries.limit(0), texts, 3).count() == 0
    assert search.sparse_topk(queries, texts.limit(0), 3).count() == 0


def test_dense_search_with_blocks_masks_and_ties(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (300, 4)).astype(float)  # many equal directions
    rows = [(i, x[i].tolist(), int(rng.integers(0, 8))) for i in range(300)]
    vectors = spark.createDataFrame([*rows, (None, [1.0] * 4, 7), (300, None, 7)], "id long, vector array<double>, bits long").repartition(3)
    asked = [(i, x[i].tolist(), int(rng.choice([0, 1, 6]))) for i in range(0, 300, 15)]
    queries = spark.createDataFrame([*asked, (1, None, 0)], "query_id long, vector array<double>, need long")
    unit = lambda v: v / (np.linalg.norm(v) or 1.0)
    want = []
    for q, v, need in asked:
        scored = sorted((-round(float(unit(np.array(v)) @ unit(np.array(w))), 6), i) for i, w, bits in rows if bits & need == need)
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:6], 1)]
    for name, value in {"QUERY_BLOCK": 3, "VECTOR_BLOCK": 7, "PASS_BYTES": 200}.items():
        monkeypatch.setattr(search, name, value)
    got = keyed(search.dense_topk(queries, vectors, 6))
    assert [r[:3] for r in got] == [r[:3] for r in sorted(want)]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in sorted(want)])


def test_what_is_shuffled_does_not_grow_with_batches(spark):
    """A task hands on k rows of each query, however many batches it has read."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        vectors = spark.range(2000, numPartitions=2).select("id", F.array(*[F.rand(i) - 0.5 for i in range(4)]).alias("vector"))
        queries = vectors.where("id < 3").withColumnRenamed("id", "query_id")
        plan = search.dense_topk(queries, vectors, 5)
        assert plan.count() == 15
        inner = plan._jdf.queryExecution().optimizedPlan().toString()
        assert inner.count("MapInArrow") == 1
        assert search.dense_topk(queries, vectors, 2000).count() == 6000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_coded_cells_find_nearly_all(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centre = rng.normal(0, 1, (30, 24))
    x = centre[rng.integers(0, 30, 5000)] + rng.normal(0, 0.2, (5000, 24))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    queries = vectors.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    centres = search.cell_centres(vectors, 32)
    books = codes.residual_books(vectors, centres, 8)
    index = codes.coded_index(vectors.union(spark.createDataFrame([(9999, None), (None, [1.0] * 24)], vectors.schema)), centres, books).cache()
    assert index.count() == 5000 and {len(r.code) for r in index.take(50)} == {8}
    exact = {(r.query_id, r.id, r.score) for r in search.dense_topk(queries, vectors, 10).collect()}
    found = lambda compare: {(r.query_id, r.id, r.score) for r in codes.coded_topk(queries, index, vectors, centres, books, 10, 4, compare).collect()}
    near = found(8)
    assert len({r[:2] for r in exact} & {r[:2] for r in near}) >= 0.9 * len(exact)
    assert len(near) == len(exact)
    score = {r[:2]: r[2] for r in exact}
    assert all(score[r[:2]] == pytest.approx(r[2], abs=2e-6) for r in near if r[:2] in score)
    # Rows and queries of a cell in slices give what whole cells give.
    monkeypatch.setattr(search, "SLICE", 40)
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    assert found(8) == near
    index.unpersist()


def test_codes_of_few_rows_and_uneven_parts(spark):
    vectors = spark.createDataFrame([(i, [float(i), 1.0, float(-i), 2.0, 0.5]) for i in range(6)] + [(6, [0.0] * 5)], "id long, vector array<double>")
    centres = search.cell_centres(vectors, 2)
    books = codes.residual_books(vectors, centres, 2)
    index = codes.coded_index(vectors, centres, books)
    queries = vectors.where("id < 6").withColumnRenamed("id", "query_id")
    got = codes.coded_topk(queries, index, vectors, centres, books, 7, 2)
    assert keyed(got) == keyed(search.dense_topk(queries, vectors, 7))
    assert codes.coded_topk(queries.limit(0), index, vectors, centres, books, 3, 2).count() == 0
    assert codes.coded_topk(queries, index.limit(0), vectors, centres, books, 3, 2).count() == 0


@pytest.mark.parametrize("name", ["cell_topk", "coded_topk"])
def test_recall_of_the_registered_searches(spark, name):
    d = "/root/testdata/sf0.01"
    exact = {(r.query_id, r.id) for r in catalog.QUERIES["dense_topk"](spark, d).collect()}
    near = [(r.query_id, r.id) for r in catalog.QUERIES[name](spark, d).collect()]
    assert len(near) == len(set(near)) == len(exact)
    assert len(exact & set(near)) >= 0.9 * len(exact), len(exact & set(near)) / len(exact)


def test_the_expression_form_refuses_many_queries(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "id long, vector array<double>")
    with pytest.raises(ValueError):
        search.dense_topk_expression(v.withColumnRenamed("id", "query_id"), v, 1)
    assert search.dense_topk_expression(v.limit(3).withColumnRenamed("id", "query_id"), v, 1).count() == 3


def test_pruned_postings_are_those_of_all_rows_of_a_key(spark):
    """Repeated and null keys are counted together; ties go by the token; texts that repeat no key are not shuffled."""
    rows = [(1, "b a a c"), (2, "x x y"), (2, "y y z"), (None, "q r"), (None, "r"), (3, ""), (4, None), (5, "é e E -")]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    for cap in (1, 2, 1000):
        got = sorted(map(str, search.pruned_postings(texts, "doc_id", cap).collect()))
        assert got == sorted(map(str, search.prune_sparse(search.postings(texts, "doc_id"), "doc_id", cap).collect()))
    plan = search.pruned_postings(texts.where("doc_id = 1"), "doc_id", 2)
    assert {(r.token, r.weight) for r in plan.collect()} == {("a", 2.0), ("b", 1.0)}


def test_passes_are_bounded_by_the_hits_they_keep(monkeypatch):
    monkeypatch.setattr(search, "PASS_HITS", 100)
    assert [len(x) for x in search._passes(iter(range(25)), lambda r: 1, 10)] == [10, 10, 5]
    assert [len(x) for x in search._passes(iter(range(25)), lambda r: 1, 1)] == [25]


def test_probes_of_more_rows_than_a_piece_are_whole(spark):
    vectors = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(3000)], "query_id long, vector array<double>").coalesce(1)
    found = search._nearest_cells(vectors, "query_id", np.eye(2), 2).mapInArrow(lambda bs: bs, "query_id long, vector array<double>, cell int")
    assert found.count() == 6000
    assert search._lists(np.arange(6.0).reshape(3, 2)).to_pylist() == [[0.0, 1.0], [2.0, 3.0], [4.0, 5.0]]
