"""Windows by joins, cells without pair rows, embedding cache, nested front matter."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.operators import context, embed, search
from ravelin.sources.versions import VersionedTable


@pytest.mark.parametrize("budget", [3, 20, 75])
def test_windows_by_joins_equal_those_of_whole_documents(spark, budget):
    rng = random.Random(budget)
    chunks = {d: {i: (f"{d}#{i}", "x" * rng.choice([0, 1, 5, 16, 40, 120, 700])) for i in range(rng.randint(1, 60))} for d in "abcdef"}
    hits = [(q, d, rng.randint(0, 70), rank) for q in range(8) for rank, d in enumerate(rng.choices("abcdefg", k=25), 1)]
    rows = [(d, i, *c) for d, cs in chunks.items() for i, c in cs.items()]
    got = context.auto_merge(
        spark.createDataFrame(hits, "query_id long, doc_id string, chunk_index int, rank int"),
        spark.createDataFrame(rows, "doc_id string, chunk_index int, chunk_id string, text string").repartition(5), budget,
    )
    want = []
    for q in range(8):
        for d in "abcdefg":
            own = [(i, r) for x, y, i, r in hits if (x, y) == (q, d)]
            for w in context.merge_document(own, chunks.get(d, {}), budget) if own else []:
                ids = [chunks.get(d, {})[i][0] for i in w["indices"] if i in chunks.get(d, {})]
                want.append((q, d, w["indices"], ids, w["text"], w["rank"]))
    assert sorted((r.query_id, r.doc_id, r.merged_chunk_indices, r.merged_chunk_ids, r.text) for r in got.collect()) == sorted(w[:5] for w in want)
    for q in range(8):
        order = sorted((w for w in want if w[0] == q), key=lambda w: (w[5], w[1], w[2][0]))
        assert [(r.doc_id, r.merged_chunk_indices) for r in got.where(F.col("query_id") == q).orderBy("rank").collect()] == [(w[1], w[2]) for w in order]


def test_windows_take_gaps_in_the_index_and_other_token_counts(spark):
    rows = [("a", i, f"a{i}", "word " * 4) for i in (0, 3, 4, 9)]
    chunks = spark.createDataFrame(rows, "doc_id string, chunk_index int, chunk_id string, text string")
    hits = spark.createDataFrame([(1, "a", 3, 1, "own"), (1, "a", 5, 2, "alone"), (1, "z", 0, 3, None)], "query_id long, doc_id string, chunk_index int, rank int, text string")
    merged = {r.rank: r for r in context.auto_merge(hits, chunks, 8, tokens=F.size(T.words(F.col("text")))).collect()}
    assert merged[1].merged_chunk_ids == ["a0", "a3"] and merged[2].text == "alone" and merged[3].text is None and not merged[3].auto_merged
    assert context.auto_merge(hits.limit(0), chunks).count() == 0


def test_only_chunks_in_reach_take_part(spark):
    """A long document of which one chunk is hit: what the window is made of is a few chunks."""
    rows = spark.range(20_000).select(F.lit("d").alias("doc_id"), F.col("id").cast("int").alias("chunk_index"), F.col("id").cast("string").alias("chunk_id"), F.lit("x" * 400).alias("text"))
    hits = spark.createDataFrame([(1, "d", 10_000, 1)], "query_id long, doc_id string, chunk_index int, rank int")
    assert context.auto_merge(hits, rows, 1000).first().merged_chunk_count == 10
    taken = []
    plain = context.windows

    def counted(own, cost, budget):
        taken.append(len(cost))
        return plain(own, cost, budget)

    # What a task is handed of the document: the hit's bin and its neighbours.
    light = [{"query_id": 1, "doc_id": "d", "place": i, "cost": 100, "rank": 1 if i == 10 else None} for i in range(30)]
    context.windows = counted
    try:
        list(context._merged(1000)([context.pa.RecordBatch.from_pylist(light[:7]), context.pa.RecordBatch.from_pylist(light[7:])]))
    finally:
        context.windows = plain
    assert taken == [30]


def clustered(rng, n, centres, spread):
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(0, spread, (n, centres.shape[1]))
    return [(int(i), [float(v) for v in row]) for i, row in enumerate(x)]


def test_cells_find_nearly_all_at_a_quarter_of_the_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = clustered(rng, 6000, rng.normal(0, 1, (40, 24)), 0.15)
    vectors = spark.createDataFrame(rows, "id long, vector array<double>")
    queries = vectors.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    centres = search.cell_centres(vectors, 32)
    index = search.cell_index(vectors, centres)
    exact = {(r.query_id, r.id) for r in search.dense_topk(queries, vectors, 10).collect()}
    got = search.cell_topk(queries, index, centres, 10, 4)
    near = {(r.query_id, r.id) for r in got.collect()}
    assert len(exact & near) >= 0.9 * len(exact)
    size = {r.cell: r["count"] for r in index.groupBy("cell").count().collect()}
    pairs = sum(size.get(r.cell, 0) for r in search._nearest_cells(queries, "query_id", centres, 4).collect())
    assert pairs <= 0.25 * len(rows) * queries.count()
    # Slices of a cell give what whole cells give.
    monkeypatch.setattr(search, "SLICE", 50)
    assert {(r.query_id, r.id) for r in search.cell_topk(queries, index, centres, 10, 4).collect()} == near
    assert search.cell_topk(queries.limit(0), index, centres, 10, 4).count() == 0


def test_texts_reach_the_model_once(spark, tmp_path):
    cache = VersionedTable(spark, f"file://{tmp_path}/cache")
    asked = tmp_path / "asked"

    def load():
        model = embed.hashed_embedder(8)

        def counting(texts):
            with open(asked, "a") as f:
                f.write(f"{len(texts)}\n")
            if "bad" in texts:
                raise RuntimeError("no")
            return model(texts)

        return counting

    count = lambda: sum(map(int, asked.read_text().split())) if asked.exists() else 0
    docs = spark.createDataFrame([(i, f"text {i % 30}") for i in range(100)] + [(100, None)], "id long, text string")
    run = lambda df, model="m": {r.id: (r.dense, r.embed_ok) for r in embed.cached_vectors(df, "id", F.col("text"), cache, model, load, 8).collect()}
    first = run(docs)
    plain = embed.hashed_embedder(8)
    assert len(first) == 101 and count() == 31 and all(ok and v == pytest.approx(plain([f"text {i % 30}"])[0].tolist()) for i, (v, ok) in first.items() if i < 100)
    assert run(docs) == first and count() == 31
    more = docs.union(spark.createDataFrame([(200, "new"), (201, "text 3")], docs.schema))
    assert run(more)[201] == first[3] and count() == 32
    run(docs, "other")
    assert count() == 63 and cache.read().count() == 63
    bad = spark.createDataFrame([(1, "bad")], docs.schema)
    assert run(bad)[1] == ([0.0] * 8, False) and run(bad)[1][1] is False and count() == 65 and cache.read().count() == 63


def test_nested_front_matter_is_read_by_path(spark):
    head = "---\ntitle: Guide\ntags: [a, b]\nnav:\n  order: 3\n  parents:\n    - name: Start\n      id: 1\n    - name: Deep\ndraft: false\n---\n# Body\n"
    df = spark.createDataFrame([(1, head), (2, "# no head"), (3, "---\n: [broken\n---\nx"), (4, None)], "id int, text string")
    v = df.select("id", T.frontmatter_variant(F.col("text")).alias("v"))
    get = lambda path, kind="string": T.variant_at(F.col("v"), path, kind)
    r = v.select("id", get("$.title").alias("title"), get("$.tags", "array<string>").alias("tags"), get("$.nav.order", "int").alias("n"), get("$.nav.parents[1].name").alias("deep"),
                 get("$.draft", "boolean").alias("draft"), get("$.title", "int").alias("wrong"), get("$.none.at").alias("none")).orderBy("id").collect()
    assert tuple(r[0])[1:] == ("Guide", ["a", "b"], 3, "Deep", False, None, None)
    assert [tuple(x)[1:] for x in r[1:]] == [(None,) * 7] * 3
    back = v.where("id = 1").select(F.to_json("v").alias("j")).first().j
    import json

    assert json.loads(back) == {"title": "Guide", "tags": ["a", "b"], "nav": {"order": 3, "parents": [{"name": "Start", "id": 1}, {"name": "Deep"}]}, "draft": False}


def test_budgets_hold_by_the_vocabularys_own_count(spark):
    import os

    from ravelin.functions import vocabulary as V

    path = "/opt/tokenizers/byte_bpe_50k.json"
    if not os.path.exists(path):
        pytest.skip("no vocabulary")
    own = V.loaded(path)
    count = lambda t: len(own.encode(t or "", add_special_tokens=False).ids)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    counted = docs.withColumn("n", V.vocabulary_tokens(F.col("text"), path)).collect()
    assert all(r.n == count(r.text) for r in counted)
    assert spark.createDataFrame([(None,), ("",), ("<|endoftext|>",)], "text string").select(V.vocabulary_tokens(F.col("text"), path).alias("n")).collect()[1].n == 0

    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "text")).withColumn("chunk_id", F.concat_ws("#", "doc_id", "chunk_index"))
    hits = docs.select(F.lit(1).alias("query_id"), "doc_id", F.lit(1).alias("chunk_index"), F.col("doc_id").alias("rank"))
    merged = context.auto_merge(hits, lines, 120, tokens=V.vocabulary_tokens(F.col("text"), path)).where("auto_merged").collect()
    assert len(merged) > 20 and all(sum(map(count, r.text.split("\n\n"))) <= 120 for r in merged)

    text = "# Head\n\n" + "\n\n".join("para " * 30 for _ in range(20)) + "\n\n```\n" + "code line\n" * 40 + "```"
    cut = V.fit_to_vocabulary(spark.createDataFrame([(i, text, m) for i, m in enumerate((0, 1, 7, 100, 640, 700, 10_000))], "id int, text string, max_tokens int"), path).orderBy("id").collect()
    assert all(count(r.text) <= r.max_tokens for r in cut) and cut[0].text == "" and cut[-1].text == text and len(cut[3].text) > 300 and cut[3].original_length == len(text)
