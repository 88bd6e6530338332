import datetime as dt

from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.operators import boost, chunking, index, ops, query, search
from ravelin.operators.embed import hashed_embedder
from ravelin.plans.ask import ask
from ravelin.plans.steps import Pipeline, isolated


def test_frontmatter_both_ways(spark):
    text = "---\ntitle: \"A: b\"\nid: 7\ntags:\n  - x\n---\nbody\n"
    row = spark.createDataFrame([(text,), ("no head",), ("---\n: [\n---\nx",)], "t string").select(
        T.frontmatter(F.col("t")).alias("m"), T.frontmatter_json(F.col("t")).alias("j"), T.strip_frontmatter(F.col("t")).alias("b")
    ).collect()
    assert row[0].m == {"title": "A: b", "id": "7"} and row[0].j == '{"id": 7, "tags": ["x"], "title": "A: b"}' and row[0].b == "body\n"
    assert (row[1].m, row[1].j, row[1].b) == ({}, None, "no head") and row[2].j is None


def test_requests_take_the_first_error(spark):
    rows = [("u", "web", None, "hi"), ("b", "mail", "<", ""), ("u", "mail", "<", ""), ("u", "api", "x" * 101, "hi"), ("u", "api", "a'b", "hi"), ("u", "api", "1", " "), ("u", "web", "", "<i>"), ("u", None, None, None)]
    df = spark.createDataFrame(rows, "user_id string, channel string, chat_id string, message string").withColumn("n", F.monotonically_increasing_id())
    out = [(r.error, r.cleaned) for r in query.validate(df, spark.createDataFrame([("b",)], "user_id string")).orderBy("n").collect()]
    assert out == [("", False), ("blocked", False), ("channel", False), ("chat_id", False), ("chat_id", False), ("empty", False), ("", True), ("channel", False)]
    safe = spark.createDataFrame([(None,), ("",), ("plain",), ("<SCRIPT>x</script>",), ("a onload = b",)], "t string").select(T.is_safe(F.col("t")).alias("s"))
    assert [r.s for r in safe.collect()] == [True, True, True, False, False]


def test_cache_replay_does_not_renew(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, "k", t0 + dt.timedelta(seconds=s)) for i, s in enumerate((0, 5, 9, 10, 12, 30))] + [(9, "z", t0)]
    out = {r.event_id: r.hit for r in ops.cache_replay(spark.createDataFrame(rows, "event_id long, key string, ts timestamp_ntz"), 10).collect()}
    assert out == {0: False, 1: True, 2: True, 3: False, 4: True, 5: False, 9: False}


def test_pipeline_counts_and_isolates(spark):
    p = Pipeline(("mark", isolated(F.col("id") % 2 == 0, "even"))).add("keep", lambda df: df.where("_error IS NULL"))
    p.add("first", lambda df: df.where("id < 8"), position=0)
    assert p.run(spark.range(10)).count() == 4
    assert p.rows() == {"first": 8, "mark": 8, "keep": 4}


def test_characters_and_scroll(spark):
    text = "# A\n" + "a" * 30 + "\n# B\n" + "b" * 30 + "\n"
    parts = chunking.by_characters(text, 25, 5)
    assert parts[0].startswith("# A") and any("# B" in p for p in parts) and all(len(p) <= 25 + 31 + 5 for p in parts)
    chunks = spark.createDataFrame([("d", 2, "x"), ("d", 1, "y"), ("e", 0, "z")], "doc_id string, chunk_index int, text string")
    assert [r.text for r in index.scroll(chunks, "d").collect()] == ["y", "x"]


def test_payload_fallbacks_change_the_score(spark):
    schema = "query_id long, id long, platform string, sdk_platform string, url string, canonical_url string, score double"
    rows = [(1, 1, None, "android", "", "https://h/faq/x", 1.0), (1, 2, "android", "ios", "https://h/faq/x", None, 1.0), (1, 3, None, None, None, None, 1.0)]
    got = {r.id: r.boosted_score for r in boost.boost(spark.createDataFrame(rows, schema), F.col("score")).collect()}
    assert got[1] == got[2] != got[3]
    themed = query.theme_of(spark.createDataFrame([(1, "sdk_docs", "sdk", "", "IOS", "")], "id long, domain string, section string, platform string, sdk_platform string, role string"), "id")
    assert themed.select(query.theme_label(F.col("theme_id")).alias("t")).first().t == "SDK для iOS"


def test_a_models_answer_takes_the_place_of_the_words(spark):
    routes = query.route(spark.createDataFrame([(1, "android"), (2, "ios")], "query_id long, text string"))
    answers = spark.createDataFrame([(1, '```json\n[{"theme_id": "api", "score": 0.1}, {"theme_id": "sdk_web", "score": 0.95}, {"theme_id": "sdk_ios", "score": 0.5}]\n```'), (2, "no json")], "query_id long, answer string")
    got = {r.query_id: r for r in query.routing_with_model(routes, answers).collect()}
    assert (got[1].router, got[1].primary_theme, got[1].top_score, got[1].second_score, got[1].use_filter) == ("llm", "sdk_web", 0.95, 0.5, True)
    assert got[2].router == "heuristic" and got[2].primary_theme == "sdk_ios"


def test_cells_find_most_of_the_nearest(spark):
    d = "/root/testdata/sf0.01"
    vectors = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries = vectors.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    centres = search.cell_centres(vectors, 16)
    exact = {(r.query_id, r.id) for r in search.dense_topk(queries, vectors, 10).collect()}
    near = {(r.query_id, r.id) for r in search.cell_topk(queries, search.cell_index(vectors, centres), centres, 10, 12).collect()}
    assert len(exact & near) >= 0.9 * len(exact), len(exact & near) / len(exact)
    everywhere = {(r.query_id, r.id) for r in search.cell_topk(queries, search.cell_index(vectors, centres), centres, 10, 16).collect()}
    assert everywhere == exact, (len(everywhere - exact), sorted(everywhere ^ exact)[:6])


def test_full_cache_drives_out_the_oldest():
    cache = ops.TtlCache(5, 100.0, 0.4)
    assert [cache.lookup(k, t) for k, t in (("a", 0), ("b", 1), ("c", 2), ("d", 3), ("e", 4), ("a", 5))] == [False] * 5 + [True]
    assert not cache.lookup("f", 6) and sorted(cache.stored) == ["c", "d", "e", "f"]  # 40 % of five went
    assert not cache.lookup("c", 102.5) and cache.stored["c"] == 102.5


def test_quantiles_of_histograms(spark):
    rows = [("x", "1", 0), ("x", "5", 80), ("x", "10", 100), ("x", "+Inf", 100), ("y", "1", 5), ("y", "+Inf", 10), ("z", "1", 0), ("z", "+Inf", 0)]
    got = {r.k: r.quantile for r in ops.histogram_quantile(spark.createDataFrame(rows, "k string, le string, n long"), 0.9, "k").collect()}
    assert got == {"x": 7.5, "y": 1.0, "z": None}


def test_ask_filters_by_theme_and_falls_back(spark):
    def chunk(i, text, section, platform):
        return (i, f"d{i}", 0, f"d{i}#0", text, [float(x) for x in hashed_embedder()([text])[0]], f"T{i}", f"https://h/{i}", "sdk_docs", section, platform, "integrator")

    schema = "id long, doc_id string, chunk_index int, chunk_id string, text string, dense array<double>, title string, url string, domain string, section string, platform string, role string"
    rows = [chunk(1, "sdk android setup guide. See https://evil.example/x now.", "sdk", "android"), chunk(2, "sdk android setup guide for ios.", "sdk", "ios")]
    queries = spark.createDataFrame([(1, "sdk android setup"), (2, "sdk ios setup"), (3, "Какие есть каналы?")], "query_id long, text string")
    sure = {r.query_id for r in query.route(queries).where("use_filter").collect()}
    assert sure == {1, 2}
    out = {r.query_id: r for r in ask(queries, spark.createDataFrame(rows, schema)).collect()}
    assert out[1].sources == ["https://h/1"] and out[2].sources == ["https://h/2"] and "evil" not in out[1].answer
    assert "Тема: SDK для Android" in out[1].context and out[1].theme_instruction.startswith("Если ответ")
    assert out[3].status == "success" and "https://h/" in out[3].context
    alone = {r.query_id: r.sources for r in ask(queries, spark.createDataFrame(rows[:1], schema)).collect()}
    assert alone[2] == ["https://h/1"]  # the filter leaves nothing, so it is dropped
