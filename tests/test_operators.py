import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.functions import urls as U
from ravelin.operators import boost, context, index, ops, quality, query, search


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("v")).first().v


# ---------------------------------------------------------------- search


def test_dense_forms_agree(spark):
    rows = [(i, [float((i * 7 + j * 3) % 11 - 5) for j in range(8)]) for i in range(60)] + [(100, [0.0] * 8)]
    v = spark.createDataFrame(rows, "id long, vector array<float>")
    q = v.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    key = lambda df: sorted((r.query_id, r["rank"], r.id, r.score) for r in df.collect())
    assert key(search.dense_topk(q, v, 5)) == key(search.dense_topk_expression(q, v, 5))


def test_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)], "id long, vector array<double>")
    out = search.dense_topk(v.withColumnRenamed("id", "query_id"), v, 1)
    assert out.count() == 9 and search.dense_topk(v.where("id < 0").withColumnRenamed("id", "query_id"), v, 1).count() == 0


def test_fusion_bounds_and_single_branches(spark):
    dense = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1)], "query_id long, id long, rank int")
    sparse = spark.createDataFrame([(1, 11, 1), (1, 12, 2), (3, 12, 1)], "query_id long, id long, rank int")
    rows = search.fuse(dense, sparse).collect()
    assert all(0 < r.rrf_score <= 1 / 61 + 1e-9 for r in rows)
    assert [r.id for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == 1] == [11, 10, 12]
    assert {r.query_id for r in rows} == {1, 2, 3}


def test_fallback_takes_only_empty_queries(spark):
    full = spark.createDataFrame([(1, 5), (2, 6)], "query_id long, id long")
    out = search.with_fallback(full.where("query_id = 1"), full).collect()
    assert {(r.query_id, r.fallback) for r in out} == {(1, False), (2, True)}


# ---------------------------------------------------------------- queries and boosts


def test_query_types(spark):
    for text, want in (("Список каналов", "list"), ("почему не работает", "troubleshooting"), ("чем X лучше Y", "comparative"), ("как настроить", "procedural"),
                       ("что такое api", "factual"), ("как пройти", "procedural"), ("где", "exploratory"), ("", "exploratory")):
        assert one(spark, query.query_type(F.col("t")), t=text) == want, text


def test_rewriting_and_parts(spark):
    assert one(spark, query.rewrite(F.col("t")), t="журнал рн и арм") == "жуRelease Notesал Release Notes и АРМ"
    assert one(spark, query.rewrite(F.col("t")), t="рн") == "Release Notes"
    assert one(spark, query.decompose(F.col("t")), t="a и b и  и c и d") == ["a", "b", "c"]
    assert one(spark, query.decompose(F.col("t")), t="a") == []


def test_list_intent_needs_words(spark):
    assert one(spark, query.list_intent(F.col("t")), t="Какие есть каналы?")
    assert not one(spark, query.list_intent(F.col("t")), t="некакие каналы")
    assert not one(spark, query.list_intent(F.col("t")), t="каналы и какие")


def test_routing_with_user_metadata(spark):
    q = spark.createDataFrame([(1, "настройка sdk", None, "iOS"), (2, "", None, None)], "query_id long, text string, user_role string, user_platform string")
    rows = {r.query_id: r for r in query.route(q).collect()}
    assert rows[1].primary_theme == "sdk_ios" and rows[1].top_score == 1.0
    assert rows[2].primary_theme == "sdk_android" and rows[2].ask_back and not rows[2].use_filter


def test_empty_payload_is_the_first_theme(spark):
    d = spark.createDataFrame([(1, None, None, None, None), (2, "sdk_docs", "api", None, None)], "k long, domain string, section string, platform string, role string")
    assert {r.k: r.theme_id for r in query.theme_of(d, "k").collect()} == {1: "sdk_android", 2: None}


def test_boost_multiplies_in_order(spark):
    hits = spark.createDataFrame(
        [(1, 1, 1.0, "faq", "https://h/docs/faq/a/b/c/d", "Обзор", "x" * 900), (1, 2, 1.0, None, None, None, None)],
        "query_id long, id long, s double, page_type string, url string, title string, text string",
    )
    got = {r.id: r.boosted_score for r in boost.boost(hits, F.col("s")).collect()}
    assert got == {1: round(1.05 * 1.1 * 1.15 * 1.1 * 0.95, 9), 2: 1.0}


def test_group_boost_takes_the_first_match(spark):
    hits = spark.createDataFrame([(1, 1, 1.0, ["АРМ агента", "API"], {"api": 1.2, "арм агента": 1.25})], "query_id long, id long, s double, groups array<string>, group_boosts map<string,double>")
    assert boost.boost(hits, F.col("s")).first().boosted_score == 1.25


# ---------------------------------------------------------------- merging and context


def text_of(n):
    return "x" * (4 * n)


def test_merge_grows_left_then_right_within_budget():
    chunks = {i: (f"c{i}", text_of(10)) for i in range(6)}
    assert [w["indices"] for w in context.merge_document([(2, 1)], chunks, 30)] == [[1, 2, 3]]
    assert [w["indices"] for w in context.merge_document([(2, 1)], chunks, 20)] == [[1, 2]]
    assert [w["indices"] for w in context.merge_document([(0, 2), (5, 1)], chunks, 1000)] == [[0, 1, 2, 3, 4, 5]]
    assert [(w["indices"], w["rank"]) for w in context.merge_document([(1, 5), (2, 3), (9, 1)], chunks, 15)] == [([1], 5), ([2], 3), ([9], 1)]


@settings(max_examples=80, deadline=None)
@given(st.sets(st.integers(0, 20), min_size=1), st.sets(st.integers(0, 20)), st.integers(1, 60))
def test_windows_never_overlap_and_keep_the_budget(hits, have, budget):
    chunks = {i: (str(i), text_of(3)) for i in have}
    out = context.merge_document([(i, i) for i in hits], chunks, budget)
    flat = [i for w in out for i in w["indices"]]
    assert len(flat) == len(set(flat)) and hits <= set(flat)
    assert all(len(w["indices"]) == 1 or 3 * len(w["indices"]) <= budget for w in out)


def test_merged_window_stands_at_its_best_hit(spark):
    hits = spark.createDataFrame([(1, "a", 3, 2), (1, "b", 0, 1), (1, "a", 2, 3)], "query_id long, doc_id string, chunk_index int, rank int")
    chunks = spark.createDataFrame([("a", i, f"a{i}", text_of(5)) for i in range(4)] + [("b", 0, "b0", "t")], "doc_id string, chunk_index int, chunk_id string, text string")
    out = context.auto_merge(hits, chunks, 10).orderBy("rank").collect()
    assert [(r.doc_id, r.merged_chunk_indices) for r in out] == [("b", [0]), ("a", [3]), ("a", [1, 2])]


def test_attention_order(spark):
    docs = spark.createDataFrame([(1, i) for i in range(5)] + [(2, 0), (2, 1)], "query_id long, n int")
    out = context.attention_order(docs, F.col("n")).collect()
    assert [r.n for r in sorted((r for r in out if r.query_id == 1), key=lambda r: r.position)] == [0, 2, 4, 3, 1]
    assert [r.n for r in sorted((r for r in out if r.query_id == 2), key=lambda r: r.position)] == [0, 1]


def test_truncation_closes_fences():
    text = "first\n\n```\n" + "\n".join("line" for _ in range(30)) + "\n```\n\nlast"
    cut = context.truncate_paragraphs(text, 60)
    assert len(cut) <= 60 and cut.count("```") == 2 and cut.startswith("first")
    assert context.truncate_paragraphs("short", 60) == "short"


def test_section():
    text = "# A\n## Каналы\n- one\n### sub\nx\n## Other\ny"
    assert context.section(text, r"^##\s+Каналы", 100) == "## Каналы\n- one\n### sub\nx"
    assert context.section(text, r"^##\s+Нет", 100) == ""


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from(["https://ok.io/a", "https://bad.io/b", "[t](https://bad.io/c)", "[t](https://ok.io/a)", "word", "```\nhttps://bad.io/z\n```"]), max_size=8))
def test_whitelist(parts):
    out = context.whitelisted("\n\n".join(parts), {"https://ok.io/a"})
    outside = "".join(p for i, p in enumerate(out.split("```")) if i % 2 == 0)
    assert "bad.io" not in outside
    assert out.count("https://ok.io/a") == sum("ok.io" in p for p in parts)


# ---------------------------------------------------------------- index, quality, operations


def test_upsert_is_idempotent_and_quarantines(spark):
    now = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "id string, version int, text string")
    fresh = spark.createDataFrame([("a", 2, "z"), ("c", 1, "w"), ("d", 1, None)], "id string, version int, text string")
    good = F.col("text").isNotNull()
    merged, bad = index.upsert(now, fresh, good=good)
    again, _ = index.upsert(merged, fresh, good=good)
    rows = sorted((r.id, r.text) for r in merged.collect())
    assert rows == [("a", "z"), ("b", "y"), ("c", "w")] == sorted((r.id, r.text) for r in again.collect())
    assert [r.id for r in bad.collect()] == ["d"]


def test_feedback_latest_valid_wins(spark):
    base = spark.createDataFrame([("i", None), ("j", "negative")], "interaction_id string, feedback string")
    votes = spark.createDataFrame([("i", "negative", 1), ("i", "positive", 2), ("i", "maybe", 3)], "interaction_id string, feedback string, given_at int")
    assert {r.interaction_id: r.feedback for r in quality.apply_feedback(base, votes).collect()} == {"i": "positive", "j": "negative"}


def test_scores_of_empty_inputs(spark):
    rows = spark.createDataFrame([("", "", []), ("и в", "x" * 30, ["ctx"]), ("q", "short", None)], "query string, response string, contexts array<string>")
    out = quality.score(rows).collect()
    assert [r.context_precision for r in out] == [0.0, 0.5, 0.0]
    assert [r.faithfulness for r in out][0] == 0.1
    assert all(0 <= r[s] <= 1 for r in out for s in quality.SCORES)


def test_limiter_counts_accepted_only():
    limiter = ops.SlidingLimiter(((2, 10),))
    assert [limiter.offer(t) for t in (0, 1, 2, 10, 10.5, 11.5)] == [True, True, False, False, True, True]


def test_breaker_cycle():
    b = ops.Breaker(2, 10)
    assert [b.offer(t, ok) for t, ok in ((0, False), (1, False), (5, True), (11, False), (12, True), (21, True), (22, True))] == [True, True, False, True, False, True, True]
    assert b.state == "closed"


def test_rate_limit_equals_replay(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, i % 3, t0 + dt.timedelta(seconds=(i * 37) % 400)) for i in range(120)]
    got = {r.event_id: r.ok for r in ops.rate_limit(spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz")).collect()}
    want = {}
    for user in range(3):
        limiter = ops.SlidingLimiter()
        for i, _, ts in sorted((r for r in rows if r[1] == user), key=lambda r: (r[2], r[0])):
            want[i] = limiter.offer((ts - t0).total_seconds())
    assert got == want


# ---------------------------------------------------------------- text and URLs


def test_unicode_words(spark):
    assert one(spark, T.token_count(F.col("t")), t="Привет, мир_x-1! naïve") == 5  # Привет | , | мир_x-1 | ! | naïve
    assert one(spark, T.strip(F.col("t")), t="  x  ") == "x"


def test_content_refs(spark):
    text = "<ContentRef url=\"/a\"> One </ContentRef> <ContentRef url='https://x/y'>Two</ContentRef>"
    assert one(spark, T.content_refs(F.col("t"), "https://h/"), t=text) == "One (см. https://h/a) Two (см. https://x/y)"


def test_paths(spark):
    assert one(spark, U.path_to_url(F.col("t"), "https://h/", "/docs/"), t="10-start/20-page.v2.md") == "https://h/docs/start/page.v2"
    assert one(spark, U.path_to_url(F.col("t"), "https://h", "", all_levels=False), t="10-start/20-page.md") == "https://h/start/20-page"
    assert not one(spark, U.is_crawlable(F.col("t")), t="https://h/a.PDF")
    assert not one(spark, U.is_crawlable(F.col("t"), F.lit("https://other/")), t="https://h/a")


def test_sanitize_escapes_first(spark):
    assert one(spark, T.sanitize(F.col("t")), t="<b onclick=x> javascript: 'q'") == "&lt;b x&gt; &#x27;q&#x27;"
