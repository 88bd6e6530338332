import duckdb
from pyspark.sql import functions as F

from ravelin.catalog import ORACLES, QUERIES
from ravelin.operators import boost, query
from ravelin.operators.embed import hashed_embedder
from ravelin.plans.ask import ask
from ravelin.sources import dom
from tests.conftest import TESTDATA


def test_main_content_agrees_with_its_sql_on_odd_pages(spark, tmp_path):
    long = "word " * 30
    page = lambda title, body: f'<!DOCTYPE html><html lang="en"><head><title>{title}</title></head><body>{body}</body></html>'
    cut = [page(f"token = {r}", f"<article><h1>token = {r}</h1><p>{long}</article>") for r in ("&quot", "&quo", "&quot;", "&lt", "&#x27", "&#x2", "&#39;", "&amp", "&am", "&amp;&amp", "&copy", "&nbsp;x", "&quotx;", "&nosuch;")]
    whole = page("t", f"<p>a</p><article><p>{long}</p></article>")
    odd = [None, "", "no page", "<p>x", page("", ""), page("t", "a").replace(' lang="en"', ""), whole[:-15], *(whole[:i] for i in range(whole.index("<p>a"), len(whole)))]
    spark.createDataFrame(list(enumerate([*cut, *odd])), "page_id long, html string").selectExpr("page_id", "if(page_id % 2 = 0, 'u', null) AS url", "html").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"SELECT page_id, selector, main, title, lang FROM ({ORACLES['page_main_content']}) ORDER BY page_id").fetchall()
    got = [tuple(r) for r in QUERIES["page_main_content"](spark, str(tmp_path)).orderBy("page_id").collect()]
    assert got == want and got[0][3] == "token = &quot" and len(got) > 200


def test_text_that_no_markup_divides_is_one_piece():
    assert dom.parse("<p>a < b &lt; c</p>d").text("|") == "a < b < c|d"
    assert dom.parse("a<!-- c -->b<?p x>c</i>d").text("|") == "a|b|c|d"
    assert dom.parse("&quot &copy=1 &amp").text() == '" ©=1 &' and dom.parse("&quot &copy;=1 &amp", whole=True).text() == "&quot ©=1 &"
    assert dom.links(dom.parse('<a href="/?a=1&copy=2&amp;b">x</a>', whole=True), "https://h/") == ["https://h/?a=1&copy=2&b"]


def test_boosts_decide_what_ask_keeps_and_the_order_of_equal_scores(spark):
    def chunk(i, text, page_type, section, platform):
        return (i, f"d{i}", 0, f"d{i}#0", text, [float(x) for x in hashed_embedder()([text])[0]], f"T{i}", f"https://h/{i}", page_type, "sdk_docs", section, platform, "integrator")

    schema = "id long, doc_id string, chunk_index int, chunk_id string, text string, dense array<double>, title string, url string, page_type string, domain string, section string, platform string, role string"
    chunks = lambda rows: spark.createDataFrame(rows, schema)
    asked = lambda text: spark.createDataFrame([(1, text)], "query_id long, text string")
    # The first row is the better hit; a page type makes up for it before hits are cut to k.
    rows = [chunk(1, "alpha beta gamma delta", None, None, None), chunk(2, "alpha beta gamma delta epsilon", "overview", None, None)]
    assert [ask(asked("alpha beta gamma delta"), chunks([*rows[:1], (*rows[1][:8], kind, *rows[1][9:])]), 1).first().sources for kind in (None, "overview")] == [["https://h/1"], ["https://h/2"]]
    # Two equal texts: the one of the query's theme comes first.
    rows = [chunk(1, "call ios or android", None, "sdk", "ios"), chunk(2, "call ios or android", None, "sdk", "android")]
    question = asked("call ios or android")
    route = query.route(question).first()
    assert route.primary_theme == "sdk_android" and not route.use_filter
    context = ask(question, chunks(rows)).first().context
    assert context.index("https://h/2") < context.index("https://h/1")


def test_theme_boost_sorts_no_hits_and_ranks_runs_across_batches(spark):
    plan = QUERIES["theme_boost"](spark, TESTDATA)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Join")]
    assert "Sort " not in above and "Window" not in above and "Exchange" not in above
    # Runs of 1 to 400 rows, with ties, over batches of 7 rows and tasks that cut no run.
    rows = spark.range(30).select(F.col("id").alias("query_id"), F.explode(F.sequence(F.lit(0), F.when(F.col("id") == 7, 400).otherwise(F.col("id") % 9)))
                                  .alias("i")).select("query_id", (F.col("i") * 37 % 401).alias("id"), ((F.col("i") * 7 + F.col("query_id")) % 5 / F.lit(5.0)).alias("score"))
    hits = rows.withColumns({"boosted_score": F.col("score"), "theme_id": F.lit("a"), "primary_theme": F.lit("b"), "themes": F.array(F.lit("b"), F.lit("a"))})
    names = ("query_id", "id", "boosted_score", "rank")
    want = sorted(tuple(r) for r in boost.add_theme_boost(hits).select(*names).collect())
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("7", "1", batch):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert sorted(map(tuple, boost.ranked_in_place(boost.theme_boosted(hits)).collect())) == want and len(want) > 500
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert boost.ranked_in_place(boost.theme_boosted(hits.limit(0))).count() == 0
