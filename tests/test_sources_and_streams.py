import json

from pyspark.sql import functions as F

from ravelin.functions import constants as C
from ravelin.operators import ops
from ravelin.plans.ask import ask
from ravelin.plans.build_index import build
from ravelin.sources import files, sinks
from ravelin.streaming import pipelines
from tests.conftest import TESTDATA


def tree(tmp_path):
    docs = tmp_path / "docs"
    (docs / "10-start").mkdir(parents=True)
    (docs / "10-start" / "_category_.json").write_text(json.dumps({"label": "Start"}))
    (docs / "10-start" / "20-page.md").write_text("---\ntitle: x\n---\n# Page\n\nBody of the first page with enough words.")
    (docs / "index.mdx").write_text("# Home\n\nThe home page has some words as well.")
    (docs / "skip.txt").write_text("no")
    return str(docs)


def test_documentation_tree(spark, tmp_path):
    root = tree(tmp_path)
    rows = {r.rel_path: r.site_url for r in files.documentation(spark, root, "https://h/").collect()}
    assert rows == {"10-start/20-page.md": "https://h/docs/start/page", "index.mdx": "https://h/docs/index"}
    assert [(r.dir, r.label) for r in files.category_labels(spark, root).collect()] == [("10-start", "Start")]
    assert files.documentation(spark, root, "https://h/", max_pages=1).count() == 1


def test_local_folder_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Привет".encode("cp1251"))
    (tmp_path / "b.md").write_text("# Title\nтекст")
    rows = {r.title: r.text for r in files.local_folder(spark, str(tmp_path)).collect()}
    assert rows == {"a": "Привет", "Title": "# Title\nтекст"}


def test_configuration():
    config = {
        "global": {"chunk": {"max": 1, "min": 0}},
        "sources": {"a": {"docusaurus": {"chunk": {"max": 2}}, "ftp": {}}, "b": {"website": {"enabled": False}}},
        "profiles": {"p": {"sources": {"b": {"website": {"enabled": True}}}}},
    }
    assert [(s["name"], s["chunk"]) for s in files.source_configs(config)] == [("a", {"max": 2, "min": 0})]
    assert [s["name"] for s in files.source_configs(config, "p")] == ["a", "b"]


def test_plugins(spark):
    files.register("one")(lambda s, n: s.range(n))
    assert "one" in files.plugins() and files.read(spark, "one", n=3).count() == 3
    files.unregister("one")
    assert "one" not in files.plugins()


def test_sitemap_and_reader(spark):
    xml = "<loc>https://h/a</loc><loc> https://h/b </loc><loc>https://h/a</loc><loc>https://x/c</loc><loc>https://h/no/d</loc>"
    assert {r.url: r.position for r in files.sitemap(spark, xml, "h", ("/no/",)).collect()} == {"https://h/a": 0, "https://h/b": 1}
    text = "Title: Page | Site\nURL Source: https://h/p\nMarkdown Content:\n# Body\nx\n"
    r = files.reader_pages(spark.createDataFrame([("u", text)], "uri string, text string")).first()
    assert (r.title, r.url, r.text) == ("Page", "https://h/p", "# Body\nx")


def test_crawl_in_breadth(spark):
    link = lambda *xs: "".join(f'<a href="{x}">t</a>' for x in xs)
    pages = [(0, "https://h/", link("/a", "/b#x", "https://out/z")), (1, "https://h/a", link("/c", "/")), (2, "https://h/b", ""), (3, "https://h/c", link("/f.pdf"))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert [(r.url, r.depth) for r in files.crawl(df, "https://h/", 10).collect()] == [("https://h/", 0), ("https://h/a", 1), ("https://h/b", 1), ("https://h/c", 2)]
    assert files.crawl(df, "https://h/", 2).count() == 2


def test_build_then_rebuild_then_ask(spark, tmp_path):
    raw = files.documentation(spark, tree(tmp_path), "https://h/").select(
        F.col("site_url").alias("doc_id"), F.lit("docs").alias("source"), "uri", files.decoded(F.col("content")).alias("text"), F.col("mtime").cast("double").alias("mtime")
    )
    state = spark.createDataFrame([], "doc_key string, content_hash string, mtime double")
    points, state = build(raw, state, F.lit("2024-02-01"))
    rows = points.collect()
    assert len(rows) == 2 and len({r.id for r in rows}) == 2 and all(len(r.dense) == 64 for r in rows)
    state = spark.createDataFrame(state.collect(), state.schema)
    assert build(raw, state, F.lit("2024-02-02"))[0].count() == 0
    changed = raw.withColumn("text", F.when(F.col("uri").endswith(".mdx"), F.concat("text", F.lit(" more words"))).otherwise(F.col("text")))
    assert build(changed, state, F.lit("2024-02-02"))[0].select("doc_id").distinct().count() == 1

    chunks = points.select(F.xxhash64("id").alias("id"), "doc_id", "chunk_index", "chunk_id", "text", "dense", F.lit("Page").alias("title"), F.col("doc_id").alias("url"))
    chunks = spark.createDataFrame(chunks.collect(), chunks.schema)
    queries = spark.createDataFrame([(1, "first page words"), (2, "home page")], "query_id long, text string")
    out = {r.query_id: r for r in ask(queries, chunks, 5).collect()}
    assert out[1].status == "success" and "first page" in out[1].answer and out[1].sources


def test_query_log_and_index_sinks(spark, tmp_path):
    events = spark.read.parquet(f"{TESTDATA}/events.parquet")
    sinks.write_query_log(events.select("event_id", "ts"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == events.count()
    points = spark.createDataFrame([("a", "x", "en"), ("b", "y", "de")], "id string, text string, lang string")
    sinks.write_index(points, str(tmp_path / "index"), "lang")
    fresh = spark.createDataFrame([("a", "z", "en"), ("c", "", "en")], "id string, text string, lang string")
    bad = sinks.upsert_index(spark.read.parquet(str(tmp_path / "index")), fresh, str(tmp_path / "index2"))
    assert [r.id for r in bad.collect()] == ["c"]
    assert {r.id: r.text for r in spark.read.parquet(str(tmp_path / "index2")).collect()} == {"a": "z", "b": "y"}
    sinks.clear(points, str(tmp_path / "empty"))
    assert spark.read.parquet(str(tmp_path / "empty")).count() == 0


def stream_of(spark, tmp_path, n=3):
    """The events in n files in the order of time, and the stream over them."""
    events = spark.read.parquet(f"{TESTDATA}/events.parquet")
    folder = tmp_path / "events"
    rows = events.orderBy("ts").limit(400).toPandas()
    folder.mkdir()
    for i in range(n):
        part = rows.iloc[i * len(rows) // n : (i + 1) * len(rows) // n]
        part.to_parquet(folder / f"{i}.parquet", coerce_timestamps="us")
    return spark.createDataFrame(rows, events.schema), pipelines.event_stream(spark, str(folder), events.schema)


def run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return stream.sparkSession.table(name)


def test_streaming_limiter_equals_batch(spark, tmp_path):
    batch, stream = stream_of(spark, tmp_path)
    want = {r.event_id: r.ok for r in ops.rate_limit(batch).collect()}
    assert {r.event_id: r.ok for r in run(pipelines.limited(stream), "limited", "append").collect()} == want


def test_streaming_breaker_equals_batch(spark, tmp_path):
    batch, stream = stream_of(spark, tmp_path)
    prepare = lambda df: df.select("event_id", F.concat(F.lit("s"), F.col("user_id") % 2).alias("service"), "ts", (F.col("event_type") != "error").alias("ok"))
    want = {r.event_id: (r.passed, r.state) for r in ops.circuit(prepare(batch), *C.BREAKERS["llm"]).collect()}
    got = run(pipelines.broken(prepare(stream), *C.BREAKERS["llm"]), "broken", "append").collect()
    assert {r.event_id: (r.passed, r.state) for r in got} == want


def test_streaming_windows_equal_batch(spark, tmp_path):
    batch, stream = stream_of(spark, tmp_path)
    got = {(r.start, r.event_type): r.n for r in run(pipelines.windowed_metrics(stream, "1 hour", "10 minutes", "event_type"), "windows", "complete").collect()}
    want = ops.metric_windows(batch.withColumn("ts", F.col("ts").cast("timestamp")), "1 hour", "event_type")
    assert got == {(r.start, r.event_type): r.n for r in want.collect()}


def test_incremental_ingestion(spark, tmp_path):
    _, stream = stream_of(spark, tmp_path)
    seen = []
    upsert = lambda df, epoch: seen.extend(r.event_id for r in df.select("event_id").collect())
    pipelines.ingest(stream, str(tmp_path / "cp"), upsert)
    pipelines.ingest(stream, str(tmp_path / "cp"), upsert)
    assert len(seen) == len(set(seen)) == 400
