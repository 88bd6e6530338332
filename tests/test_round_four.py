import pyarrow as pa

from ravelin import batches
from ravelin.catalog import QUERIES
from tests.conftest import TESTDATA


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_theme_boost_exchanges_no_hits(spark, monkeypatch):
    from ravelin.queries import retrieval

    whole = sorted(map(tuple, QUERIES["theme_boost"](spark, TESTDATA).collect()))
    monkeypatch.setattr(retrieval, "HITS_OF_TASK", 2)
    df = QUERIES["theme_boost"](spark, TESTDATA)
    plan = plan_of(df)
    assert "Exchange" not in plan[: plan.index("Join")]
    assert sorted(map(tuple, df.collect())) == whole and whole


def test_pieces_are_bounded_and_whole():
    texts = ["x" * n for n in (10, 3 << 20, 5, 700_000, 700_000, 700_000, 0)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["i", "t"])
    got = list(batches.pieces([batch, batch.slice(0, 0)]))
    assert pa.Table.from_batches(got).to_pydict() == {"i": list(range(7)), "t": texts}
    assert all(p.num_rows == 1 or p.nbytes <= batches.PIECE_BYTES for p in got) and len(got) > 4
    assert max(p.num_rows for p in batches.pieces([batch], 2)) == 2


def test_chunks_blocks_vectors_and_pages_are_made_in_pieces(spark):
    """A batch of many rows comes back as pieces, with equal rows."""
    from ravelin.operators import chunking, embed
    from ravelin.sources import dom
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, f"# h{i}\n\nsome words of {i}") for i in range(40)], "doc_id long, text string").coalesce(1)
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("https://h/").alias("url"), F.concat(F.lit('<a href="/x">'), "text").alias("html"))
    jobs = [chunking.chunk_documents, chunking.document_blocks, lambda d: embed.hashed_vectors(d, "doc_id", F.col("text")), lambda d: dom.page_documents(pages, ("links", "text"))]
    whole = [sorted(map(str, f(docs).collect())) for f in jobs]
    for f, want in zip(jobs, whole, strict=True):
        made = f(docs)
        assert sorted(map(str, made.collect())) == want and "MapInPandas" not in plan_of(made) and len(want) >= 40


def test_pages_are_ranked_in_many_tasks(spark):
    from ravelin.queries import pages

    ids = spark.createDataFrame([(i * 7 % 101 - 50,) for i in range(101)], "page_id long")
    ranked = pages._ranked(ids)
    assert {(r.page_id, r.k) for r in ranked.collect()} == {(i, i + 50) for i in range(-50, 51)}
    window = plan_of(ranked)
    assert "windowspecdefinition(page_id" not in window  # no window over all pages
