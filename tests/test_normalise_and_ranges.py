"""Normalising steps, range functions over samples, reranking by a model, hits in one form."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.operators import ops, search
from ravelin.plans import normalise
from ravelin.plans.steps import Pipeline
from ravelin.sources import files


def test_bytes_that_are_no_text_go(spark):
    cases = [("ä€x".encode(), "ä€x"), (b"a\xff\xfeb\xc3", "ab"), (b"", ""), (None, None), ("kept �".encode(), "kept �")]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "id int, content binary")
    assert [r.t for r in df.orderBy("id").select(T.repaired_utf8(F.col("content")).alias("t")).collect()] == [t for _, t in cases]


def test_documentation_steps(spark):
    rows = [
        (b"---\ntitle: \"T\"\ncategory: c\n---\n# H\r\nbody\xff", "a/01-x.md", "https://h/docs/x"),
        (b"# From heading\n\n\n\ntext", "a/y.mdx", ""),
        (b"plain", "a/02-my_page.md", None),
        (None, "z.md", None),
    ]
    raw = spark.createDataFrame(rows, "content binary, rel_path string, site_url string")
    flow = Pipeline(*normalise.documentation_steps("https://h", "/docs"))
    out = {r.rel_path: r for r in flow.run(raw).collect()}
    assert flow.rows() == {"repaired": 4, "page": 4, "urls": 4}
    first, second, third, last = (out[r[1]] for r in rows)
    assert (first.head.title, first.head.category, first.head.content_type, first.doc_id) == ("T", "c", "docusaurus_markdown", "https://h/docs/x")
    assert "title:" not in first.text and "body" in first.text and "�" not in first.text
    assert (second.head.title, second.head.content_type, second.canonical_url) == ("From heading", "docusaurus_mdx", "https://h/docs")
    assert third.head.title == "my page" and third.text == "plain" and last.text == "" and last.head.title == "z"
    assert all(r.normalized and r.normalizer == "docusaurus" and r.url_mapped for r in out.values())


def test_website_steps(spark):
    raw = spark.createDataFrame([("<html><title> A </title><body><p>x &amp; y</p></body></html>",), (None,)], "text string")
    out = Pipeline(*normalise.website_steps("https://h")).run(raw).collect()
    assert out[0].head.title == "A" and "x" in out[0].text and "<" not in out[0].text and out[0].normalizer == "html"
    assert out[1].text == "" and out[1].head.title is None and out[1].doc_id == "https://h"
    again = raw.transform(normalise.flagged("first")).transform(normalise.flagged("second"))
    assert {r.normalizer for r in again.collect()} == {"first"}


def test_documentation_takes_a_mapper(spark, tmp_path):
    for name in ("a/1.md", "a/2.mdx", "b.md"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("# x")
    mapped = lambda rel: {"section": F.nullif(F.regexp_extract(rel, "^(.*)/", 1), F.lit("")), "source": F.when(rel == "b.md", "own")}
    got = {r.rel_path: r for r in files.documentation(spark, str(tmp_path), "https://h", mapper=mapped).collect()}
    assert [(got[n].section, got[n].source, got[n].file_extension) for n in ("a/1.md", "a/2.mdx", "b.md")] == [("a", "docusaurus", ".md"), ("a", "docusaurus", ".mdx"), (None, "own", ".md")]
    assert sorted(r.rel_path for r in files.documentation(spark, str(tmp_path), "https://h", max_pages=2).collect()) == ["a/1.md", "a/2.mdx"]


def over_ranges(rows, width, step):
    start, out = datetime(1970, 1, 1), {}
    for label in {r[1] for r in rows}:
        own = sorted(((t - start).total_seconds(), i, v) for i, l, t, v in rows if l == label and t is not None and v is not None)
        ends = {int(t // step + j) * step for t, _, _ in own for j in range(1, width // step + 1)}
        for end in ends:
            values = [v for t, _, v in own if end - width <= t < end]
            grown = sum(b - a if b >= a else b for a, b in zip(values, values[1:], strict=False))
            out[label, end] = (len(values), sum(values), min(values), max(values), values[-1], grown)
    return out


@pytest.mark.parametrize(("width", "step"), [(60, 60), (300, 60), (3600, 300)])
def test_range_functions_equal_each_window_by_hand(spark, width, step):
    rng, start = random.Random(width), datetime(2024, 1, 1)
    rows = [(i, rng.choice(["a", "b", None]), start + timedelta(seconds=rng.choice([rng.randrange(7200), 60 * rng.randrange(120)])), float(rng.randrange(50))) for i in range(400)]
    rows += [(400, "a", None, 1.0), (401, "a", start, None), (402, "lone", start, 5.0)]
    samples = spark.createDataFrame(rows, "id int, label string, ts timestamp_ntz, v double").repartition(4)
    got = ops.range_over_time(samples, "v", width, step, "label", order=("id",)).collect()
    want = over_ranges(rows, width, step)
    assert len(got) == len(want)
    for r in got:
        assert (r.n, r.total, r.least, r.most, r["last"], r.increase) == want[r.label, (r["at"] - datetime(1970, 1, 1)).total_seconds()]
        assert r.mean == pytest.approx(r.total / r.n) and r.rate == pytest.approx(r.increase / width)


def test_ranges_of_nothing_and_of_uneven_steps(spark):
    none = spark.createDataFrame([], "ts timestamp_ntz, v double")
    assert ops.range_over_time(none, "v", 60, 60).count() == 0
    with pytest.raises(ValueError):
        ops.range_over_time(none, "v", 100, 60)


def test_a_model_reranks_and_its_failures_keep_their_rows(spark):
    def load():
        def model(queries, texts):
            if "bad" in texts:
                raise RuntimeError("no")
            return [len(t) for t in texts]

        return model

    rows = [(1, i, "word", t, i) for i, t in enumerate(["a", "a word", None, "longer " * 100])] + [(2, 9, "word", "bad", 0), (2, 8, "bad", "bad", 1)]
    hits = spark.createDataFrame(rows, "query_id long, id long, query_text string, text string, rank int")
    got = search.rerank_by_model(hits, load, 3, batch=1).collect()
    one = sorted((r for r in got if r.query_id == 1), key=lambda r: r["rank"])
    assert [(r.id, r.rerank_score, r.reranked) for r in one] == [(3, 384.0, True), (1, 6.0, True), (0, 1.0, True)]
    two = sorted((r for r in got if r.query_id == 2), key=lambda r: r["rank"])
    assert [(r.id, r.rerank_score, r.reranked) for r in two] == [(8, 2.0, False), (9, 0.0, False)] and two[0].text == "bad"


def test_hits_in_one_form(spark):
    hits = spark.createDataFrame([(1, 5, None, "t", None), (1, 6, 0.5, None, None)], "query_id long, id long, score float, title string, `odd.name` int")
    got = {r.id: (r.score, r.payload) for r in search.hit_records(hits).collect()}
    assert got == {"5": (0.0, {"title": "t"}), "6": (0.5, {})}
    assert search.hit_records(hits.select("query_id", "id", "score")).first().payload == {}
