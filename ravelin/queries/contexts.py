"""Chunking, merging, context assembly and the two end-to-end plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking, context, embed, search
from ..plans.ask import ask
from ..sources import files
from ..written import materialize
from .base import Registry, table
from .retrieval import DENSE_SQL, K, _query_vectors, _vectors

register = Registry()


def _docs(spark, d):
    return table(spark, d, "documents")


def _hits(spark, d):
    return search.dense_topk(_query_vectors(spark, d), _vectors(spark, d), K)


DENSE = DENSE_SQL.format(k=K)


@register()
def chunks(spark, d):
    return chunking.chunk_documents(_docs(spark, d))


@register()
def blocks(spark, d):
    return chunking.document_blocks(_docs(spark, d))


@register()
def html_pages(spark, d):
    return files.parse_pages(table(spark, d, "pages")).select("page_id", "title", "text", F.size("links").alias("n_links"))


@register()
def page_chunks(spark, d):
    pages = files.parse_pages(table(spark, d, "pages")).select("page_id", "text")
    return chunking.chunk_documents(pages, "page_id", "html")


@register()
def coverage(spark, d):
    from ..operators.index import coverage as covered

    docs = _docs(spark, d)
    return covered(docs, chunking.chunk_documents(docs))


@register()
def auto_merge(spark, d):
    """The lines of each document are its chunks; hits are lines of the documents that a search found."""
    docs = _docs(spark, d)
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"))
    lines = lines.withColumn("chunk_id", F.concat_ws("#", "doc_id", "chunk_index"))
    hits = _hits(spark, d).select("query_id", F.col("id").alias("doc_id"), "rank", F.explode(F.array(*[F.lit(i) for i in (0, 1, 4, 9)])).alias("chunk_index"))
    return context.auto_merge(hits, lines).select("query_id", "doc_id", "rank", "merged_chunk_count", "auto_merged", F.length("text").alias("n_chars"))


@register(DENSE + """, r AS (SELECT query_id, id, rank, count(*) OVER (PARTITION BY query_id) AS n, rank - 1 AS i FROM dense)
SELECT query_id, id, CASE WHEN n > 2 THEN CASE WHEN i % 2 = 0 THEN i // 2 ELSE n - 1 - (i - 1) // 2 END ELSE i END::INT AS position FROM r""")
def attention_reorder(spark, d):
    return context.attention_order(_hits(spark, d), F.col("rank")).select("query_id", "id", "position")


@register(DENSE + """, r AS (SELECT query_id, id, rank, floor(1950 / count(*) OVER (PARTITION BY query_id)) AS each FROM dense WHERE rank <= 3 + query_id % 5)
SELECT query_id, id, floor(CASE WHEN rank <= 2 THEN least(each * 1.5e0, 600) ELSE least(each, 400) END)::INT AS max_tokens FROM r""")
def context_budget(spark, d):
    return context.budgets(_hits(spark, d).where(F.col("rank") <= 3 + F.col("query_id") % 5)).select("query_id", "id", "max_tokens")


@register()
def context_texts(spark, d):
    hits = _hits(spark, d).join(_docs(spark, d).select(F.col("doc_id").alias("id"), "text"), "id")
    return context.fit_texts(context.budgets(hits)).select("query_id", "id", "original_length", F.length("text").alias("fitted_length"))


WORDS = r"list_distinct(list_filter(regexp_extract_all(lower(q.text), '[\p{L}\p{N}_]+'), lambda w: length(w) >= 4))"


SOURCES = DENSE + rf""", h AS (SELECT x.query_id, x.rank, 'https://host/' || d.source || '/' || (d.doc_id % 40)::VARCHAR AS url, substring(d.text, 1, 40) AS title,
len(list_filter({WORDS}, lambda w: contains(lower(d.text), w) OR contains(lower(substring(d.text, 1, 40)), w)))::INT AS score
FROM dense x JOIN documents d ON d.doc_id = x.id JOIN documents q ON q.doc_id = x.query_id),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY rank) AS n FROM h),
p AS (SELECT query_id, url, title, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank)::INT AS place FROM f WHERE n = 1)
"""


@register(SOURCES + "SELECT query_id, place, url, title, score FROM p WHERE place <= 5")
def sources_list(spark, d):
    docs = _docs(spark, d)
    hits = _hits(spark, d).join(docs.select(F.col("doc_id").alias("id"), "text", "source"), "id")
    asked = docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query_text"))
    url = F.concat(F.lit("https://host/"), "source", F.lit("/"), F.col("id") % 40, F.lit("?q=1#top"))
    return context.sources(hits.join(asked, "query_id").withColumns({"url": url, "title": F.substring("text", 1, 40)}))


@register(SOURCES + "SELECT query_id, string_agg(place::VARCHAR || '. ' || title || ': ' || url, chr(10) ORDER BY place) AS block FROM p WHERE place <= 5 GROUP BY query_id")
def sources_block(spark, d):
    """The sources of each query as numbered lines."""
    return context.sources_block(sources_list(spark, d))


@register(DENSE + """SELECT query_id, string_agg('### T' || x.id::VARCHAR || chr(10) || 'https://host/' || d.source || chr(10) || d.text, chr(10) || chr(10) ORDER BY x.rank) AS context
FROM dense x JOIN documents d ON d.doc_id = x.id GROUP BY query_id""")
def context_block(spark, d):
    docs = _docs(spark, d).select(F.col("doc_id").alias("id"), "text", F.concat(F.lit("https://host/"), "source").alias("url"))
    rows = _hits(spark, d).join(docs, "id").withColumns({"title": F.concat(F.lit("T"), F.col("id")), "theme_label": F.lit(None).cast("string"), "position": F.col("rank")})
    return context.context_block(rows)


WORDS_SQL = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_\-/]+'))"


@register(DENSE + f""", w AS (SELECT x.query_id, x.id, {WORDS_SQL.format("a.text")} AS q, {WORDS_SQL.format("substring(b.text, 1, 384)")} AS t
  FROM dense x JOIN documents a ON a.doc_id = x.query_id JOIN documents b ON b.doc_id = x.id),
r AS (SELECT query_id, id, round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, t)) / len(q)::DOUBLE ELSE 0 END
  + CASE WHEN len(list_distinct(list_concat(q, t))) > 0 THEN len(list_intersect(q, t)) / len(list_distinct(list_concat(q, t)))::DOUBLE ELSE 0 END, 9)::DOUBLE AS rerank_score FROM w)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, id) AS rank FROM r) WHERE rank <= 5""")
def rerank_hits(spark, d):
    docs = _docs(spark, d)
    hits = _hits(spark, d).drop("rank").join(docs.select(F.col("doc_id").alias("id"), "text"), "id").join(docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query_text")), "query_id")
    return search.rerank(hits, 5).select("query_id", "id", "rerank_score", "rank")


@register()
def hashed_embeddings(spark, d):
    return embed.hashed_vectors(_docs(spark, d), "doc_id", F.col("text"))


@register("""SELECT doc_id, CASE WHEN length(text) < 1000 THEN 256 WHEN length(text) < 4000 THEN 512 ELSE 1024 END AS query_length,
CASE WHEN length(text) < 1000 THEN 512 WHEN length(text) < 4000 THEN 1024 ELSE 2048 END AS document_length FROM documents""")
def model_lengths(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", embed.model_length(t, True).alias("query_length"), embed.model_length(t, False).alias("document_length"))


@register()
def ask_batch(spark, d):
    """The benchmark items as queries over all documents, one chunk each."""
    # Many steps read the chunks: they are embedded once, their columns carried along, and written.
    rows = embed.hashed_vectors(_docs(spark, d), "doc_id", F.col("text"), ("text", "source")).select(
        F.col("doc_id").alias("id"), "doc_id", F.lit(0).alias("chunk_index"), F.concat_ws("#", "doc_id", F.lit(0)).alias("chunk_id"), "text", "dense",
        F.substring("text", 1, 40).alias("title"), F.concat(F.lit("https://host/"), "source", F.lit("/"), "doc_id").alias("url"), "source",
    )
    return ask(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), materialize(rows, "ask-chunks"))
