"""Answering a batch of queries.

Processed queries, routes, hits and the documents that go into the context are read by several
later steps. They are a few rows for each query and are written once, or every step would repeat
the search, and its plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import boost, context, query, search
from ..operators.embed import hashed_vectors
from ..written import discard, materialize

#: Rows of hits that are broadcast to the chunks, so that texts stay where they are; more are joined by a shuffle of both.
BROADCAST_HITS = 200_000


def _few(hits: DataFrame) -> DataFrame:
    return F.broadcast(hits) if hits.count() <= BROADCAST_HITS else hits


def candidates(processed: DataFrame, routes: DataFrame, chunks: DataFrame, k: int | None) -> DataFrame:
    """query_id, id, rrf_score: hybrid search, both branches at twice the k of each query's strategy, under the filter of
    its theme where routing is sure of one, without it where that leaves nothing. All fused hits: they are cut to k when
    they are boosted."""
    columns = set(chunks.columns)
    need = query.filter_bit(F.col("use_filter"), F.col("primary_theme"))
    most = F.lit(k) if k else F.col("k")
    asked = processed.select("query_id", "text", most.alias("most")).join(routes.select("query_id", need.alias("need")), "query_id")
    vectors = hashed_vectors(asked, "query_id", F.col("text"), ("need",)).select("query_id", "need", F.col("dense").alias("vector"))
    dense = chunks.select("id", F.col("dense").alias("vector"), query.theme_bits(columns).alias("bits"))
    texts = chunks.select("id", "text", query.theme_bits(columns).alias("bits"))
    limits = asked.select("query_id", "most")
    widest = k or max(s[1] for s in C.STRATEGIES)

    def hits(q: DataFrame, v: DataFrame) -> DataFrame:
        near = search.dense_topk(v, dense, 2 * widest).join(limits, "query_id").where(F.col("rank") <= 2 * F.col("most"))
        alike = search.sparse_topk(q, texts, 2 * widest).join(limits, "query_id").where(F.col("rank") <= 2 * F.col("most"))
        return search.fuse(near, alike).select("query_id", "id", "rrf_score")

    sure = F.col("need") > 0
    filtered = materialize(hits(asked.where(sure), vectors.where(sure)), "ask-filtered")
    # Only queries that the filter leaves empty, or that have none, are searched without it.
    left = lambda df: df.drop("need").join(filtered.select("query_id").distinct(), "query_id", "left_anti")
    return search.with_fallback(filtered, hits(left(asked), left(vectors)))


def shown(merged: DataFrame, asked: DataFrame) -> DataFrame:
    """merged(query_id, doc_id, text, rank, ...), asked(query_id, query_text, ...) -> the documents that go into
    the context, with text within its budget and position: as many as the query's complexity calls
    for, the best at both ends; for a question after a list only what the first says of it."""
    docs = merged.join(asked, "query_id")
    listing = query.list_intent(F.col("query_text"))
    some = docs.where(~listing & (F.col("rank") <= query.document_count(F.col("query_text"))))
    fitted = context.attention_order(context.fit_texts(context.budgets(some)), F.col("rank"))
    lists = context.list_answers(docs.where(listing)).withColumn("position", F.lit(0))
    names = [*docs.columns, "position"]
    return fitted.select(*names).unionByName(lists.select(*names))


def ask(queries: DataFrame, chunks: DataFrame, k: int | None = None) -> DataFrame:
    """queries(query_id, text), chunks(id, doc_id, chunk_index, chunk_id, text, dense, title, url, ...)
    -> query_id, status, answer, sources, context, theme_instruction. A query without hits stays, with
    status no_results. k overrides the number of candidates of the strategies.

    In order: process, route, search with the theme's filter and without where it leaves nothing,
    boost and cut to k, theme boost, rerank (equal scores in the order of the boosts), merge neighbours
    (if the strategy says so), fit the context, answer, and take out addresses that are no source."""
    processed = materialize(query.process(queries), "ask-queries")
    routes = materialize(query.route(processed.select("query_id", "text")), "ask-routes")
    payload = chunks.drop("dense")
    for c in ("domain", "section", "platform", "role"):
        if c not in payload.columns:
            payload = payload.withColumn(c, F.lit(None).cast("string"))
    payload = payload.withColumn("theme_id", query.theme_id(set(payload.columns)))
    fused = materialize(candidates(processed, routes, chunks, k), "ask-fused")
    found = _few(fused).join(payload, "id")
    found = found.join(processed.select("query_id", "page_boosts", "group_boosts", "rerank_top_n", "auto_merge", (F.lit(k) if k else F.col("k")).alias("most"), F.col("text").alias("query_text")), "query_id")
    found = found.join(routes.select("query_id", "primary_theme", "themes", "preferred_domain", "preferred_section", "preferred_platform", F.col("top_score").alias("theme_score")), "query_id")
    hits = boost.boost(found.withColumn("score", F.col("rrf_score")), F.col("score")).where(F.col("rank") <= F.col("most")).drop("rank")
    hits = boost.add_theme_boost(hits).withColumnRenamed("rank", "boosted_rank")
    best = search.rerank(hits, max(s[2] for s in C.STRATEGIES), ties=F.col("boosted_rank")).where(F.col("rank") <= F.col("rerank_top_n"))
    best = materialize(best.select("query_id", "doc_id", "chunk_index", "rank", "text", "auto_merge"), "ask-hits")

    near = payload.join(_few(best.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", "chunk_index", "chunk_id", "text", "title", "url", "theme_id")
    near = materialize(near, "ask-near")
    merged = context.auto_merge(best.where("auto_merge").select("query_id", "doc_id", "chunk_index", "rank", "text"), near.select("doc_id", "chunk_index", "chunk_id", "text"))
    single = best.where("NOT auto_merge").select("query_id", "doc_id", "text", "rank")
    merged = merged.select("query_id", "doc_id", "text", "rank").unionByName(single)
    about = near.groupBy("doc_id").agg(F.min_by(F.struct("title", "url", "theme_id"), "chunk_index").alias("p"))
    merged = merged.join(about, "doc_id").select("query_id", "doc_id", "text", "rank", "p.title", "p.url", query.theme_label(F.col("p.theme_id")).alias("theme_label"))

    merged = materialize(merged, "ask-merged")
    docs = materialize(shown(merged, processed.select("query_id", F.col("text").alias("query_text"))), "ask-documents")
    discard(merged, best, near, fused)
    links = context.sources(docs).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "url"))), lambda x: x["url"]).alias("sources"))
    first, second = (query.theme_label(F.try_element_at("themes", F.lit(i))) for i in (1, 2))
    told = routes.select("query_id", context.theme_instruction(first, second).alias("theme_instruction"))
    answers = context.whitelist(context.extractive_answer(docs).join(links.withColumnRenamed("sources", "allowed"), "query_id", "left")).drop("allowed")
    out = queries.select("query_id").join(answers, "query_id", "left").join(links, "query_id", "left").join(context.context_block(docs), "query_id", "left").join(told, "query_id", "left")
    failed = F.col("context").isNull()
    return out.withColumns({"status": F.when(failed, "no_results").otherwise("success"), "answer": F.when(failed, F.lit(None)).otherwise(F.col("answer"))})
