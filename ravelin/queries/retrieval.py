"""Search, fusion, boosting, query understanding, themes, merging, context."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import merge_tokens
from ..operators import boost, codes, context, query, search
from ..written import materialize
from .base import Registry, case, cell, has_any, q, replaced, rows, strip, table

register = Registry()
K = 10
#: Searches take every row whose id is divisible by this as a query, against all rows.
EVERY = 20
#: Hits that theme_boost ranks in a task. The documents of a place are exchanged once for each such share of its hits.
HITS_OF_TASK = 16_000_000


def _points(spark, d):
    """Documents that have a vector: the collection of points."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return table(spark, d, "embeddings").join(docs, F.col("vec_id") == F.col("doc_id"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _query_vectors(spark, d):
    return _vectors(spark, d).where(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), "vector", "label")


def _texts(spark, d):
    return _points(spark, d).select(F.col("vec_id").alias("id"), "text")


def _query_texts(spark, d):
    return _texts(spark, d).where(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), "text")


DENSE_SQL = """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, a.label AS query_label, b.label AS label,
             round(CASE WHEN a.n > 0 AND b.n > 0 THEN list_dot_product(a.e, b.e) / (a.n * b.n) ELSE 0 END, 6)::DOUBLE AS score
      FROM n a, n b WHERE a.vec_id % 20 = 0),
dense AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= {k})
"""
SPARSE_SQL = r"""
t AS (SELECT d.doc_id AS id, d.text, unnest(regexp_extract_all(lower(d.text), '[\p{{L}}\p{{N}}_\-/]+')) AS token
      FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id),
p AS (SELECT id, token, count(*)::DOUBLE AS w FROM t GROUP BY ALL),
ss AS (SELECT a.id AS query_id, b.id AS id, sum(a.w * b.w)::DOUBLE AS score FROM p a JOIN p b USING (token) WHERE a.id % 20 = 0 GROUP BY ALL),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ss) WHERE rank <= {k})
"""
FUSED_SQL = """
f AS (SELECT query_id, id, d.rank AS dense_rank, s.rank AS sparse_rank,
             round(coalesce(0.5e0 / (60 + d.rank), 0) + coalesce(0.5e0 / (60 + s.rank), 0), 9)::DOUBLE AS rrf_score
      FROM dense d FULL JOIN sparse s USING (query_id, id)),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, id) AS rank FROM f) WHERE rank <= {k})
"""
HYBRID = DENSE_SQL.format(k=2 * K) + "," + SPARSE_SQL.format(k=2 * K) + "," + FUSED_SQL.format(k=K)


@register(DENSE_SQL.format(k=K) + "SELECT query_id, id, score, rank FROM dense")
def dense_topk(spark, d):
    return search.dense_topk(_query_vectors(spark, d), _vectors(spark, d), K)


@register("WITH" + SPARSE_SQL.format(k=K) + "SELECT query_id, id, score, rank FROM sparse")
def sparse_topk(spark, d):
    return search.sparse_topk(_query_texts(spark, d), _texts(spark, d), K)


def _hybrid(spark, d):
    return search.hybrid_search(_query_vectors(spark, d), _query_texts(spark, d), _vectors(spark, d), _texts(spark, d), K)


@register(HYBRID + "SELECT query_id, id, rrf_score, rank FROM fused")
def hybrid_rrf(spark, d):
    return _hybrid(spark, d).select("query_id", "id", "rrf_score", "rank")


def _boost_sql(base: str) -> str:
    """The product in the order of the expression; url, title and section are derived below."""
    def mapped(column, values):
        return case([(f"lower({column}) = {q(k)}", cell(v)) for k, v in values.items()], "1.0e0")

    parts = [mapped("page_type", C.PAGE_TYPE_BOOST), mapped("section", C.SECTION_BOOST), mapped("platform", C.PLATFORM_BOOST)]
    parts += [case([(has_any("lower(url)", p), cell(b))], "1.0e0") for b, p in C.URL_BOOSTS]
    parts += [case([(has_any("lower(title)", p), cell(b))], "1.0e0") for b, p in C.TITLE_BOOSTS]
    low, high, best, long = C.LENGTH_BOOST
    parts.append(case([(f"content_length BETWEEN {low} AND {high}", cell(best)), (f"content_length > {high}", cell(long))], "1.0e0"))
    parts += [case([(has_any("lower(text)", p), cell(b))], "1.0e0") for b, p in C.STRUCTURE_BOOSTS]
    parts.append(mapped("source", C.SOURCE_BOOST))
    parts.append(case([(f"len(list_filter(string_split(url, '/'), lambda s: s <> '')) > {C.DEPTH_LIMIT}", cell(C.DEPTH_FACTOR))], "1.0e0"))
    return f"round({base} * " + " * ".join(parts) + ", 9)::DOUBLE"


SECTIONS = ("sdk", "agent", "supervisor", "admin", "api", "faq")
PLATFORMS = ("android", "ios", "web", "main")
PAGE_TYPES = tuple(C.PAGE_TYPE_BOOST)


def _pick(column: str, values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(column) % len(values)).cast("int") + 1)


def _pick_sql(column: str, values) -> str:
    return f"[{', '.join(q(v) for v in values)}][({column} % {len(values)})::INT + 1]"


def _payload(points):
    """Stand-in metadata of the points, derived from their own columns."""
    doc_section, platform = _pick("label", SECTIONS), _pick("label", PLATFORMS)
    return points.select(
        F.col("vec_id").alias("id"),
        "text",
        "source",
        F.col("n_chars").alias("content_length"),
        "label",
        _pick("vec_id", PAGE_TYPES).alias("page_type"),
        doc_section.alias("section"),
        F.when(F.col("label") % 2 == 0, platform).alias("platform"),
        F.substring("text", 1, 40).alias("title"),
        F.concat(F.lit("https://host/docs/"), doc_section, F.lit("/"), "source", F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
    )


PAYLOAD_SQL = f"""payload AS (SELECT vec_id AS id, text, source, n_chars AS content_length, label,
  {_pick_sql("vec_id", PAGE_TYPES)} AS page_type, {_pick_sql("label", SECTIONS)} AS section,
  CASE WHEN label % 2 = 0 THEN {_pick_sql("label", PLATFORMS)} END AS platform, substring(text, 1, 40) AS title,
  'https://host/docs/' || {_pick_sql("label", SECTIONS)} || '/' || source || '/' || lang || '/' || doc_id::VARCHAR AS url
  FROM embeddings JOIN documents ON vec_id = doc_id)"""


@register(HYBRID + "," + PAYLOAD_SQL + f""", b AS (SELECT query_id, id, {_boost_sql("rrf_score")} AS boosted_score FROM fused JOIN payload USING (id))
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY boosted_score DESC, id) AS rank FROM b""")
def boosted_hits(spark, d):
    # Payload joins after the cut to k, so it moves for hits only.
    hits = _hybrid(spark, d).select("query_id", "id", "rrf_score").join(_payload(_points(spark, d)), "id")
    return boost.boost(hits, F.col("rrf_score")).select("query_id", "id", "boosted_score", "rank")


@register(DENSE_SQL.format(k=K).rstrip() + """,
fs AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s
                      WHERE query_label % 3 <> 0 AND label = query_label + 1) WHERE rank <= 10)
SELECT query_id, id, score, rank, false AS fallback FROM fs
UNION ALL SELECT query_id, id, score, rank, true FROM dense WHERE query_id NOT IN (SELECT query_id FROM fs)""")
def filtered_with_fallback(spark, d):
    """A filter that finds nothing for some queries: those take the unfiltered hits. Every query wants the label after its
    own. A label's 31 bits and their complements are the bits of a row, so it holds a query's bits only if the labels are equal."""
    queries, vectors = _query_vectors(spark, d), _vectors(spark, d)
    label = F.col("label").cast("long")
    bit = label + F.shiftleft(F.lit(2**31 - 1) - label, 31)
    asked = queries.where("label % 3 <> 0").withColumn("label", F.col("label") + 1).select("query_id", "vector", bit.alias("need"))
    filtered = search.dense_topk(asked, vectors.select("id", "vector", bit.alias("bits")), K)
    return search.with_fallback(filtered, search.dense_topk(queries, vectors, K))


TYPE_SQL = case(
    [("text IS NULL OR text = ''", q(C.DEFAULT_QUERY_TYPE))]
    + [(has_any("low", p), q(n)) for n, p in C.QUERY_TYPES]
    + [("(" + " OR ".join(f"starts_with(low, {q(x)})" for x in p) + ")", q(n)) for n, p in C.QUERY_PREFIXES],
    q(C.DEFAULT_QUERY_TYPE),
)
#: Query texts: the user turns, benchmark items, and the word lists' own patterns as probes.
PROBES = tuple(p.strip() + " для канала" for _, ps in C.QUERY_TYPES for p in ps) + (
    "Что это", "как дела", "Где? api и FAQ", "РН и арм агента", "какие каналы и webhook для android", "sdk ios swift", "админ панель тег", "",
    "интеграция sdk web widget", "рабочее место оператора и супервайзера", "подробно про kotlin gradle",
)


def _questions(spark, d):
    probes = spark.createDataFrame([(-1 - i, p) for i, p in enumerate(PROBES)], "query_id long, text string")
    turns = table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    items = table(spark, d, "benchmark").select((F.col("item_id") + 10**12).alias("query_id"), "text")
    return probes.union(turns).union(items)


QUESTIONS_SQL = f"""questions AS (SELECT * FROM {rows([(-1 - i, p) for i, p in enumerate(PROBES)])} p(query_id, text)
UNION ALL SELECT conv_id * 1000 + turn, text FROM conversations WHERE role = 'user'
UNION ALL SELECT item_id + 1000000000000, text FROM benchmark)"""


@register(f"WITH {QUESTIONS_SQL} SELECT query_id::BIGINT AS query_id, {TYPE_SQL} AS query_type FROM (SELECT *, {strip('lower(text)')} AS low FROM questions)")
def query_type(spark, d):
    return _questions(spark, d).select("query_id", query.query_type(F.col("text")).alias("query_type"))


STRATEGY_SQL = f"strategies AS (SELECT * FROM {rows(C.STRATEGIES)} s(query_type, k, rerank_top_n, auto_merge, context_reserve, boost_multiplier))"


@register(f"""WITH {QUESTIONS_SQL}, {STRATEGY_SQL}, t AS (SELECT query_id, {TYPE_SQL} AS query_type FROM (SELECT *, {strip('lower(text)')} AS low FROM questions))
SELECT query_id::BIGINT AS query_id, query_type, k, rerank_top_n, auto_merge, context_reserve, boost_multiplier FROM t JOIN strategies USING (query_type)""")
def query_strategy(spark, d):
    return query.with_strategy(_questions(spark, d)).drop("text")


def _rewritten(expr: str) -> str:
    for a, b in C.REPLACEMENTS:
        expr = f"replace({expr}, {q(a)}, {q(b)})"
    return expr


def _boost_list(entries) -> str:
    return "list_aggregate(list_filter([" + ", ".join(f"CASE WHEN {has_any('low', w)} THEN {q(k)} || '=' || round({v!r} * boost_multiplier, 6)::VARCHAR END" for k, v, w in entries) + "], lambda x: x IS NOT NULL), 'string_agg', ',')"


@register(f"""WITH {QUESTIONS_SQL}, {STRATEGY_SQL}, r AS (SELECT query_id, text AS raw, {_rewritten('text')} AS text FROM questions),
t AS (SELECT *, {TYPE_SQL} AS query_type FROM (SELECT *, {strip('lower(text)')} AS low FROM r))
SELECT query_id::BIGINT AS query_id, text, query_type, k,
  coalesce(array_to_string(list_filter([{", ".join(q(e) for e in C.ENTITIES)}], lambda e: contains(lower(raw), e)), ','), '') AS entities,
  CASE WHEN len(parts) > 1 THEN array_to_string(parts[1:{C.MOST_PARTS}], '|') ELSE '' END AS subqueries,
  coalesce({_boost_list([(k, w, ws) for k, w, ws in C.PAGE_BOOSTS])}, '') AS page_boosts,
  coalesce({_boost_list([(k, w, (k, *ws)) for k, w, ws in C.GROUP_BOOSTS])}, '') AS group_boosts
FROM (SELECT *, list_filter(list_transform(string_split(text, {q(C.CONJUNCTION)}), lambda p: {strip('p')}), lambda p: p <> '') AS parts FROM t) JOIN strategies USING (query_type)""")
def query_process(spark, d):
    listed = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"], 6).cast("string"))), ",")
    return query.process(_questions(spark, d)).select(
        "query_id", "text", "query_type", "k",
        F.array_join("entities", ",").alias("entities"), F.array_join("subqueries", "|").alias("subqueries"),
        listed("page_boosts").alias("page_boosts"), listed("group_boosts").alias("group_boosts"),
    )


COMPLEXITY_SQL = case([(has_any("lower(text)", C.SIMPLE_WORDS), "'simple'"), (has_any("lower(text)", C.COMPLEX_WORDS), "'complex'")], "'medium'")
INTENT_SQL = rf"regexp_matches(replace(lower(text), ' ', '  '), {q(query.LIST_INTENT)})"


@register(f"""WITH {QUESTIONS_SQL} SELECT query_id::BIGINT AS query_id, {COMPLEXITY_SQL} AS complexity,
{case([(f"{COMPLEXITY_SQL} = 'simple'", 2), (f"{COMPLEXITY_SQL} = 'complex'", 7)], '6')} AS n_docs, {INTENT_SQL} AS list_intent FROM questions""")
def query_complexity(spark, d):
    t = F.col("text")
    return _questions(spark, d).select("query_id", query.complexity(t).alias("complexity"), query.document_count(t).alias("n_docs"), query.list_intent(t).alias("list_intent"))


THEMES_SQL = f"themes AS (SELECT * FROM {rows([(i, *t) for i, t in enumerate(C.THEMES)])} t(ord, theme_id, domain, section, platform, role))"


def _words_case(column, words):
    return case([(f"{column} = {q(k)}", has_any("lower(text)", w)) for k, w in words.items()], "false")


SCORE_SQL = f"""(CASE WHEN {_words_case('platform', C.ROUTE_WORDS)} THEN 1.0e0 ELSE 0 END + CASE WHEN {_words_case('section', C.ROUTE_WORDS)} THEN 0.7e0 ELSE 0 END
 + CASE WHEN {_words_case('domain', C.DOMAIN_WORDS)} THEN 0.5e0 ELSE 0 END)"""
ROUTE_SQL = f"""{QUESTIONS_SQL}, {THEMES_SQL}, sc AS (SELECT query_id, theme_id, ord, {SCORE_SQL} AS score FROM questions, themes),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS rank FROM sc),
routed AS (SELECT query_id::BIGINT AS query_id, max(theme_id) FILTER (rank = 1) AS primary_theme, max(score) FILTER (rank = 1) AS top_score, max(score) FILTER (rank = 2) AS second_score,
  string_agg(theme_id, ',' ORDER BY rank) AS themes FROM rk GROUP BY query_id)"""


@register(f"""WITH {ROUTE_SQL} SELECT *, (top_score = 0 OR (second_score <> 0 AND round(top_score - second_score, 9) < 0.2)) AS ask_back,
(top_score >= 0.85 AND round(top_score - second_score, 9) >= 0.35) AS use_filter FROM routed""")
def theme_route(spark, d):
    return query.route(_questions(spark, d)).select(
        "query_id", "primary_theme", "top_score", "second_score", F.array_join("themes", ",").alias("themes"), "ask_back", "use_filter"
    )


def _agrees(t) -> str:
    fields = zip(("domain", "section", "platform", "role"), t[1:], strict=True)
    return " AND ".join(f"(coalesce({n}, '') = '' OR {n} = {q(v)})" for n, v in fields if v)


DOC_FIELDS = """(SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'sdk_docs' WHEN 1 THEN 'chatcenter_user_docs' END AS domain,
 ['sdk', 'agent', 'supervisor', 'admin', 'api', 'faq', NULL][(doc_id % 7)::INT + 1] AS section,
 ['android', 'ios', 'web', 'main', NULL, NULL][(doc_id % 6)::INT + 1] AS platform,
 CASE WHEN doc_id % 4 = 0 THEN 'integrator' END AS role FROM documents)"""


def _doc_fields(spark, d):
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("doc_id") % n).cast("int") + 1)
    return table(spark, d, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 3 == 0, "sdk_docs").when(F.col("doc_id") % 3 == 1, "chatcenter_user_docs").alias("domain"),
        pick((*SECTIONS, None), 7).alias("section"),
        pick((*PLATFORMS, None, None), 6).alias("platform"),
        F.when(F.col("doc_id") % 4 == 0, "integrator").alias("role"),
    )


@register(f"SELECT doc_id, {case([(_agrees(t), q(t[0])) for t in C.THEMES], 'NULL')} AS theme_id FROM {DOC_FIELDS}")
def theme_of_doc(spark, d):
    return query.theme_of(_doc_fields(spark, d), "doc_id")


@register(f"""WITH {ROUTE_SQL}, th AS (SELECT doc_id, {case([(_agrees(t), q(t[0])) for t in C.THEMES], 'NULL')} AS theme_id FROM {DOC_FIELDS}),
h AS (SELECT query_id, doc_id AS id, theme_id, primary_theme, string_split(themes, ',')[2:3] AS others, ((abs(query_id) * 31 + doc_id * 17) % 101) / 101.0e0 AS score
      FROM routed JOIN th ON doc_id % 50 = abs(query_id) % 50),
b AS (SELECT query_id, id, round(score + coalesce(CASE WHEN theme_id = primary_theme THEN 0.08e0 WHEN list_contains(others, theme_id) THEN 0.04e0 END, 0), 9)::DOUBLE AS boosted_score FROM h)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY boosted_score DESC, id) AS rank FROM b""")
def theme_boost(spark, d):
    """Queries and documents of a place meet in tasks of HITS_OF_TASK hits or so at most, each query in one of them, and are ranked
    there, query after query: what is exchanged are queries and documents, while hits, whose number is their product, stay
    where they arise and are neither exchanged nor sorted by the task."""
    place = lambda c: (F.abs(c) % 50).alias("place")
    routes = materialize(query.route(_questions(spark, d)).select("query_id", "primary_theme", "themes", place("query_id")), "theme-routes")
    docs = query.theme_of(_doc_fields(spark, d), "doc_id").select(F.col("doc_id").alias("id"), "theme_id", (F.col("doc_id") % 50).alias("place"))
    docs = materialize(docs, "theme-docs")
    # A place's questions may be most of all (its number follows from the turn), so hits are counted by place: 50 rows at most.
    sizes = routes.groupBy("place").count().join(docs.groupBy("place").agg(F.count(F.lit(1)).alias("docs")), "place").collect()
    total = sum(r["count"] * r.docs for r in sizes)
    each = max(1, min(HITS_OF_TASK, math.ceil(total / int(spark.conf.get("spark.sql.shuffle.partitions")))))
    shares = {r.place: math.ceil(r["count"] * r.docs / each) for r in sizes}
    of_place = F.try_element_at(F.create_map(*[F.lit(x).cast("int") for pair in (shares or {-1: 1}).items() for x in pair]), F.col("place").cast("int"))
    dealt = lambda df, share: df.withColumn("share", share).repartition(max(1, sum(shares.values())), "place", "share")
    asking = dealt(routes, F.pmod(F.xxhash64("query_id"), of_place).cast("int")).sortWithinPartitions("place", "share", "query_id")
    found = dealt(docs, F.explode(F.sequence(F.lit(0), of_place - 1)))
    hits = asking.hint("merge").join(found, ["place", "share"]).withColumns({
        "score": ((F.abs("query_id") * 31 + F.col("id") * 17) % 101) / F.lit(101.0), "boosted_score": F.lit(None).cast("double"),
    })
    return boost.ranked_in_place(boost.theme_boosted(hits))


ANSWERED = ("sdk_ios", "user_faq", "none of them")


@register(f"""WITH a AS (SELECT conv_id * 1000 + turn AS query_id, {_pick_sql("turn", ANSWERED)} AS t, (conv_id % 10) / 10.0::DOUBLE AS s, conv_id % 4 AS k FROM conversations WHERE role = 'user')
SELECT query_id, CASE WHEN k <> 3 THEN t END AS theme_id, CASE WHEN k <> 3 THEN s END AS score FROM a""")
def llm_routing(spark, d):
    """A model's answer for each question of the table: bare, fenced, fenced without a language, or no JSON."""
    turns = table(spark, d, "conversations").where("role = 'user'")
    body = F.format_string('[{"theme_id": "%s", "score": %s}]', _pick("turn", ANSWERED), (F.col("conv_id") % 10 / F.lit(10.0)).cast("string"))
    k = F.col("conv_id") % 4
    answer = F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("```\n"), body, F.lit("\n```"))).otherwise("no json")
    parsed = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.try_element_at(query.parse_llm_routing(answer), F.lit(1)).alias("r"))
    return parsed.select("query_id", F.col("r.theme_id").alias("theme_id"), F.col("r.score").alias("score"))


@register("SELECT conv_id * 1000 + turn AS query_id, NULL::VARCHAR AS primary_theme, 0.0::DOUBLE AS top_score, false AS use_filter FROM conversations WHERE role = 'user'")
def routing_off(spark, d):
    turns = table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    return query.route(turns, "none").select("query_id", "primary_theme", "top_score", "use_filter")


@register(DENSE_SQL.format(k=K) + " SELECT x.query_id, x.id, x.rank, substring(d.text, 1, 80) AS text FROM dense x JOIN documents d ON d.doc_id = x.id WHERE x.rank <= 3")
def candidate_preview(spark, d):
    hits = search.dense_topk(_query_vectors(spark, d), _vectors(spark, d), K).select("query_id", "id", F.col("rank").cast("long").alias("rank"))
    payload = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return search.preview(hits.join(payload, "id").withColumn("vector", F.array(F.lit(1.0))), 3, 80).select("query_id", "id", "rank", "text")


@register(HYBRID + f""" SELECT x.query_id, x.id, x.rrf_score FROM f x JOIN documents d ON d.doc_id = x.id WHERE d.lang = 'en'""")
def metadata_filtered_rrf(spark, d):
    """Both rankings under a filter, fused; a filter that no row can meet lets nothing through."""
    dense = materialize(search.dense_topk(_query_vectors(spark, d), _vectors(spark, d), 2 * K), "filter-dense")
    sparse = materialize(search.sparse_topk(_query_texts(spark, d), _texts(spark, d), 2 * K), "filter-sparse")
    payload = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    both = search.filtered_fusion(dense, sparse, payload, {"lang": ["en", "en"]})
    nothing = search.filtered_fusion(dense, sparse, payload, {"lang": ["en", "de"]})  # no row has both
    return both.unionByName(nothing).select("query_id", "id", "rrf_score")


@register(DENSE_SQL.format(k=K) + " SELECT query_id, id::VARCHAR AS id, CASE WHEN rank % 4 = 0 THEN 0.0 ELSE score END AS score, CASE WHEN rank % 2 = 0 THEN rank::VARCHAR END AS place, (1 + (rank % 2 = 0)::INT)::INT AS n FROM dense")
def hit_records(spark, d):
    """Hits in the common form; some have no score, some no place."""
    rank = F.col("rank")
    hits = search.dense_topk(_query_vectors(spark, d), _vectors(spark, d), K).select(
        "query_id", "id", F.when(rank % 4 > 0, F.col("score")).alias("score"), F.when(rank % 2 == 0, rank).alias("place"), F.lit("x").alias("kind")
    )
    return search.hit_records(hits).select("query_id", "id", "score", F.try_element_at("payload", F.lit("place")).alias("place"), F.size("payload").alias("n"))


@register()
def cell_topk(spark, d):
    """Approximate dense search of every row divisible by EVERY; recall is measured in a test."""
    vectors = _vectors(spark, d)
    centres = search.cell_centres(vectors, 16)
    return search.cell_topk(_query_vectors(spark, d), search.cell_index(vectors, centres), centres, K, 12)


@register()
def coded_topk(spark, d):
    """The same over coded vectors; recall is measured in a test."""
    vectors = _vectors(spark, d)
    centres = search.cell_centres(vectors, 16)
    books = codes.residual_books(vectors, centres)
    return codes.coded_topk(_query_vectors(spark, d), codes.coded_index(vectors, centres, books), vectors, centres, books, K, 13)


@register("""SELECT doc_id, regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])(какие|список|перечень)[^\\p{L}\\p{N}_](.*[^\\p{L}\\p{N}_])?канал', 's') AS is_list
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Какие есть каналы? ' WHEN 1 THEN 'Список и каналы ' WHEN 2 THEN 'некакие каналы ' ELSE '' END || text AS text FROM documents)""")
def list_intents(spark, d):
    lead = F.array(*[F.lit(x) for x in ("Какие есть каналы? ", "Список и каналы ", "некакие каналы ", "")])
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.get(lead, (F.col("doc_id") % 4).cast("int")), "text").alias("text"))
    return docs.select("doc_id", query.list_intent(F.col("text")).alias("is_list"))


@register("""WITH t AS (SELECT * FROM (VALUES """ + ", ".join(f"({i}, {q(x)})" for i, x in enumerate(C.THEME_LABELS)) + """) v(i, label))
SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN 'Если ответ затрагивает несколько тематик, сформируй отдельные разделы соответственно: ' || a.label || ', ' || b.label || '.' END AS instruction
FROM documents LEFT JOIN t a ON a.i = doc_id % 9 LEFT JOIN t b ON b.i = (doc_id + 1) % 9""")
def theme_instructions(spark, d):
    ids = F.array(*[F.lit(t[0]) for t in C.THEMES])
    label = lambda n: query.theme_label(F.get(ids, ((F.col("doc_id") + n) % 9).cast("int")))
    second = F.when(F.col("doc_id") % 3 > 0, label(1))
    return table(spark, d, "documents").select("doc_id", context.theme_instruction(label(0), second).alias("instruction"))
