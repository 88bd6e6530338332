"""Index maintenance, quality and operational analytics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import index, ops, quality, search
from .base import Registry, case, has_any, q, strip, table, words

register = Registry()


def _docs(spark, d):
    return table(spark, d, "documents")


UUID = "substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-' || substr({0}, 13, 4) || '-' || substr({0}, 17, 4) || '-' || substr({0}, 21, 12)"


@register(f"SELECT doc_id, {UUID.format('h')} AS point_id FROM (SELECT doc_id, sha1(CASE doc_id % 3 WHEN 0 THEN 'c' || doc_id::VARCHAR WHEN 1 THEN doc_id::VARCHAR || '#' || (doc_id % 5)::VARCHAR ELSE text END) AS h FROM documents)")
def point_ids(spark, d):
    n = F.col("doc_id") % 3
    return _docs(spark, d).select(
        "doc_id",
        index.point_id(F.when(n == 0, F.concat(F.lit("c"), F.col("doc_id"))), F.when(n == 1, F.col("doc_id").cast("string")), (F.col("doc_id") % 5), F.col("text")).alias("point_id"),
    )


@register("""WITH r AS (SELECT sha1(text) AS id, doc_id AS version, lang, source FROM documents)
SELECT id, version, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS n FROM r) WHERE n = 1""")
def payload_dedupe(spark, d):
    """Upsert of all documents by content id into an empty table; the newest version of an id wins."""
    rows = _docs(spark, d).select(F.sha1("text").alias("id"), F.col("doc_id").alias("version"), "lang", "source")
    return index.upsert(rows.limit(0), rows)[0]


@register("SELECT doc_id, lang, source, n_chars, '2024-02-01' AS indexed_at, 'pipeline' AS indexed_via FROM documents")
def payload_build(spark, d):
    raw = _docs(spark, d).withColumn("raw", F.col("text")).withColumn("html", F.col("text")).drop("text")
    return index.payload(raw, F.lit("2024-02-01"), "pipeline")


STATE = "(SELECT sha1(source || ':' || doc_id::VARCHAR) AS doc_key, CASE WHEN doc_id % 7 = 1 THEN 'old' ELSE md5(text) END AS content_hash, CASE WHEN doc_id % 7 = 2 THEN 0 ELSE n_chars END AS mtime FROM documents WHERE doc_id % 7 <> 0)"


def _state(spark, d):
    n = F.col("doc_id") % 7
    return _docs(spark, d).where(n != 0).select(
        index.document_key(F.col("source"), F.col("doc_id")).alias("doc_key"),
        F.when(n == 1, "old").otherwise(F.md5("text")).alias("content_hash"),
        F.when(n == 2, 0).otherwise(F.col("n_chars")).cast("long").alias("mtime"),
    )


@register(f"""SELECT doc_id, doc_key, CASE WHEN s.doc_key IS NULL THEN 'new' WHEN s.content_hash <> d.content_hash THEN 'content' ELSE 'mtime' END AS reason
FROM (SELECT doc_id, sha1(source || ':' || doc_id::VARCHAR) AS doc_key, md5(text) AS content_hash, n_chars AS mtime FROM documents) d LEFT JOIN {STATE} s USING (doc_key)
WHERE s.doc_key IS NULL OR s.content_hash <> d.content_hash OR s.mtime <> d.mtime""")
def changed_docs(spark, d):
    now = _docs(spark, d).select(
        "doc_id", index.document_key(F.col("source"), F.col("doc_id")).alias("doc_key"), F.md5("text").alias("content_hash"), F.col("n_chars").alias("mtime")
    )
    return index.changed(now, _state(spark, d)).select("doc_id", "doc_key", "reason")


CHECKED = "TIMESTAMP '2024-03-01' - to_days((doc_id % 60)::INT)"


def _checked(spark, d):
    return _docs(spark, d).select("doc_id", "source", F.expr("timestamp_ntz'2024-03-01 00:00:00' - make_dt_interval(cast(doc_id % 60 as int))").alias("last_checked"))


@register(f"SELECT doc_id FROM documents WHERE {CHECKED} < TIMESTAMP '2024-03-01' - INTERVAL 30 DAYS")
def expired_state(spark, d):
    return index.expired(_checked(spark, d), F.expr("timestamp_ntz'2024-03-01 00:00:00'")).select("doc_id")


@register(f"SELECT source, count(*) AS n_docs, CAST(max({CHECKED}) AS VARCHAR) AS last_indexed FROM documents GROUP BY source")
def state_statistics(spark, d):
    return index.state_statistics(_checked(spark, d).withColumnRenamed("last_checked", "indexed_at")).withColumn("last_indexed", F.date_format("last_indexed", "yyyy-MM-dd HH:mm:ss"))


@register("SELECT url, md5(url) AS file_key, sha256(html) AS content_hash, length(html)::INT AS content_length FROM pages")
def crawl_cache(spark, d):
    return index.cache_entries(table(spark, d, "pages").withColumnRenamed("html", "content"))


@register("SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def cache_orphans(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    return index.orphans(pages, pages.where("page_id % 3 = 0"))


@register("SELECT regexp_replace(url, '[?#].*$', '') AS url, min(page_id) AS first_page FROM pages GROUP BY 1")
def ordered_distinct_urls(spark, d):
    bare = table(spark, d, "pages").select(F.regexp_replace("url", "[?#].*$", "").alias("url"), F.col("page_id").alias("first_page"))
    return index.ordered_distinct(bare, "url", "first_page")


@register(r"""WITH t AS (SELECT doc_id, token, count(*)::DOUBLE AS weight FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_\-/]+')) AS token FROM documents) GROUP BY ALL)
SELECT doc_id, token, weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY abs(weight) DESC, token) AS n FROM t) WHERE n <= 1000""")
def sparse_prune(spark, d):
    return search.pruned_postings(_docs(spark, d), "doc_id")


@register("""SELECT vec_id, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6)::DOUBLE AS norm, round(u[1], 9)::DOUBLE AS first FROM
(SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings))""")
def vector_normalize(spark, d):
    from ..functions.text import l2_normalize

    u = table(spark, d, "embeddings").select("vec_id", l2_normalize(F.col("embedding")).alias("u"))
    norm = F.sqrt(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x))
    return u.select("vec_id", F.round(norm, 6).alias("norm"), F.round(F.element_at("u", 1), 9).alias("first"))


@register("""SELECT count(*) AS n_vectors, count(*) FILTER (list_sum(list_transform(embedding, lambda x: abs(x))) = 0) AS n_zero, count(DISTINCT label) AS n_labels FROM embeddings""")
def zero_vectors(spark, d):
    v = table(spark, d, "embeddings")
    size = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.abs(x))
    return v.agg(F.count(F.lit(1)).alias("n_vectors"), F.count_if(size == 0).alias("n_zero"), F.countDistinct("label").alias("n_labels"))


@register("""WITH f AS (SELECT lang || '/' || source || '/p' || doc_id::VARCHAR || '.md' AS rel_path, lang, source FROM documents)
SELECT rel_path, 'Lang ' || lang || CASE WHEN source < 'src5' THEN '|Src ' || source ELSE '' END AS labels, CASE WHEN source < 'src5' THEN 'Src ' || source ELSE 'Lang ' || lang END AS current_label,
'Lang ' || lang || CASE WHEN source < 'src5' THEN ' > Src ' || source ELSE '' END AS breadcrumbs FROM f""")
def directory_labels(spark, d):
    docs = _docs(spark, d)
    files = docs.select(F.concat("lang", F.lit("/"), "source", F.lit("/p"), F.col("doc_id"), F.lit(".md")).alias("rel_path"))
    top = docs.select(F.col("lang").alias("dir"), F.concat(F.lit("Lang "), "lang").alias("label")).distinct()
    sub = docs.where("source < 'src5'").select(F.concat("lang", F.lit("/"), "source").alias("dir"), F.concat(F.lit("Src "), "source").alias("label")).distinct()
    return index.directory_labels(files, top.union(sub))


@register("""SELECT doc_id::VARCHAR || '.md' AS rel_path, NULL AS top_level, NULL AS a, 'c' AS b FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT lang || '/' || doc_id::VARCHAR || '.md', lang, CASE WHEN lang = 'en' THEN 'extra' END, CASE WHEN lang = 'en' THEN 'extra_b' ELSE 'c' END FROM documents WHERE doc_id % 2 = 1""")
def top_directory_metadata(spark, d):
    rel = F.when(F.col("doc_id") % 2 == 0, F.concat(F.col("doc_id"), F.lit(".md"))).otherwise(F.concat("lang", F.lit("/"), F.col("doc_id"), F.lit(".md")))
    files = _docs(spark, d).select(rel.alias("rel_path"), F.create_map(F.lit("b"), F.lit("c")).alias("category"))
    extra = spark.createDataFrame([("en", {"a": "extra", "b": "extra_b"})], "top_dir string, extra map<string,string>")
    m = lambda k: F.try_element_at("meta", F.lit(k))
    return index.top_directory_metadata(files, extra).select("rel_path", m("top_level_dir").alias("top_level"), m("a").alias("a"), m("b").alias("b"))


@register("""WITH t AS (SELECT CASE page_id % 4 WHEN 0 THEN 'api' WHEN 1 THEN 'guide' WHEN 2 THEN 'faq' ELSE 'other' END AS page_type, length(html) AS n FROM pages)
SELECT page_type, CASE page_type WHEN 'api' THEN 1200 WHEN 'guide' THEN 960 WHEN 'faq' THEN 600 ELSE 800 END::INT AS chunk_size, count(*) AS n_pages, round(avg(n), 6)::DOUBLE AS mean_length FROM t GROUP BY ALL""")
def collection_statistics(spark, d):
    n = F.col("page_id") % 4
    t = table(spark, d, "pages").select(F.when(n == 0, "api").when(n == 1, "guide").when(n == 2, "faq").otherwise("other").alias("page_type"), F.length("html").alias("n"))
    return t.groupBy("page_type").agg(F.count(F.lit(1)).alias("n_pages"), F.round(F.avg("n"), 6).alias("mean_length")).withColumn("chunk_size", index.chunk_size(F.col("page_type")))


@register("""WITH t AS (SELECT source, count(*) AS n_docs, count(*) FILTER (e.vec_id IS NOT NULL) AS n_dense FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY source)
SELECT *, round(n_dense * 100.0e0 / n_docs, 4)::DOUBLE AS coverage FROM t""")
def index_status(spark, d):
    e = table(spark, d, "embeddings").select("vec_id")
    t = _docs(spark, d).join(e, F.col("vec_id") == F.col("doc_id"), "left").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count("vec_id").alias("n_dense"))
    return t.withColumn("coverage", F.round(F.col("n_dense") * 100.0 / F.col("n_docs"), 4))


# ---------------------------------------------------------------- quality


def _turns(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, d, "conversations").withColumns({"reply": F.lead("text").over(w), "next_role": F.lead("role").over(w), "before": F.lag("text").over(w)})
    return t.where("role = 'user' AND next_role = 'assistant'").select(
        F.concat_ws("-", "conv_id", "turn").alias("interaction_id"), "conv_id", F.col("text").alias("query"), F.col("reply").alias("response"),
        F.when(F.col("conv_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array_compact(F.array("before", "text", "reply"))).alias("contexts"),
    )


def _interactions(spark, d):
    """Scored turns with a time and a vote for some."""
    return quality.score(_turns(spark, d)).select(
        "interaction_id", *quality.SCORES,
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(conv_id * 7 % 500 as int))").alias("created_at"),
        F.when(F.col("conv_id") % 3 == 0, "positive").when(F.col("conv_id") % 3 == 1, "negative").alias("feedback"),
    )


def _set(expr):
    return f"list_distinct({words(f'lower({expr})')})"


STOPS = "[" + ", ".join(q(w) for w in C.STOP_WORDS) + "]"


def _less(expr):
    return f"list_filter({expr}, lambda s: NOT list_contains({STOPS}, s))"


FAITH = f"""CASE WHEN length(response) < 20 THEN 0.1e0 ELSE round(greatest(0e0, least(1e0, 0.3e0 + CASE WHEN length(response) > 100 THEN 0.1e0 ELSE 0e0 END
 + CASE WHEN total > 0 THEN least(0.4e0, matched / total::DOUBLE * 2e0) ELSE 0e0 END + CASE WHEN used > 0 THEN least(0.2e0, used * 0.1e0) ELSE 0e0 END
 + CASE WHEN regexp_matches(response, '[0-9]') THEN 0.05e0 ELSE 0e0 END + CASE WHEN regexp_matches(lower(response), {q(quality.CALENDAR)}) THEN 0.05e0 ELSE 0e0 END
 - CASE WHEN {has_any('lower(response)', C.EVASIVE_FAITH)} THEN 0.2e0 ELSE 0e0 END)), 9) END"""
RELEV = f"""round(greatest(0e0, least(1e0, 0.3e0 + CASE WHEN length(response) > 100 THEN 0.2e0 WHEN length(response) > 50 THEN 0.1e0 ELSE 0e0 END
 + CASE WHEN len(asked) > 0 THEN least(0.4e0, len(list_intersect(asked, own)) / len(asked)::DOUBLE * 0.8e0) ELSE 0e0 END
 - CASE WHEN {has_any('lower(response)', C.EVASIVE)} THEN 0.2e0 ELSE 0e0 END + CASE WHEN {has_any('lower(response)', C.DOMAIN_ANSWER)} THEN 0.1e0 ELSE 0e0 END)), 9)"""
PREC = """CASE WHEN n = 0 THEN 0e0 WHEN len(asked) = 0 THEN round(0.4e0 + base, 9) ELSE round(least(1e0, 0.4e0 + base + least(0.3e0, coalesce(list_sum(likes), 0) / n * 3e0)
 + CASE WHEN relevant > 0 THEN least(0.1e0, relevant / n::DOUBLE * 0.2e0) ELSE 0e0 END), 9) END"""
SCORED = f"""turns AS (SELECT *, lead(text) OVER w AS reply, lead(role) OVER w AS next_role, lag(text) OVER w AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
raw AS (SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS interaction_id, conv_id, text AS query, reply AS response,
 CASE WHEN conv_id % 4 = 0 THEN [] ELSE list_filter([before, text, reply], lambda x: x IS NOT NULL) END::VARCHAR[] AS contexts FROM turns WHERE role = 'user' AND next_role = 'assistant'),
p AS (SELECT *, len(contexts) AS n, {_less(_set('query'))} AS asked, {_set('response')} AS own, list_transform(contexts, lambda c: {_set('c')}) AS sets FROM raw),
p2 AS (SELECT *, coalesce(list_sum(list_transform(sets, lambda s: len(s))), 0) AS total, coalesce(list_sum(list_transform(sets, lambda s: len(list_intersect(s, own)))), 0) AS matched,
 len(list_filter(contexts, lambda c: length(c) > 10 AND len(list_filter(list_transform(generate_series(1, len({words('lower(c)')}) - 4), lambda i: contains(lower(response), array_to_string({words('lower(c)')}[i:i + 4], ' '))), lambda b: b)) > 0)) AS used,
 CASE WHEN n >= 5 THEN 0.2e0 WHEN n >= 3 THEN 0.15e0 ELSE 0.1e0 END AS base,
 list_transform(sets, lambda s: len(list_intersect(asked, {_less('s')})) / len(list_distinct(list_concat(asked, {_less('s')})))::DOUBLE) AS likes FROM p),
p3 AS (SELECT *, len(list_filter(likes, lambda x: x > 0.1)) AS relevant FROM p2),
scored AS (SELECT interaction_id, conv_id, {FAITH} AS faithfulness, {PREC} AS context_precision, {RELEV} AS answer_relevancy FROM p3),
interactions AS (SELECT *, round((faithfulness + context_precision + answer_relevancy) / 3, 9) AS overall, TIMESTAMP '2024-01-01' + to_hours((conv_id * 7 % 500)::INT) AS created_at,
 CASE conv_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' END AS feedback FROM scored)"""


@register(f"WITH {SCORED} SELECT interaction_id, faithfulness, context_precision, answer_relevancy, overall FROM interactions")
def answer_scores(spark, d):
    return quality.score(_turns(spark, d)).select("interaction_id", *quality.SCORES)


SUMMARY = """count(*) AS n, count(feedback) AS n_feedback, count(*) FILTER (feedback = 'positive') AS n_positive, count(*) FILTER (feedback = 'negative') AS n_negative,
CASE WHEN count(feedback) > 0 THEN round(count(*) FILTER (feedback = 'positive') * 100.0e0 / count(feedback), 6) ELSE 0e0 END AS satisfaction, """ + ", ".join(
    f"coalesce(round(avg({s}), 6), 0)::DOUBLE AS avg_{s}" for s in quality.SCORES
)


@register(f"WITH {SCORED} SELECT {SUMMARY} FROM (SELECT * FROM interactions ORDER BY created_at DESC, interaction_id DESC LIMIT 100)")
def quality_stats(spark, d):
    return quality.statistics(_interactions(spark, d))


@register(f"WITH {SCORED} SELECT {SUMMARY} FROM interactions WHERE created_at >= TIMESTAMP '2024-01-08'")
def quality_stats_days(spark, d):
    return quality.statistics(_interactions(spark, d), since=F.expr("timestamp_ntz'2024-01-08 00:00:00'"))


@register(f"WITH {SCORED} SELECT CAST(created_at AS DATE) AS day, {SUMMARY} FROM interactions GROUP BY 1")
def quality_trends(spark, d):
    return quality.trends(_interactions(spark, d))


@register(f"""WITH {SCORED}, v AS (SELECT *, CASE feedback WHEN 'positive' THEN 1e0 ELSE -1e0 END AS vote FROM interactions WHERE feedback IS NOT NULL),
c AS ({" UNION ALL ".join(f"SELECT {q(s)} AS metric, round(corr({s}, vote), 6)::DOUBLE AS correlation FROM v" for s in quality.SCORES)})
SELECT metric, correlation, CASE WHEN abs(correlation) >= 0.7 THEN 'strong' WHEN abs(correlation) >= 0.4 THEN 'moderate' ELSE 'weak' END AS strength FROM c""")
def quality_correlation(spark, d):
    return quality.correlation(_interactions(spark, d))


@register(f"WITH {SCORED} SELECT interaction_id, overall FROM interactions ORDER BY created_at DESC, interaction_id DESC LIMIT 20")
def quality_recent(spark, d):
    return quality.recent(_interactions(spark, d), 20).select("interaction_id", "overall")


@register(f"WITH {SCORED} SELECT interaction_id, CASE WHEN conv_id % 5 = 0 THEN 'positive' WHEN conv_id % 5 = 1 THEN 'negative' ELSE feedback END AS feedback FROM interactions")
def feedback_update(spark, d):
    base = _interactions(spark, d)
    conv = F.split_part("interaction_id", F.lit("-"), F.lit(1)).cast("long")
    votes = base.select("interaction_id", conv.alias("c")).where("c % 5 < 3").select(
        "interaction_id", "c",
        F.explode(F.array(
            F.struct(F.lit("negative").alias("feedback"), F.lit(1).alias("given_at")),
            F.struct(F.when(F.col("c") % 5 == 0, "positive").when(F.col("c") % 5 == 1, "negative").otherwise("maybe").alias("feedback"), F.lit(2).alias("given_at")),
        )).alias("v"),
    ).where("c % 5 < 2 OR v.given_at = 2").select("interaction_id", "v.*")
    return quality.apply_feedback(base, votes).select("interaction_id", "feedback")


# ---------------------------------------------------------------- operations

RISK = "CASE event_type WHEN 'error' THEN 5 WHEN 'purchase' THEN 1 ELSE 0 END"


def _events(spark, d):
    return table(spark, d, "events")


@register(f"""SELECT event_id, user_id, sum({RISK}) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)::BIGINT AS risk_hour FROM events""")
def risk_last_hour(spark, d):
    return ops.risk_last_hour(_events(spark, d), F.expr(RISK)).select("event_id", "user_id", "risk_hour")


@register(f"""WITH u AS (SELECT user_id, sum(CASE WHEN ts >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 1 HOUR THEN {RISK} ELSE 0 END) AS risk FROM events GROUP BY user_id)
SELECT count(*) AS total_users, count(*) FILTER (risk > 10) AS high_risk_users, (SELECT count(DISTINCT user_id) FROM events WHERE value > 99) AS blocked_users FROM u""")
def security_statistics(spark, d):
    e = _events(spark, d)
    return ops.security_statistics(e, F.expr(RISK), F.expr("timestamp_ntz'2024-01-15 12:00:00'"), e.where("value > 99").select("user_id"))


BOUNDS = C.BUCKETS


@register(" UNION ALL ".join(f"SELECT event_type, {q(str(b))} AS le, count(*) FILTER (value <= {b}) AS n FROM events GROUP BY event_type" for b in BOUNDS) + " UNION ALL SELECT event_type, '+Inf', count(value) FROM events GROUP BY event_type")
def histogram_le(spark, d):
    return ops.histogram(_events(spark, d), "value", ["event_type"])


WINDOWED = """w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4)::DOUBLE AS total, max(value) AS most, round(avg(value), 6)::DOUBLE AS mean FROM events GROUP BY ALL)"""


@register(f"WITH {WINDOWED} SELECT CAST(start AS VARCHAR) AS start, event_type, n, total, most, mean FROM w")
def metric_windows(spark, d):
    return ops.metric_windows(_events(spark, d), "1 hour", "event_type").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@register(f"WITH {WINDOWED} SELECT CAST(start AS VARCHAR) AS start, event_type, n - lag(n) OVER (PARTITION BY event_type ORDER BY start) AS change FROM w")
def metric_rates(spark, d):
    return ops.rates(ops.metric_windows(_events(spark, d), "1 hour", "event_type"), "event_type").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "change")


@register("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, round(quantile_disc(value, 0.95), 6)::DOUBLE AS p95,
round(count(*) FILTER (value > 50) / count(*)::DOUBLE, 6)::DOUBLE AS share_high, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS k_total FROM events GROUP BY event_type""")
def metric_summary(spark, d):
    e = _events(spark, d)
    return e.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_users"),
        F.round(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)"), 6).alias("p95"),
        F.round(F.count_if(F.col("value") > 50) / F.count(F.lit(1)), 6).alias("share_high"),
        F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k_total"),
    )


@register("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, CAST(date_trunc('second', min(ts)) AS VARCHAR) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark, d):
    return ops.sessions(_events(spark, d), "30 minutes").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@register("""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS dt, count(*) AS n_records, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1""")
def query_log_days(spark, d):
    """What the log sink partitions by: one folder for each day."""
    from ..sources.sinks import log_partitions

    return log_partitions(_events(spark, d)).groupBy("dt").agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct("user_id").alias("n_users"))


@register()
def rate_limit(spark, d):
    return ops.rate_limit(_events(spark, d))


@register()
def circuit_breaker(spark, d):
    e = _events(spark, d).select("event_id", F.concat(F.lit("s"), F.col("user_id") % 3).alias("service"), "ts", (F.col("event_type") != "error").alias("ok"))
    return ops.circuit(e, *C.BREAKERS["llm"])


REQUEST = """(SELECT event_id, user_id, CASE event_id % 4 WHEN 0 THEN 'telegram' WHEN 1 THEN 'web' WHEN 2 THEN 'api' ELSE 'mail' END AS channel,
 CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '<' || user_id::VARCHAR ELSE user_id::VARCHAR END AS chat_id,
 CASE WHEN event_id % 7 = 0 THEN ' ' WHEN event_id % 7 = 1 THEN '<b>' || event_type ELSE event_type END AS message FROM events)"""


@register(f"""WITH b AS (SELECT DISTINCT user_id FROM events WHERE value > 99.5), r AS (SELECT e.*, b.user_id IS NOT NULL AS blocked FROM {REQUEST} e LEFT JOIN b USING (user_id)),
c AS (SELECT *, CASE WHEN blocked THEN 'blocked' WHEN channel = 'mail' THEN 'channel' WHEN chat_id LIKE '<%' THEN 'chat_id' WHEN trim(message) = '' THEN 'empty' ELSE '' END AS error FROM r)
SELECT event_id, error, error = '' AS is_valid, error = '' AND contains(message, '<') AS cleaned, CASE WHEN error = '' THEN replace(replace(message, '<', '&lt;'), '>', '&gt;') ELSE message END AS message FROM c""")
def request_validation(spark, d):
    from ..operators import query

    e = _events(spark, d)
    requests = e.select(
        "event_id", "user_id",
        F.expr("CASE event_id % 4 WHEN 0 THEN 'telegram' WHEN 1 THEN 'web' WHEN 2 THEN 'api' ELSE 'mail' END").alias("channel"),
        F.expr("CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '<' || cast(user_id as string) ELSE cast(user_id as string) END").alias("chat_id"),
        F.expr("CASE WHEN event_id % 7 = 0 THEN ' ' WHEN event_id % 7 = 1 THEN '<b>' || event_type ELSE event_type END").alias("message"),
    )
    return query.validate(requests, e.where("value > 99.5")).select("event_id", "error", "is_valid", "cleaned", "message")


@register("""WITH t AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'api' ELSE 'other' END AS page_type, page_id % 11 / 10e0 AS complexity, page_id % 7 / 6e0 AS density FROM pages)
SELECT page_id, CASE WHEN page_type = 'api' THEN 0.3e0 WHEN complexity > 0.7 THEN 0.7e0 WHEN density > 0.6 THEN 0.6e0 ELSE 0.5e0 END AS dense_weight,
CASE WHEN page_type = 'api' THEN 0.7e0 WHEN complexity > 0.7 THEN 0.3e0 WHEN density > 0.6 THEN 0.4e0 ELSE 0.5e0 END AS sparse_weight,
CASE WHEN page_type = 'api' THEN 1200 WHEN complexity > 0.8 THEN 720 WHEN complexity < 0.3 THEN 1000 ELSE 800 END::INT AS chunk_size FROM t""")
def metadata_strategy(spark, d):
    p = table(spark, d, "pages").select(
        "page_id", F.when(F.col("page_id") % 3 == 0, "api").otherwise("other").alias("page_type"),
        (F.col("page_id") % 11 / 10.0).alias("complexity"), (F.col("page_id") % 7 / 6.0).alias("density"),
    )
    dense, sparse = search.search_weights(F.col("page_type"), F.col("complexity"), F.col("density"))
    return p.select("page_id", dense.alias("dense_weight"), sparse.alias("sparse_weight"), index.chunk_size(F.col("page_type"), F.col("complexity")).alias("chunk_size"))


@register("""SELECT lang, count(*) AS n, min(length(text))::INT AS shortest, max(length(text))::INT AS longest,
round(count(*) FILTER (regexp_matches(lower(text), '[а-яё]')) / count(*)::DOUBLE, 6)::DOUBLE AS cyrillic,
round(count(*) FILTER (doc_id % 3 <> 0) / count(*)::DOUBLE, 6)::DOUBLE AS titled FROM documents GROUP BY lang""")
def index_quality(spark, d):
    docs = _docs(spark, d).withColumn("title", F.when(F.col("doc_id") % 3 != 0, "t"))
    return index.quality_check(docs, "lang")


@register("""WITH t AS (SELECT event_type AS stage, sum(value) AS seconds, sum(user_id)::DOUBLE AS docs, count(*)::DOUBLE AS chunks FROM events GROUP BY 1)
SELECT stage, round(seconds, 6)::DOUBLE AS seconds, round(seconds / sum(seconds) OVER (), 6)::DOUBLE AS share, round(docs / seconds, 4)::DOUBLE AS docs_s, round(chunks / seconds, 4)::DOUBLE AS chunks_s FROM t""")
def stage_shares(spark, d):
    return ops.stage_shares(_events(spark, d).select(F.col("event_type").alias("stage"), F.col("value").alias("seconds"), F.col("user_id").alias("docs"), F.lit(1).alias("chunks")))


@register()
def cache_replay(spark, d):
    return ops.cache_replay(_events(spark, d).withColumnRenamed("user_id", "key"), 3600)


@register()
def sampled_interactions(spark, d):
    return quality.sampled(_interactions(spark, d), 0.5)


@register("""SELECT doc_id, 'docs' AS domain, CASE lang WHEN 'en' THEN 'sdk' WHEN 'de' THEN 'faq' ELSE 'other' END AS section, CASE lang WHEN 'en' THEN 'web' END AS platform,
CASE lang WHEN 'en' THEN 'integrator' ELSE 'reader' END AS role, CASE lang WHEN 'de' THEN 'faq' END AS page_type FROM documents""")
def path_themes(spark, d):
    path = F.concat(F.lpad((F.col("doc_id") % 90).cast("string"), 2, "0"), F.lit("-"), F.upper("lang"), F.lit("/x.md"))
    by_dir = {"section": {"en": "sdk", "de": "faq"}, "platform": {"en": "web"}, "page_type": {"de": "faq"}}
    meta = index.theme_metadata(path, "docs", by_dir, {"sdk": "integrator"}, default={"section": "other", "role": "reader"})
    return _docs(spark, d).select("doc_id", meta.alias("m")).select("doc_id", "m.*")


@register("""SELECT event_id, (SELECT max(value) FROM events x WHERE x.event_type = e.event_type AND x.user_id = e.user_id AND x.ts <= e.ts AND x.ts >= e.ts - INTERVAL 1 HOUR) AS most FROM events e""")
def max_over_hour(spark, d):
    return ops.max_over_time(_events(spark, d), "value", 3600, "event_type", "user_id").select("event_id", "most")


@register("""WITH s AS (SELECT event_type, event_id, ts, value, time_bucket(INTERVAL 2 HOUR, ts) + unnest([1, 2, 3, 4]) * INTERVAL 2 HOUR AS e FROM events WHERE ts IS NOT NULL AND value IS NOT NULL),
l AS (SELECT *, lag(value) OVER (PARTITION BY event_type, e ORDER BY ts, event_id) AS before FROM s)
SELECT event_type, CAST(e AS VARCHAR) AS end_at, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most, arg_max(value, (ts, event_id)) AS last,
round(sum(CASE WHEN before IS NULL THEN 0 WHEN value >= before THEN value - before ELSE value END), 4) AS increase FROM l GROUP BY event_type, e""")
def range_functions(spark, d):
    """Values of events as counters, every two hours over the eight hours before."""
    found = ops.range_over_time(_events(spark, d), "value", 28_800, 7_200, "event_type", order=("event_id",))
    return found.select("event_type", F.col("at").cast("string").alias("end_at"), "n", F.round("total", 4).alias("total"), "least", "most", "last", F.round("increase", 4).alias("increase"))


@register(f"""WITH b(i, le) AS (VALUES {", ".join(f"({i + 1}, {b}::DOUBLE)" for i, b in enumerate(BOUNDS))}),
n AS (SELECT event_type, i, le, count(*) FILTER (value <= le) AS c FROM events, b GROUP BY ALL), t AS (SELECT event_type, count(value) AS total FROM events GROUP BY event_type),
f AS (SELECT event_type, min(i) AS i FROM n JOIN t USING (event_type) WHERE c >= 0.95 * total GROUP BY event_type),
x AS (SELECT t.event_type, total, h.le AS high, h.c AS reached, coalesce(l.le, 0) AS low, coalesce(l.c, 0) AS under FROM t LEFT JOIN f USING (event_type)
LEFT JOIN n h ON h.event_type = t.event_type AND h.i = f.i LEFT JOIN n l ON l.event_type = t.event_type AND l.i = f.i - 1)
SELECT event_type, round(CASE WHEN high IS NULL THEN {float(BOUNDS[-1])!r}::DOUBLE WHEN reached > under THEN low + (high - low) * (total * 0.95::DOUBLE - under) / (reached - under) ELSE high END, 9) AS quantile FROM x""")
def latency_p95(spark, d):
    return ops.histogram_quantile(ops.histogram(_events(spark, d), "value", ["event_type"]), 0.95, "event_type")


@register()
def bounded_cache(spark, d):
    """Lookups of users, a cache of 50 entries for each kind of event."""
    return ops.bounded_cache_replay(_events(spark, d).withColumn("key", F.col("user_id")), "event_type", 50, 86_400.0)


LINES = "(SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS text FROM documents)"


def _lines(spark, d):
    return _docs(spark, d).select("doc_id", "lang", F.explode(F.split("text", "\n")).alias("text"))


@register(f"""SELECT d.doc_id, coalesce(n, 0) AS n_chunks, CASE WHEN length(d.text) > 0 THEN round(coalesce(c, 0) * 100.0::DOUBLE / length(d.text), 4) ELSE 0 END::DOUBLE AS percent
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, sum(length(text)) AS c FROM {LINES} GROUP BY doc_id) USING (doc_id)""")
def line_coverage(spark, d):
    """What the lines of each document, taken as its chunks, carry of its text."""
    return index.coverage(_docs(spark, d), _lines(spark, d))


@register(f"""WITH l AS (SELECT lang, len({words("text")}) AS n FROM {LINES})
SELECT lang, count(*) AS n, sum(n)::BIGINT AS tokens, round(avg(n), 6)::DOUBLE AS mean, round(count(*) FILTER (WHERE n BETWEEN 8 AND 40) / count(*)::DOUBLE, 6)::DOUBLE AS optimal FROM l GROUP BY lang""")
def chunk_metrics(spark, d):
    """Lines as chunks: how many, their words, and the share of them within a range."""
    from ..functions.text import words as words_of

    return index.chunk_metrics(_lines(spark, d).select("lang", F.size(words_of(F.col("text"))).cast("long").alias("n_tokens")), "lang", 8, 40)
