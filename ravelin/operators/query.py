"""Query understanding: type, strategy, entities, rewriting, boosts, theme routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import any_of, sanitize, strip
from .boost import platform_of


def query_type(text: Column) -> Column:
    q = strip(F.lower(text))
    out = F.when(text.isNull() | (text == ""), C.DEFAULT_QUERY_TYPE)
    for name, patterns in C.QUERY_TYPES:
        out = out.when(any_of(q, patterns), name)
    for name, prefixes in C.QUERY_PREFIXES:
        out = out.when(reduce(lambda a, b: a | b, [q.startswith(p) for p in prefixes]), name)
    return out.otherwise(C.DEFAULT_QUERY_TYPE)


def strategies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(C.STRATEGIES),
        "query_type string, k int, rerank_top_n int, auto_merge boolean, context_reserve double, boost_multiplier double",
    )


def with_strategy(queries: DataFrame) -> DataFrame:
    """Adds query_type and its strategy; the six strategies are broadcast."""
    return queries.withColumn("query_type", query_type(F.col("text"))).join(F.broadcast(strategies(queries.sparkSession)), "query_type")


def entities(text: Column) -> Column:
    return F.filter(F.array(*[F.lit(e) for e in C.ENTITIES]), lambda e: F.contains(F.lower(text), e))


def rewrite(text: Column) -> Column:
    return reduce(lambda t, r: F.replace(t, F.lit(r[0]), F.lit(r[1])), C.REPLACEMENTS, text)


def decompose(text: Column) -> Column:
    parts = F.filter(F.transform(F.split(text, C.CONJUNCTION), strip), lambda p: p != "")
    return F.when(F.size(parts) > 1, F.slice(parts, 1, C.MOST_PARTS)).otherwise(F.array().cast("array<string>"))


def page_boosts(text: Column, multiplier: Column) -> Column:
    low = F.lower(text)
    entries = [F.when(any_of(low, words), F.struct(F.lit(k).alias("key"), (F.lit(w) * multiplier).alias("value"))) for k, w, words in C.PAGE_BOOSTS]
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def group_boosts(text: Column, multiplier: Column) -> Column:
    low = F.lower(text)
    entries = [
        F.when(any_of(low, (label, *synonyms)), F.struct(F.lit(label).alias("key"), (F.lit(w) * multiplier).alias("value")))
        for label, w, synonyms in C.GROUP_BOOSTS
    ]
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def process(queries: DataFrame) -> DataFrame:
    """queries(query_id, text) with everything the later steps read."""
    out = queries.withColumn("entities", entities(F.col("text"))).withColumn("text", rewrite(F.col("text")))
    out = with_strategy(out)
    m = F.col("boost_multiplier")
    return out.withColumns(
        {"subqueries": decompose(F.col("text")), "page_boosts": page_boosts(F.col("text"), m), "group_boosts": group_boosts(F.col("text"), m)}
    )


def complexity(text: Column) -> Column:
    low = F.lower(text)
    return F.when(any_of(low, C.SIMPLE_WORDS), "simple").when(any_of(low, C.COMPLEX_WORDS), "complex").otherwise("medium")


def document_count(text: Column) -> Column:
    c = complexity(text)
    return F.when(c == "simple", C.DOC_COUNTS[0]).when(c == "complex", C.DOC_COUNTS[1]).otherwise(C.DOC_COUNTS[2])


LIST_INTENT = r"(^|[^\p{L}\p{N}_])(какие|список|перечень)([^\p{L}\p{N}_]|$)(?s:.*)(^|[^\p{L}\p{N}_])канал"


def list_intent(text: Column) -> Column:
    """какие / список / перечень as a word and, later, a word that begins with канал."""
    return F.regexp_replace(F.lower(text), " ", "  ").rlike(LIST_INTENT)


# Allowed channels, longest chat id.
CHANNELS, CHAT_ID_MOST = ("telegram", "web", "api"), 100


def validate(requests: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """requests(user_id, channel, chat_id, message) with is_valid, error (the first that applies),
    message cleaned, and whether cleaning changed it."""
    if blocked is not None:
        flags = blocked.select("user_id", F.lit(True).alias("__blocked")).distinct()
        requests = requests.join(flags, "user_id", "left")
    else:
        requests = requests.withColumn("__blocked", F.lit(None).cast("boolean"))
    chat, message = F.col("chat_id").cast("string"), F.coalesce("message", F.lit(""))
    bad_chat = (F.length(chat) > CHAT_ID_MOST) | chat.rlike("[<>\"']")
    error = (
        F.when(F.col("__blocked"), "blocked")
        .when(~F.coalesce(F.col("channel").isin(*CHANNELS), F.lit(False)), "channel")
        .when(F.coalesce(bad_chat, F.lit(False)), "chat_id")
        .when(strip(message) == "", "empty")
        .otherwise("")
    )
    clean = F.when(error == "", sanitize(message)).otherwise(message)
    out = requests.withColumns({"error": error, "is_valid": error == "", "cleaned": (error == "") & (clean != message), "message": clean})
    return out.drop("__blocked")


# ---------------------------------------------------------------- themes


def keyword_score(low: Column) -> Column:
    """Score of a query against the theme columns."""
    words = lambda column: reduce(
        lambda w, item: w.when(F.col(column) == item[0], any_of(low, item[1])), C.ROUTE_WORDS.items(), F.when(F.lit(False), F.lit(False))
    ).otherwise(False)
    domain = reduce(
        lambda w, item: w.when(F.col("domain") == item[0], any_of(low, item[1])), C.DOMAIN_WORDS.items(), F.when(F.lit(False), F.lit(False))
    ).otherwise(False)
    return (
        F.when(words("platform"), C.PLATFORM_SCORE).otherwise(0.0)
        + F.when(words("section"), C.SECTION_SCORE).otherwise(0.0)
        + F.when(domain, C.DOMAIN_SCORE).otherwise(0.0)
    )


def user_score() -> Column:
    same = lambda a, b: F.when(F.lower(F.coalesce(F.col(a), F.lit(""))) == F.col(b), C.USER_SCORE).otherwise(0.0)
    return same("user_role", "role") + same("user_platform", "platform")


def theme_scores(queries: DataFrame) -> DataFrame:
    """queries(query_id, text[, user_role, user_platform]) against every theme; the nine themes are a literal of the plan."""
    score, user = keyword_score(F.col("_low")), [c for c in ("user_role", "user_platform") if c in queries.columns]
    if len(user) == 2:
        score = score + user_score()
    names = ("theme_id", "domain", "section", "platform", "role")
    each = F.array(*[F.struct(F.lit(i).alias("ord"), *[F.lit(v).cast("string").alias(n) for n, v in zip(names, t, strict=True)]) for i, t in enumerate(C.THEMES)])
    paired = queries.select("query_id", F.lower("text").alias("_low"), *user, F.inline(each))
    return paired.select("query_id", "theme_id", "ord", "domain", "section", "platform", score.alias("score"))


def route(queries: DataFrame, mode: str = "heuristic", answers: DataFrame | None = None) -> DataFrame:
    """One row for each query: primary_theme, themes, top and second score, whether to ask back, whether to filter. mode none
    routes to no theme; mode llm lays a model's answers(query_id, answer) over the words' routes, where there are any."""
    if mode == "none":
        empty = {"primary_theme": F.lit(None).cast("string"), "top_score": F.lit(0.0), "second_score": F.lit(0.0), "themes": F.array().cast("array<string>")}
        empty |= {f"preferred_{c}": F.lit(None).cast("string") for c in ("domain", "section", "platform")}
        return queries.select("query_id", *[v.alias(k) for k, v in empty.items()], F.lit(False).alias("ask_back"), F.lit(False).alias("use_filter"))
    if mode == "llm" and answers is not None:
        return routing_with_model(route(queries), answers).drop("router")
    s = theme_scores(queries).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ord")))
    at = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    out = s.groupBy("query_id").agg(
        at(1, "theme_id").alias("primary_theme"),
        at(1, "score").alias("top_score"),
        F.coalesce(at(2, "score"), F.lit(0.0)).alias("second_score"),
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "theme_id"))), lambda x: x["theme_id"]).alias("themes"),
        *[at(1, c).alias(f"preferred_{c}") for c in ("domain", "section", "platform")],
    )
    lead = F.round(F.col("top_score") - F.col("second_score"), 9)
    return out.withColumn("ask_back", (F.col("top_score") == 0) | ((F.col("second_score") != 0) & (lead < C.CLEAR_LEAD))).withColumn(
        "use_filter", (F.col("top_score") >= C.FILTER_TOP) & (lead >= C.FILTER_LEAD)
    )


def theme_id(columns: set[str]) -> Column:
    """Of columns domain, section, platform and role: the first theme that agrees in every field both sides have
    (sdk_platform stands in for an empty platform). Themes are few, so they are an expression, not a join."""
    out = None
    fields_of = {c: platform_of(columns) if c == "platform" else F.col(c) for c in ("domain", "section", "platform", "role")}
    for theme, *fields in C.THEMES:
        agrees = F.lit(True)
        for name, value in zip(("domain", "section", "platform", "role"), fields, strict=True):
            own = F.lower(F.coalesce(fields_of[name], F.lit("")))
            if value:
                agrees = agrees & ((own == "") | (own == value))
        out = F.when(agrees, theme) if out is None else out.when(agrees, theme)
    return out


def theme_of(docs: DataFrame, key: str) -> DataFrame:
    """docs(key, domain, section, platform, role) -> key, theme_id."""
    return docs.select(key, theme_id(set(docs.columns)).alias("theme_id"))


def theme_label(theme_id: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for t, label in zip(C.THEMES, C.THEME_LABELS, strict=True) for x in (t[0], label)]), theme_id)


def theme_bits(columns: set[str]) -> Column:
    """A bit for each theme whose fields the payload has all, exactly: what a theme filter lets through."""
    out = F.lit(0).cast("long")
    for i, (_, *fields) in enumerate(C.THEMES):
        named = [(c, v) for c, v in zip(("domain", "section", "platform", "role"), fields, strict=True) if v]
        if all(c in columns for c, _ in named):
            out = out + F.when(reduce(lambda a, b: a & b, [F.col(c) == v for c, v in named]), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    return out


def filter_bit(use_filter: Column, primary_theme: Column) -> Column:
    """The bit of the theme that a query is filtered by, 0 for none."""
    bits = F.create_map(*[x for i, t in enumerate(C.THEMES) for x in (F.lit(t[0]), F.lit(1 << i).cast("long"))])
    return F.when(use_filter, F.coalesce(F.try_element_at(bits, primary_theme), F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))


def routing_with_model(routes: DataFrame, answers: DataFrame) -> DataFrame:
    """routes with a column router: a model's answer(query_id, answer) that parses takes the place of
    the words' themes and scores and allows a filter from its own threshold on; others stay as they are."""
    parsed = answers.select("query_id", F.filter(parse_llm_routing(F.col("answer")), lambda x: x["theme_id"].isin(*[t[0] for t in C.THEMES])).alias("found")).where(
        F.size("found") > 0
    )
    order = F.array_sort("found", lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(0))
    parsed = parsed.select("query_id", order.alias("found"))
    at = lambda i, c: F.coalesce(F.try_element_at("found", F.lit(i))[c], F.lit(0.0) if c == "score" else F.lit(None))
    both = routes.join(parsed, "query_id", "left")
    model = F.col("found").isNotNull()
    pick = lambda new, old: F.when(model, new).otherwise(F.col(old)).alias(old)
    changed = {
        "primary_theme": pick(at(1, "theme_id"), "primary_theme"), "top_score": pick(at(1, "score"), "top_score"), "second_score": pick(at(2, "score"), "second_score"),
        "themes": pick(F.transform("found", lambda x: x["theme_id"]), "themes"), "use_filter": pick(at(1, "score") >= C.FILTER_TOP_LLM, "use_filter"),
    }
    return both.select(*[changed.get(c, F.col(c)) for c in routes.columns], F.when(model, "llm").otherwise("heuristic").alias("router"))


def parse_llm_routing(answer: Column) -> Column:
    """array<struct<theme_id, score>> from a model's answer, code fences taken off; null if it is no JSON."""
    body = F.regexp_replace(strip(answer), r"^```[A-Za-z]*\s*|\s*```$", "")
    return F.from_json(body, "array<struct<theme_id:string,score:double>>")
