"""Answer quality: heuristic scores, feedback, statistics, trends, correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import any_of, words

DIGITS = 9


def _set(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def _without_stops(s: Column) -> Column:
    return F.array_except(s, F.array(*[F.lit(w) for w in C.STOP_WORDS]))


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _if(condition: Column, value: float) -> Column:
    return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))


def answer_relevancy(response: Column, low: Column, own: Column, asked: Column) -> Column:
    n = F.length(response)
    shared = F.size(F.array_intersect(asked, own))
    s = F.lit(0.3) + F.when(n > 100, 0.2).when(n > 50, 0.1).otherwise(0.0)
    s = s + F.when(F.size(asked) > 0, F.least(F.lit(0.4), shared / F.size(asked) * F.lit(0.8))).otherwise(0.0)
    s = s - _if(any_of(low, C.EVASIVE), 0.2)
    return F.round(_clamp(s + _if(any_of(low, C.DOMAIN_ANSWER), 0.1)), DIGITS)


CALENDAR = r"(^|[^\p{L}\p{N}_])(" + "|".join(C.CALENDAR) + r")([^\p{L}\p{N}_]|$)"


def faithfulness(response: Column, low: Column, own: Column, split: Column) -> Column:
    """low and own: the response in lower case and its words; split: of each context its length and words."""
    total = F.aggregate(split, F.lit(0), lambda a, c: a + F.size(F.array_distinct(c["words"])))
    matched = F.aggregate(split, F.lit(0), lambda a, c: a + F.size(F.array_intersect(c["words"], own)))

    def quoted(c: Column) -> Column:
        w = c["words"]
        starts = F.when(F.size(w) >= 5, F.sequence(F.lit(1), F.size(w) - 4)).otherwise(F.array().cast("array<int>"))
        return (c["n"] > 10) & F.exists(starts, lambda i: F.contains(low, F.array_join(F.slice(w, i, 5), " ")))

    used = F.size(F.filter(split, quoted))
    s = F.lit(0.3) + _if(F.length(response) > 100, 0.1)
    s = s + F.when(total > 0, F.least(F.lit(0.4), matched / total * F.lit(2.0))).otherwise(0.0)
    s = s + F.when(used > 0, F.least(F.lit(0.2), used * F.lit(0.1))).otherwise(0.0)
    s = s + _if(response.rlike("[0-9]"), 0.05) + _if(low.rlike(CALENDAR), 0.05) - _if(any_of(low, C.EVASIVE_FAITH), 0.2)
    return F.when(F.length(response) < 20, F.lit(0.1)).otherwise(F.round(_clamp(s), DIGITS))


def context_precision(asked: Column, split: Column) -> Column:
    """asked: the query's words without stop words; split as above."""
    n = F.size(split)

    def likeness(c: Column) -> Column:
        both = F.size(F.array_intersect(asked, c["words"]))
        return both / (F.size(asked) + F.size(_without_stops(c["words"])) - both)

    each = F.transform(split, likeness)
    base = F.lit(0.4) + F.when(n >= 5, 0.2).when(n >= 3, 0.15).otherwise(0.1)
    mean = F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / n
    relevant = F.size(F.filter(each, lambda x: x > 0.1))
    s = base + F.least(F.lit(0.3), mean * F.lit(3.0)) + F.when(relevant > 0, F.least(F.lit(0.1), relevant / n * F.lit(0.2))).otherwise(0.0)
    return F.when(split.isNull() | (n == 0), F.lit(0.0)).when(F.size(asked) == 0, F.round(base, DIGITS)).otherwise(
        F.round(F.least(F.lit(1.0), s), DIGITS)
    )


def score(interactions: DataFrame) -> DataFrame:
    """interactions(query, response, contexts) with the three scores and their mean."""
    names = interactions.columns
    each = F.transform("contexts", lambda c: F.struct(F.length(c).alias("n"), words(F.lower(c)).alias("words")))
    once = F.struct(F.lower("response").alias("low"), _set(F.col("response")).alias("own"), _without_stops(_set(F.col("query"))).alias("asked"), each.alias("split"))
    # Behind a generator texts are split once; as plain expressions they would be again wherever they are used.
    held = interactions.select(*names, F.explode(F.array(once)).alias("__once"))
    low, own, asked, split = (F.col(f"__once.{c}") for c in ("low", "own", "asked", "split"))
    out = held.select(
        *names,
        faithfulness(F.col("response"), low, own, split).alias("faithfulness"),
        context_precision(asked, split).alias("context_precision"),
        answer_relevancy(F.col("response"), low, own, asked).alias("answer_relevancy"),
    )
    return out.withColumn("overall", F.round((F.col("faithfulness") + F.col("context_precision") + F.col("answer_relevancy")) / 3, DIGITS))


SCORES = ("faithfulness", "context_precision", "answer_relevancy", "overall")


def _summary() -> list[Column]:
    given = F.count("feedback")
    positive = F.count_if(F.col("feedback") == "positive")
    return [
        F.count(F.lit(1)).alias("n"),
        given.alias("n_feedback"),
        positive.alias("n_positive"),
        F.count_if(F.col("feedback") == "negative").alias("n_negative"),
        F.when(given > 0, F.round(positive * 100.0 / given, 6)).otherwise(0.0).alias("satisfaction"),
        *[F.coalesce(F.round(F.avg(s), 6), F.lit(0.0)).alias(f"avg_{s}") for s in SCORES],
    ]


def statistics(interactions: DataFrame, last_n: int | None = 100, since: Column | None = None) -> DataFrame:
    """Over the last_n newest rows, or over those from since on."""
    rows = interactions.where(F.col("created_at") >= since) if since is not None else interactions
    if since is None and last_n is not None:
        rows = rows.orderBy(F.desc("created_at"), F.desc("interaction_id")).limit(last_n)
    return rows.agg(*_summary())


def recent(interactions: DataFrame, n: int) -> DataFrame:
    return interactions.orderBy(F.desc("created_at"), F.desc("interaction_id")).limit(n)


def trends(interactions: DataFrame) -> DataFrame:
    return interactions.groupBy(F.to_date("created_at").alias("day")).agg(*_summary())


def correlation(interactions: DataFrame) -> DataFrame:
    """metric, correlation with feedback as 1 or -1, strength."""
    vote = F.when(F.col("feedback") == "positive", 1.0).when(F.col("feedback") == "negative", -1.0)
    # One pass: the four correlations are columns first, rows after.
    wide = interactions.withColumn("vote", vote).where("vote IS NOT NULL").agg(*[F.corr(s, "vote").alias(s) for s in SCORES])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(s).alias("metric"), F.round(F.nanvl(F.col(s), F.lit(None)), 6).alias("correlation")) for s in SCORES])).alias("x")).select("x.*")
    size = F.abs("correlation")
    return long.withColumn("strength", F.when(size >= 0.7, "strong").when(size >= 0.4, "moderate").otherwise("weak"))


def apply_feedback(interactions: DataFrame, feedback: DataFrame) -> DataFrame:
    """feedback(interaction_id, feedback, given_at): the latest valid one replaces what was there."""
    valid = feedback.where(F.col("feedback").isin("positive", "negative"))
    newest = (
        valid.withColumn("n", F.row_number().over(Window.partitionBy("interaction_id").orderBy(F.desc("given_at"), "feedback")))
        .where("n = 1")
        .select("interaction_id", F.col("feedback").alias("fresh"))
    )
    return interactions.join(newest, "interaction_id", "left").withColumn("feedback", F.coalesce("fresh", "feedback")).drop("fresh")


def sampled(interactions: DataFrame, rate: float) -> DataFrame:
    """A share of the rows, always the same ones (by hash of the id)."""
    return interactions.where(F.pmod(F.xxhash64("interaction_id"), F.lit(1_000_000)) < int(rate * 1_000_000))
