"""Operational analytics: metrics, histograms, windows, risk, limits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..shipping import ship


def histogram(df: DataFrame, value: str, labels: list[str], buckets=C.BUCKETS) -> DataFrame:
    """Cumulative buckets: labels, le, n. One pass counts all bounds, then they become rows."""
    counts = df.groupBy(*labels).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(buckets)], F.count(value).alias("inf"))
    each = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(buckets)]
    each.append(F.struct(F.lit("+Inf").alias("le"), F.col("inf").alias("n")))
    return counts.select(*labels, F.explode(F.array(*each)).alias("x")).select(*labels, "x.*")


def metric_windows(events: DataFrame, width: str, *keys: str) -> DataFrame:
    """Tumbling windows over ts: n, sum, max, mean of value."""
    return (
        events.groupBy(F.window("ts", width).alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"))
        .select(F.col("w.start").alias("start"), *keys, "n", "total", "most", "mean")
    )


def rates(windows: DataFrame, *keys: str) -> DataFrame:
    """Change of n against the window before, of the same keys."""
    w = Window.partitionBy(*keys).orderBy("start")
    return windows.withColumn("change", F.col("n") - F.lag("n").over(w))


def ratio(windows: DataFrame, part: Column, whole: Column) -> Column:
    return F.when(F.sum(whole) > 0, F.round(F.sum(part) / F.sum(whole), 6)).otherwise(0.0)


def risk_last_hour(events: DataFrame, risk: Column) -> DataFrame:
    """Each event with its user's risk summed over the hour up to it."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return events.withColumn("risk_hour", F.sum(risk).over(w))


def security_statistics(events: DataFrame, risk: Column, as_of: Column, blocked: DataFrame, threshold: int = 10) -> DataFrame:
    recent = F.when(F.col("ts") >= as_of - F.expr("INTERVAL 1 HOUR"), risk).otherwise(0)
    users = events.groupBy("user_id").agg(F.sum(recent).alias("risk"))
    return users.agg(F.count(F.lit(1)).alias("total_users"), F.count_if(F.col("risk") > threshold).alias("high_risk_users")).crossJoin(
        blocked.agg(F.countDistinct("user_id").alias("blocked_users"))
    )


class SlidingLimiter:
    """Accepts while fewer than n accepted requests lie within each window (older than the window: strictly greater)."""

    def __init__(self, limits=C.LIMITS, accepted=()):
        self.limits, self.accepted = limits, list(accepted)

    def offer(self, ts: float) -> bool:
        longest = max(s for _, s in self.limits)
        self.accepted = [t for t in self.accepted if not ts - t > longest]
        if any(sum(not ts - t > s for t in self.accepted) >= n for n, s in self.limits):
            return False
        self.accepted.append(ts)
        return True


class Breaker:
    """closed, open, half_open: opens at n failures in a row, tries again after a pause."""

    def __init__(self, failures: int, pause: float, state: str = "closed", count: int = 0, since: float = 0.0):
        self.failures, self.pause, self.state, self.count, self.since = failures, pause, state, count, since

    def offer(self, ts: float, ok: bool) -> bool:
        """Whether the call goes through; its outcome moves the state."""
        if self.state == "open":
            if ts - self.since < self.pause:
                return False
            self.state = "half_open"
        if ok:
            self.state, self.count = "closed", 0
        else:
            self.count += 1
            if self.state == "half_open" or self.count >= self.failures:
                self.state, self.since = "open", ts
        return True


def rate_limit(events: DataFrame, limits=C.LIMITS) -> DataFrame:
    """events(event_id, user_id, ts) with ok. Rejected requests do not count, so each decision
    depends on those before: users are replayed in (ts, event_id) order.

    A user's events arrive as sorted batches and only the accepted times of the longest window are kept."""
    ship(events.sparkSession)

    def replay(batches):
        user, limiter = None, None
        for pdf in batches:
            ok = []
            for uid, ts in zip(pdf["user_id"], pdf["at"], strict=True):
                if uid != user or limiter is None:
                    user, limiter = uid, SlidingLimiter(limits)
                ok.append(limiter.offer(ts))
            yield pd.DataFrame({"event_id": pdf["event_id"], "user_id": pdf["user_id"], "ok": ok})

    timed = events.select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    # Sorting whole users into one task each lets a task stream through any number of events.
    ordered = timed.repartition("user_id").sortWithinPartitions("user_id", "at", "event_id")
    return ordered.mapInPandas(replay, "event_id long, user_id long, ok boolean")


def circuit(events: DataFrame, failures: int, pause: float) -> DataFrame:
    """events(event_id, service, ts, ok) with passed and the state after each."""
    ship(events.sparkSession)

    def replay(batches):
        service, breaker = None, None
        for pdf in batches:
            out = []
            for s, ts, ok in zip(pdf["service"], pdf["at"], pdf["good"], strict=True):
                if s != service or breaker is None:
                    service, breaker = s, Breaker(failures, pause)
                out.append((breaker.offer(ts, bool(ok)), breaker.state))
            yield pd.DataFrame({"event_id": pdf["event_id"], "service": pdf["service"], "passed": [x[0] for x in out], "state": [x[1] for x in out]})

    timed = events.select("event_id", "service", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("ok").alias("good"))
    return timed.repartition("service").sortWithinPartitions("service", "at", "event_id").mapInPandas(
        replay, "event_id long, service string, passed boolean, state string"
    )


def cache_replay(lookups: DataFrame, ttl: float) -> DataFrame:
    """lookups(event_id, key, ts) with hit: whether the key was stored within ttl seconds before. A
    miss stores it; a hit does not renew it, so each answer depends on those before."""
    ship(lookups.sparkSession)

    def replay(batches):
        key, stored = None, None
        for pdf in batches:
            hits = []
            for k, ts in zip(pdf["key"], pdf["at"], strict=True):
                if k != key:
                    key, stored = k, None
                hit = stored is not None and ts - stored < ttl
                hits.append(hit)
                if not hit:
                    stored = ts
            yield pd.DataFrame({"event_id": pdf["event_id"], "hit": hits})

    timed = lookups.select("event_id", F.col("key").cast("string").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return timed.repartition("key").sortWithinPartitions("key", "at", "event_id").mapInPandas(replay, "event_id long, hit boolean")


class TtlCache:
    """Keys with the times they were stored. An entry older than ttl is no hit; a key stored into a full
    cache first drives out the share of it that was stored first."""

    def __init__(self, most: int, ttl: float, share: float = 0.2):
        self.most, self.ttl, self.share = most, ttl, share
        self.stored: dict[str, float] = {}

    def lookup(self, key: str, at: float) -> bool:
        """Whether key is a hit at that time; a miss stores it."""
        if key in self.stored and at - self.stored[key] < self.ttl:
            return True
        self.stored.pop(key, None)
        if len(self.stored) >= self.most:
            for old in sorted(self.stored, key=self.stored.get)[: max(1, int(self.most * self.share))]:
                del self.stored[old]
        self.stored[key] = at
        return False


def bounded_cache_replay(lookups: DataFrame, node: str, most: int, ttl: float) -> DataFrame:
    """lookups(event_id, node, key, ts) with hit, for a cache of at most most entries on each node. The
    entries of a node depend on each other, so a node is one task; its memory is that of its cache."""
    ship(lookups.sparkSession)

    def replay(batches):
        owner, cache = None, None
        for pdf in batches:
            hits = []
            for n, k, at in zip(pdf["node"], pdf["key"], pdf["at"], strict=True):
                if cache is None or n != owner:
                    owner, cache = n, TtlCache(most, ttl)
                hits.append(cache.lookup(k, at))
            yield pd.DataFrame({"event_id": pdf["event_id"], "hit": hits})

    timed = lookups.select("event_id", F.col(node).cast("string").alias("node"), F.col("key").cast("string").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return timed.repartition("node").sortWithinPartitions("node", "at", "event_id").mapInPandas(replay, "event_id long, hit boolean")


def max_over_time(samples: DataFrame, value: str, seconds: int, *labels: str) -> DataFrame:
    """samples(ts, value, labels) with most: the largest value of the same labels in the last seconds."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return samples.withColumn("most", F.max(value).over(Window.partitionBy(*labels).orderBy(at).rangeBetween(-seconds * 1_000_000, 0)))


def range_over_time(samples: DataFrame, value: str, width: int, step: int, *labels: str, order: tuple[str, ...] = ()) -> DataFrame:
    """samples(ts, value, labels) at every multiple of step seconds, over the width seconds before it (the end not included):
    labels, at, n, total, mean, least, most, last, increase, rate. width is a multiple of step.

    increase is the growth of a counter from the window's first sample to its last, where a fall is a restart from zero; it
    is not stretched to the window's bounds. rate is increase by second. order decides between samples of one time.
    Samples without ts or value are left out; null labels are a series of their own; windows without samples have no row.

    Samples meet in panes of one step; a pane is one row, and windows and the growth between panes are made of these, so a series that
    holds a third of all rows is spread over as many tasks as it has panes."""
    if step <= 0 or width % step:
        raise ValueError("width must be a multiple of step")
    grown = lambda now, before: F.when(now >= before, now - before).otherwise(now)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = samples.where(F.col("ts").isNotNull() & F.col(value).isNotNull()).select(
        *labels, F.floor(at / (step * 1_000_000)).cast("long").alias("_pane"), F.struct(at.alias("at"), *order).alias("_at"), F.col(value).cast("double").alias("_v")
    )
    within = Window.partitionBy(*labels, "_pane").orderBy("_at")
    panes = rows.withColumn("_rise", grown(F.col("_v"), F.lag("_v").over(within))).withColumn("_rise", F.when(F.row_number().over(within) > 1, F.col("_rise")).otherwise(0.0))
    panes = panes.groupBy(*labels, "_pane").agg(
        F.count("_v").alias("n"), F.sum("_v").alias("total"), F.min("_v").alias("least"), F.max("_v").alias("most"),
        F.min_by("_v", "_at").alias("_first"), F.max_by("_v", "_at").alias("_last"), F.sum("_rise").alias("_inside"),
    )
    before = F.lag("_last").over(Window.partitionBy(*labels).orderBy("_pane"))
    panes = panes.withColumn("_between", F.when(before.isNull(), 0.0).otherwise(grown(F.col("_first"), before)))
    ends = F.explode(F.sequence(F.col("_pane") + 1, F.col("_pane") + width // step)).alias("_end")
    windows = panes.select("*", ends).groupBy(*labels, "_end").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"), F.max_by("_last", "_pane").alias("last"),
        # The growth into the window's first pane belongs to what lies before the window.
        (F.sum("_inside") + F.sum("_between") - F.min_by("_between", "_pane")).alias("increase"),
    )
    end = F.timestamp_micros(F.col("_end") * (step * 1_000_000)).cast(samples.schema["ts"].dataType)
    return windows.select(*labels, end.alias("at"), "n", "total", (F.col("total") / F.col("n")).alias("mean"), "least", "most", "last", "increase", (F.col("increase") / width).alias("rate"))


def histogram_quantile(buckets: DataFrame, q: float, *labels: str) -> DataFrame:
    """buckets(labels, le, n) cumulative as histogram() gives them -> labels, quantile: linear within the
    bucket that reaches the rank, the last finite bound beyond it, null without observations."""
    bound = F.when(F.col("le") == "+Inf", F.lit(float("inf"))).otherwise(F.col("le").cast("double"))
    rows = F.sort_array(F.collect_list(F.struct(bound.alias("le"), F.col("n").cast("double").alias("n"))))  # one for each bound
    each = buckets.groupBy(*labels).agg(rows.alias("b"), F.max("n").alias("total"))
    rank = F.col("total") * F.lit(q)
    each = each.withColumn("i", F.array_position(F.transform("b", lambda x: x["n"] >= rank), True).cast("int"))
    at = lambda k, c: F.coalesce(F.get("b", k)[c], F.lit(0.0))
    low, high = at(F.col("i") - 2, "le"), at(F.col("i") - 1, "le")
    under, inside = at(F.col("i") - 2, "n"), at(F.col("i") - 1, "n") - at(F.col("i") - 2, "n")
    value = F.when(high == float("inf"), low).when(inside > 0, low + (high - low) * (rank - under) / inside).otherwise(high)
    return each.select(*labels, F.when(F.col("total") > 0, F.round(value, 9)).alias("quantile"))


def stage_shares(timings: DataFrame) -> DataFrame:
    """timings(stage, seconds, docs, chunks) -> seconds, share of all, documents and chunks a second by stage."""
    total = F.sum("seconds").over(Window.partitionBy())
    each = timings.groupBy("stage").agg(F.sum("seconds").alias("seconds"), F.sum("docs").alias("docs"), F.sum("chunks").alias("chunks"))
    return each.select(
        "stage", F.round("seconds", 6).alias("seconds"), F.round(F.col("seconds") / total, 6).alias("share"),
        F.round(F.col("docs") / F.col("seconds"), 4).alias("docs_s"), F.round(F.col("chunks") / F.col("seconds"), 4).alias("chunks_s"),
    )


def sessions(events: DataFrame, gap: str) -> DataFrame:
    return (
        events.groupBy("user_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    )
