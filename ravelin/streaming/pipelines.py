"""Structured Streaming forms: limiter and breaker with state, metric windows, incremental ingestion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import constants as C
from ..operators.ops import Breaker, SlidingLimiter
from ..shipping import ship


def event_stream(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream; time stamps without zone become UTC instants, as watermarks need."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_metrics(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes", *keys: str, slide: str | None = None) -> DataFrame:
    """n, total and most of value by window, a new one every slide (width, if none is given); rows later than the watermark are left out."""
    return (
        stream.withWatermark("ts", late)
        .groupBy(F.window("ts", width, slide).alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("most"))
        .select(F.col("w.start").alias("start"), *keys, "n", "total", "most")
    )


def deduplicated(stream: DataFrame, key: str, late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def limited(stream: DataFrame, limits=C.LIMITS, late: str = "10 minutes") -> DataFrame:
    """stream(event_id, user_id, ts) with ok. State: a user's accepted times of the longest window;
    it goes once the watermark has passed that window, and events later than the watermark are left out."""
    ship(stream.sparkSession)
    longest = max(s for _, s in limits)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        limiter = SlidingLimiter(limits, state.get[0] if state.exists else ())
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        ok = [limiter.offer(t) for t in rows["at"]]
        state.update((list(limiter.accepted),))
        state.setTimeoutTimestamp(int((max(rows["at"].max(), state.getCurrentWatermarkMs() / 1000) + longest) * 1000) + 1)
        yield pd.DataFrame({"event_id": rows["event_id"], "user_id": key[0], "ok": ok})

    timed = stream.withWatermark("ts", late).select("event_id", "user_id", "ts", (F.unix_micros("ts") / 1e6).alias("at"))
    return timed.groupBy("user_id").applyInPandasWithState(
        step, "event_id long, user_id long, ok boolean", "accepted array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )


def broken(stream: DataFrame, failures: int, pause: float) -> DataFrame:
    """stream(event_id, service, ts, ok) with passed and the breaker's state after each."""
    ship(stream.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        breaker = Breaker(failures, pause, *(state.get if state.exists else ()))
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        out = [(breaker.offer(t, bool(ok)), breaker.state) for t, ok in zip(rows["at"], rows["good"], strict=True)]
        state.update((breaker.state, breaker.count, float(breaker.since)))
        yield pd.DataFrame({"event_id": rows["event_id"], "service": key[0], "passed": [x[0] for x in out], "state": [x[1] for x in out]})

    timed = stream.select("event_id", "service", (F.unix_micros("ts") / 1e6).alias("at"), F.col("ok").alias("good"))
    return timed.groupBy("service").applyInPandasWithState(
        step, "event_id long, service string, passed boolean, state string", "state string, count int, since double", "append", GroupStateTimeout.NoTimeout
    )


def ingest(stream: DataFrame, checkpoint: str, upsert: Callable[[DataFrame, int], None]):
    """Each new file once, through an idempotent upsert; ends when what is there has been read."""
    query = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
