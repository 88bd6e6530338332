"""The sliding limiter with arbitrary state: list state, timers by event time, a start from a batch's state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType

from ..functions import constants as C
from ..operators.ops import SlidingLimiter
from ..shipping import ship

#: The state store that this kind of state needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Limiter(StatefulProcessor):
    """State of a user: the accepted times (seconds) within the longest window, as a list. A timer stands where the newest of
    them leaves that window; when it fires, the state goes."""

    def __init__(self, limits):
        self.limits, self.longest = limits, max(s for _, s in limits)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.accepted = handle.getListState("accepted", "at double")

    def _keep(self, times: list[float]) -> None:
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.accepted.clear()
        if times:
            self.accepted.put([(t,) for t in times])
            self.handle.registerTimer(int((max(times) + self.longest) * 1000) + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        limiter = SlidingLimiter(self.limits, sorted(t for (t,) in self.accepted.get()))
        arrived = pd.concat(list(rows)).sort_values(["at", "event_id"])  # one user's rows of one trigger
        ok = [limiter.offer(t) for t in arrived["at"]]
        self._keep(list(limiter.accepted))
        yield pd.DataFrame({"event_id": arrived["event_id"], "user_id": key[0], "ok": ok})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.accepted.clear()
        return iter(())

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._keep(sorted(float(t) for t in initialState["at"]))

    def close(self) -> None:
        return


def state_of(events: DataFrame, decided: DataFrame, limits=C.LIMITS) -> DataFrame:
    """user_id, at: what a limiter holds after a batch of events(event_id, user_id, ts) with decided(event_id, ok)."""
    longest = max(s for _, s in limits)
    accepted = events.join(decided.where("ok").select("event_id"), "event_id").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    newest = events.groupBy("user_id").agg((F.max(F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6).alias("newest"))
    return accepted.join(newest, "user_id").where(F.col("at") > F.col("newest") - longest).select("user_id", "at")


def limited(stream: DataFrame, limits=C.LIMITS, late: str = "10 minutes", initial: DataFrame | None = None) -> DataFrame:
    """stream(event_id, user_id, ts) -> event_id, user_id, ok. initial(user_id, at) are accepted times that users begin
    with in a new checkpoint. Events later than the watermark are left out."""
    spark = stream.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    out = StructType([stream.schema["event_id"], stream.schema["user_id"], StructField("ok", BooleanType())])
    timed = stream.withWatermark("ts", late).select("event_id", "user_id", "ts", (F.unix_micros("ts") / 1e6).alias("at"))
    return timed.groupBy("user_id").transformWithStateInPandas(
        Limiter(limits), outputStructType=out, outputMode="append", timeMode="EventTime", initialState=initial.groupBy("user_id") if initial is not None else None
    )


def held(spark: SparkSession, checkpoint: str) -> DataFrame:
    """user_id, at: the state of a limiter's checkpoint, read as a table."""
    read = spark.read.format("statestore").option("stateVarName", "accepted").load(checkpoint)
    return read.select(F.col("key.user_id").alias("user_id"), F.col("list_element.at").alias("at"))
