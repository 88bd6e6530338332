"""Cohort retention from bucketed tables (DataFrame functions only).

A client's start is its first click of one kind; its cohort is the week of the start, and each
click from then on falls into a period, whole weeks after it. Two states of knowledge are counted: what had
arrived by a day (0), and everything (1).

Clicks, starts and clients are written as tables with the same buckets, sorted by client, so the
two joins and the aggregation for each client run inside a bucket without an exchange. Each
bucket sums its part of the cells; only these parts move.

A client with many clicks is cut into slices of the click's own hash. Bucket and sort key is
(client, slice): its clicks spread over the buckets, and its start and its client row stand beside each
slice. Slices are sized so that MOST_SLICED clients at most have several, which bounds the
table of slices that is broadcast. A sliced client's parts meet by client and cell, a row for each slice and
cell, before they are counted as one user.

Defined cases: rows equal in all seven columns of clicks are one; a row without ts or client_id
counts for nothing; a null click_id has no delay; a null arrived_at is never known by the day; a value that
is null or not finite counts 0; clients of one id give their smallest source, null or none give the empty segment; empty clicks
give an empty result; columns other than those named are ignored. Timestamps are read as written, without a zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed, discard, materialize, release

COLUMNS = ("click_id", "ts", "arrived_at", "client_id", "kind", "value", "props")
START_KIND = "error"
#: First day that state 0 does not know.
KNOWN_BEFORE = "2024-02-01"
DAY = 86_400_000_000
PERIOD = 7 * DAY
#: Clients that may be cut into slices: a slice is no smaller than this share of the clicks.
MOST_SLICED = 10_000
#: Slices that the clicks of an average bucket would make.
SLICES_A_BUCKET = 4
CELL = ["state", "segment", "cohort", "period"]


def wall_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp's wall time."""
    second = (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return F.unix_date(F.to_date(ts)).cast("long") * DAY + (F.hour(ts) * 60 + F.minute(ts)).cast("long") * 60_000_000 + second


def _floor_div(a: Column, b: int) -> Column:
    """Whole part of a / b, down for negative a."""
    return ((a - F.pmod(a, F.lit(b))) / b).cast("long")


def events(clicks: DataFrame) -> DataFrame:
    """client_id, at (microseconds), early (known in state 0), starts, cents, spread (a hash): each different click once."""
    once = clicks.select(*COLUMNS).distinct().where("ts IS NOT NULL AND client_id IS NOT NULL")
    h = F.crc32(F.col("click_id").cast("string"))
    delay = F.when(h % 3 == 0, h % 100).otherwise(0) * DAY
    known = F.unix_date(F.lit(KNOWN_BEFORE).cast("date")).cast("long") * DAY
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    return once.select(
        "client_id",
        wall_micros(F.col("ts")).alias("at"),
        F.coalesce(wall_micros(F.col("arrived_at")) + F.coalesce(delay, F.lit(0)) < known, F.lit(False)).alias("early"),
        F.coalesce(F.col("kind") == START_KIND, F.lit(False)).alias("starts"),
        F.when(finite, F.floor(100 * F.col("value") + 0.5)).otherwise(0).cast("long").alias("cents"),
        F.xxhash64("click_id", "ts").alias("spread"),
    )


def client_starts(clicks: DataFrame) -> DataFrame:
    """client_id, start0, start1 (microseconds, null where unknown), n (clicks): a row for each client."""
    return clicks.groupBy("client_id").agg(
        F.min(F.when(F.col("starts") & F.col("early"), F.col("at"))).alias("start0"),
        F.min(F.when(F.col("starts"), F.col("at"))).alias("start1"),
        F.count(F.lit(1)).alias("n"),
    )


def tables(clicks: DataFrame, clients: DataFrame) -> list[DataFrame]:
    """The three tables, bucketed and sorted by (client_id, slice): clicks, starts(.., sliced), clients(segment)."""
    spark = clicks.sparkSession
    kind = clicks.schema["client_id"].dataType
    seen = materialize(events(clicks), "cohort-events")
    counts = materialize(client_starts(seen), "cohort-counts")
    release(spark)
    total = counts.agg(F.sum("n")).first()[0] or 0
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = max(1, -(-total // (buckets * SLICES_A_BUCKET)), -(-total // MOST_SLICED))
    # More than rows clicks each, of total: MOST_SLICED clients at most.
    hot = F.broadcast(counts.where(F.col("n") > rows).select("client_id", F.ceil(F.col("n") / rows).cast("int").alias("slices")))
    slices = F.coalesce("slices", F.lit(1))
    each = F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice")
    by = ["client_id", "slice"]
    placed = seen.join(hot, "client_id", "left").withColumn("slice", F.pmod("spread", slices).cast("int")).drop("spread", "slices", "starts")
    out = [bucketed(placed, "cohort-clicks", by)]
    discard(seen)
    known = counts.where("start1 IS NOT NULL").join(hot, "client_id", "left")
    out.append(bucketed(known.select("client_id", "start0", "start1", (slices > 1).alias("sliced"), each), "cohort-starts", by))
    segments = clients.select(F.col("client_id").cast(kind).alias("client_id"), "source").where("client_id IS NOT NULL")
    segments = segments.groupBy("client_id").agg(F.min("source").alias("segment")).join(hot, "client_id", "left")
    out.append(bucketed(segments.select("client_id", "segment", each), "cohort-clients", by))
    discard(counts)
    return out


def client_cells(clicks: DataFrame, starts: DataFrame, clients: DataFrame) -> DataFrame:
    """client_id, slice, state, segment, cohort, period, moved, sliced, cents from the three tables, bucket by bucket."""
    keys = ["client_id", "slice"]
    joined = clicks.hint("merge").join(starts.hint("merge"), keys).join(clients.hint("merge"), keys, "left")
    cohort = lambda start: _floor_div(_floor_div(F.col(start), DAY), 7)
    state = lambda k, known: F.when(known & (F.col("at") >= F.col(f"start{k}")), F.struct(F.lit(k).alias("state"), F.col(f"start{k}").alias("start")))
    each = F.explode(F.array_compact(F.array(state(0, F.col("early")), state(1, F.lit(True)))))
    moved = F.coalesce(cohort("start0") != cohort("start1"), F.lit(False))
    rows = joined.select(*keys, "sliced", F.coalesce("segment", F.lit("")).alias("segment"), moved.cast("long").alias("moved"), "at", "cents", each.alias("s"))
    return (
        rows.select(*keys, "sliced", "segment", "moved", "cents", "s.state", _floor_div(_floor_div(F.col("s.start"), DAY), 7).alias("cohort"),
                    ((F.col("at") - F.col("s.start") - F.pmod(F.col("at") - F.col("s.start"), F.lit(PERIOD))) / PERIOD).cast("long").alias("period"))
        .groupBy(*keys, *CELL, "moved", "sliced")
        .agg(F.sum("cents").alias("cents"))
    )


def cells(parts: DataFrame) -> DataFrame:
    """The retention matrix from client_cells(): parts of the buckets summed, a sliced client counted once."""
    crc = F.crc32(F.col("client_id").cast("string"))
    whole = F.when(F.col("sliced"), F.col("client_id"))
    summed = parts.groupBy(*CELL, whole.alias("whole")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(crc).alias("crc"), F.sum("moved").alias("m"), F.max(crc).alias("one_crc"), F.max("moved").alias("one_m"), F.sum("cents").alias("cents")
    )
    one = F.col("whole").isNotNull()
    return summed.groupBy(*CELL).agg(
        F.sum(F.when(one, 1).otherwise(F.col("n"))).alias("users"),
        F.sum(F.when(one, F.col("one_crc")).otherwise(F.col("crc"))).alias("users_crc32"),
        F.sum(F.when(one, F.col("one_m")).otherwise(F.col("m"))).alias("moved"),
        F.sum("cents").alias("cents"),
    )


def retention(clicks: DataFrame, clients: DataFrame) -> DataFrame:
    """state, segment, cohort, period, users, users_crc32, moved, cents: a row for each cell that is not empty."""
    written = tables(clicks, clients)
    out = materialize(cells(client_cells(*written)), "cohort-cells")
    discard(*written)
    return out


#: CRC-32 by its table of 256 values, made from the polynomial (a fixed value).
_CRC_TABLE = (
    "(SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), "
    "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"
)


def _crc(text: str) -> str:
    return (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), "
        "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
    )


ORACLE = f"""
WITH crc AS {_CRC_TABLE},
once AS (SELECT DISTINCT click_id, ts, arrived_at, client_id, kind, value, props FROM clicks),
hashed AS (SELECT *, {_crc("click_id::VARCHAR")} AS h FROM once, crc WHERE ts IS NOT NULL AND client_id IS NOT NULL),
known AS (
  SELECT client_id, epoch_us(ts) AS us, kind, CASE WHEN value IS NULL THEN 0 ELSE floor(100 * value + 0.5)::BIGINT END AS cents,
    coalesce(arrived_at + to_days(CASE WHEN h % 3 = 0 THEN (h % 100)::INTEGER ELSE 0 END) < TIMESTAMP '{KNOWN_BEFORE} 00:00:00', false) AS early
  FROM hashed),
states AS (SELECT 0 AS state, * FROM known WHERE early UNION ALL SELECT 1 AS state, * FROM known),
starts AS (SELECT state, client_id, min(us) AS begun, floor(floor(min(us) / {DAY}) / 7)::BIGINT AS cohort FROM states WHERE kind = '{START_KIND}' GROUP BY ALL),
people AS (
  SELECT s.*, {_crc("s.client_id::VARCHAR")} AS crc32, (SELECT coalesce(min(c.source), '') FROM clients c WHERE c.client_id = s.client_id) AS segment,
    EXISTS (SELECT 1 FROM starts o WHERE o.client_id = s.client_id AND o.cohort <> s.cohort) AS moves
  FROM starts s, crc),
placed AS (
  SELECT p.state, p.segment, p.cohort, floor((k.us - p.begun) / {PERIOD})::BIGINT AS period, p.client_id, p.crc32, p.moves, sum(k.cents) AS cents
  FROM people p JOIN states k ON k.state = p.state AND k.client_id = p.client_id AND k.us >= p.begun GROUP BY ALL)
SELECT state, segment, cohort, period, count(*) AS users, sum(crc32)::BIGINT AS users_crc32, count(*) FILTER (WHERE moves) AS moved, sum(cents)::BIGINT AS cents
FROM placed GROUP BY ALL
"""
