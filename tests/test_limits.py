from pyspark.sql import functions as F

from ravelin.operators import ops
from ravelin.streaming import limits, pipelines
from tests.conftest import TESTDATA

LIMITS = ((3, 86_400), (8, 4 * 86_400))


def files(spark, tmp_path, n):
    """The first events in n files in the order of time, dense enough that limits bind."""
    events = spark.read.parquet(f"{TESTDATA}/events.parquet")
    rows = events.orderBy("ts").limit(400).withColumn("user_id", F.col("user_id") % 5).toPandas()
    folder = tmp_path / "events"
    folder.mkdir()
    for i in range(n):
        rows.iloc[i * len(rows) // n : (i + 1) * len(rows) // n].to_parquet(folder / f"{i}.parquet", coerce_timestamps="us")
    return spark.createDataFrame(rows, events.schema), folder, events.schema


def run(df, checkpoint, out, most=None):
    q = df.writeStream.format("parquet").option("checkpointLocation", str(checkpoint)).option("path", str(out)).trigger(availableNow=True).start()
    q.awaitTermination()


def decided(spark, out):
    return {r.event_id: r.ok for r in spark.read.parquet(str(out)).collect()}


def test_stream_equals_batch_over_triggers_and_a_restart(spark, tmp_path):
    batch, folder, schema = files(spark, tmp_path, 6)
    want = {r.event_id: r.ok for r in ops.rate_limit(batch, LIMITS).collect()}
    assert set(want.values()) == {True, False}
    late = folder / "5.parquet"
    kept = late.read_bytes()
    late.unlink()
    checkpoint, out = tmp_path / "cp", tmp_path / "out"
    run(limits.limited(pipelines.event_stream(spark, str(folder), schema), LIMITS), checkpoint, out)
    first = decided(spark, out)
    assert first == {i: want[i] for i in first} and len(first) < len(want)
    # The state as the checkpoint has it: accepted times within the longest window.
    held = {(r.user_id, round(r.at, 6)) for r in limits.held(spark, str(checkpoint)).collect()}
    known = batch.join(spark.createDataFrame([(i,) for i, ok in first.items() if ok], "event_id long"), "event_id")
    times = {(r.user_id, round(r.at, 6)) for r in known.select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at")).collect()}
    assert held and held <= times
    late.write_bytes(kept)
    run(limits.limited(pipelines.event_stream(spark, str(folder), schema), LIMITS), checkpoint, out)
    assert decided(spark, out) == want


def test_a_stream_goes_on_from_a_batch(spark, tmp_path):
    batch, folder, schema = files(spark, tmp_path, 2)
    want = {r.event_id: r.ok for r in ops.rate_limit(batch, LIMITS).collect()}
    before = spark.read.schema(schema).parquet(str(folder / "0.parquet"))
    done = ops.rate_limit(before, LIMITS)
    initial = limits.state_of(before, done, LIMITS)
    initial = spark.createDataFrame(initial.collect(), initial.schema)
    (folder / "0.parquet").unlink()
    run(limits.limited(pipelines.event_stream(spark, str(folder), schema), LIMITS, initial=initial), tmp_path / "cp", tmp_path / "out")
    got = decided(spark, tmp_path / "out")
    assert got == {i: want[i] for i in got} and len(got) == 200
    # Without it, users would begin anew.
    run(limits.limited(pipelines.event_stream(spark, str(folder), schema), LIMITS), tmp_path / "cp2", tmp_path / "out2")
    assert decided(spark, tmp_path / "out2") != got
