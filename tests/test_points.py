import math
import random

import pytest
from pyspark.sql import functions as F

from ravelin.sources.points import REASON, Rejected, upsert_isolated, write_points
from ravelin.sources.versions import VersionedTable


class Strict:
    """Refuses batches with a bad row; forgets nothing."""

    def __init__(self, bad, kind=Rejected, flaky=0):
        self.bad, self.kind, self.flaky, self.held, self.calls = bad, kind, flaky, [], 0

    def upsert(self, rows):
        self.calls += 1
        if self.flaky:
            self.flaky -= 1
            raise ConnectionError("try again")
        if any(self.bad(r) for r in rows):
            raise self.kind("bad point")
        self.held += rows


@pytest.mark.parametrize("n, k", [(1, 0), (1, 1), (64, 1), (1000, 1), (1000, 7), (50, 50), (0, 0)])
def test_bad_rows_stand_alone_after_k_log_n_writes(n, k):
    bad = set(random.Random(n + k).sample(range(n), k))
    rows = [{"i": i} for i in range(n)]
    store = Strict(lambda r: r["i"] in bad)
    taken, refused, writes = upsert_isolated(rows, store.upsert, sleep=None)
    assert sorted(taken) == [i for i in range(n) if i not in bad] and [i for i, _ in refused] == sorted(bad)
    assert sorted(r["i"] for r in store.held) == sorted(taken) and writes == store.calls
    assert writes <= 1 + 2 * k * (1 + math.log2(max(n / k, 1) if k else 1) + 1)
    # A store that does not say so is asked three times each.
    assert upsert_isolated(rows, Strict(lambda r: r["i"] in bad, ValueError).upsert, sleep=lambda s: None)[2] <= 3 * writes


def test_passing_failures_are_waited_for():
    waits = []
    store = Strict(lambda r: False, flaky=2)
    assert upsert_isolated([{"i": 1}, {"i": 2}], store.upsert, sleep=waits.append) == ([0, 1], [], 3) and waits == [1.5, 3.0]
    taken, refused, _ = upsert_isolated([{"i": 1}, {"i": 2}], Strict(lambda r: False, flaky=9).upsert, sleep=waits.append)
    assert taken == [] and [r for _, r in refused] == ["ConnectionError: try again"] * 2


def points(spark, n, parts=4):
    return spark.range(n).select(F.concat(F.lit("p"), "id").alias("id"), F.col("id").alias("v"), F.array(F.lit(0.5)).alias("dense")).repartition(parts)


def test_refused_rows_are_put_aside(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t")
    done = write_points(points(spark, 1000), table, lambda: Strict(lambda r: r["v"] % 250 == 3), batch=100)
    assert (done.version, done.accepted, done.refused) == (1, 996, 4) and done.writes < 10 + 4 * 2 * 9
    assert sorted((r.v, r[REASON]) for r in done.rejected.collect()) == [(v, "Rejected: bad point") for v in (3, 253, 503, 753)]
    assert sorted(r.v for r in table.read().collect()) == [v for v in range(1000) if v % 250 != 3]
    again = write_points(points(spark, 300).withColumn("v", F.col("v") + 5000), table)
    assert again.refused == 0 and again.rejected.count() == 0 and table.read().count() == 998 and table.read().where("v >= 5000").count() == 300
    nothing = write_points(points(spark, 3), table, lambda: Strict(lambda r: True), pause=0)
    assert (nothing.version, nothing.accepted, nothing.refused) == (None, 0, 3)
    assert write_points(points(spark, 0), table).version is None and table.current() == 2


def test_a_failed_task_commits_nothing(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t")
    table.write(points(spark, 5))

    def opened():
        from pyspark import TaskContext

        if TaskContext.get().partitionId() == 2:
            raise RuntimeError("no connection")
        return Strict(lambda r: False)

    with pytest.raises(Exception, match="no connection"):
        write_points(points(spark, 1000), table, opened)
    assert table.current() == 0 and table.read().count() == 5 and not list((tmp_path / "t").glob("commits/*.json"))
    table.vacuum(older_than=-5)
    assert len(list((tmp_path / "t").glob("data/*/*.parquet"))) == len(table.manifest(0)["files"])
