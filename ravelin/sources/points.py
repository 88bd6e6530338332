"""Writing points to a store that may refuse some: tries, halving, and commits by partition.

    written = write_points(df, table, load=lambda: client)

Each task upserts its rows into the store in batches. A batch that fails is tried again, and after TRIES
failures cut in half, and so on, until the rows that the store refuses stand alone: k bad rows among n cost
some k log n writes. A store that says Rejected is not asked again with the same rows.

What a task wrote it also keeps in files beside the table, accepted and refused rows apart, and names
them in its commit message. Once all tasks have committed, one commit file names the files of the whole write;
only then do accepted rows enter the table, as a new version. A task that fails commits
nothing, and its files are taken by the table's clean-up. The store itself should take a point again
as no change, since a task that failed after some of its writes is run anew.
"""

from __future__ import annotations

import dataclasses
import json
import time
import uuid
from collections.abc import Callable
from typing import Protocol

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..shipping import ship
from .folder import _opened
from .versions import VersionedTable

BATCH = 500
TRIES = 3
#: Seconds before the second try; the third waits twice as long.
PAUSE = 1.5
REASON = "rejected_because"


class Rejected(Exception):
    """The store will not take these rows, however often it is asked."""


class Store(Protocol):
    """Opened once in a task."""

    def upsert(self, rows: list[dict]) -> None: ...


class Anything:
    """A store that keeps nothing and takes all: the rows go to the table alone."""

    def upsert(self, rows: list[dict]) -> None:
        return


def upsert_isolated(rows: list[dict], upsert: Callable[[list[dict]], None], tries: int = TRIES, pause: float = PAUSE, sleep=time.sleep) -> tuple[list[int], list[tuple[int, str]], int]:
    """(places in rows that were taken, (place, reason) of those that were not, writes)."""
    taken, refused, writes = [], [], 0
    left = [(0, len(rows))] if rows else []
    while left:
        a, b = left.pop()
        for n in range(tries):
            writes += 1
            try:
                upsert(rows[a:b])
                taken += range(a, b)
                break
            except Exception as e:  # whatever the client raises
                if n + 1 == tries or isinstance(e, Rejected):
                    if b - a == 1:
                        refused.append((a, f"{type(e).__name__}: {e}"))
                    else:
                        middle = (a + b) // 2
                        left += [(middle, b), (a, middle)]
                    break
                sleep(pause * (n + 1))
    return taken, refused, writes


@dataclasses.dataclass
class PartWritten(ds.WriterCommitMessage):
    accepted: list[str]
    refused: list[str]
    n_accepted: int
    n_refused: int
    writes: int


class PointsWriter(ds.DataSourceArrowWriter):
    def __init__(self, path: str, job: str, load: Callable[[], Store], batch: int, tries: int, pause: float):
        self.path, self.job, self.load, self.batch, self.tries, self.pause = path, job, load, batch, tries, pause

    def write(self, iterator):
        system, base = _opened(self.path)
        store, part = self.load(), uuid.uuid4().hex
        out = PartWritten([], [], 0, 0, 0)
        writers: dict[str, tuple[pq.ParquetWriter, str]] = {}

        def keep(kind: str, rows: pa.Table) -> None:
            if rows.num_rows:
                if kind not in writers:
                    name = f"data/{self.job}/{kind}-{part}.parquet"
                    system.create_dir(f"{base}/data/{self.job}")
                    writers[kind] = (pq.ParquetWriter(f"{base}/{name}", rows.schema, filesystem=system, compression="zstd"), name)
                writers[kind][0].write_table(rows)

        for batch in iterator:
            for at in range(0, batch.num_rows, self.batch):
                some = pa.Table.from_batches([batch.slice(at, self.batch)])
                taken, refused, writes = upsert_isolated(some.to_pylist(), store.upsert, self.tries, self.pause)
                keep("accepted", some.take(pa.array(sorted(taken), pa.int64())))
                bad = some.take(pa.array([i for i, _ in refused], pa.int64()))
                keep("refused", bad.append_column(REASON, pa.array([r for _, r in refused], pa.string())))
                out.n_accepted, out.n_refused, out.writes = out.n_accepted + len(taken), out.n_refused + len(refused), out.writes + writes
        for kind, (writer, name) in writers.items():
            writer.close()
            getattr(out, kind).append(name)
        return out

    def commit(self, messages):
        system, base = _opened(self.path)
        parts = [dataclasses.asdict(m) for m in messages if m]
        system.create_dir(f"{base}/commits")
        with system.open_output_stream(f"{base}/commits/.{self.job}") as f:
            f.write(json.dumps(parts).encode())
        system.move(f"{base}/commits/.{self.job}", f"{base}/commits/{self.job}.json")

    def abort(self, messages):
        system, base = _opened(self.path)
        for m in messages:
            for name in [*m.accepted, *m.refused] if m else []:
                system.delete_file(f"{base}/{name}")


def sink(load: Callable[[], Store], batch: int = BATCH, tries: int = TRIES, pause: float = PAUSE) -> type[ds.DataSource]:
    """A write format over a store, to be registered with the session; options: path, job (a name for the write)."""

    class Points(ds.DataSource):
        @classmethod
        def name(cls):
            return "ravelin_points"

        def writer(self, schema, overwrite):
            return PointsWriter(self.options["path"], self.options["job"], load, batch, tries, pause)

    return Points


@dataclasses.dataclass
class Written:
    """What a write did: the version made (None if nothing was accepted), counts, and the refused rows with their reason."""

    version: int | None
    accepted: int
    refused: int
    writes: int
    rejected: DataFrame


def write_points(df: DataFrame, table: VersionedTable, load: Callable[[], Store] = Anything, key: str = "id", batch: int = BATCH, tries: int = TRIES, pause: float = PAUSE) -> Written:
    """df upserted into the store that load opens and, as far as the store took it, into the table by key."""
    spark, job = df.sparkSession, uuid.uuid4().hex
    ship(spark)
    spark.dataSource.register(sink(load, batch, tries, pause))
    df.write.format("ravelin_points").mode("append").option("job", job).save(table.path)
    system, base = _opened(table.path)
    with system.open_input_stream(f"{base}/commits/{job}.json") as f:
        parts = json.loads(f.read())  # a few names and numbers for each task
    total = lambda n: sum(p[n] for p in parts)
    paths = lambda kind: [f"{table.path}/{f}" for p in parts for f in p[kind]]
    read = lambda kind, schema: spark.read.schema(schema).parquet(*paths(kind)) if paths(kind) else spark.createDataFrame([], schema)
    version = table.upsert(read("accepted", df.schema), key)[0] if total("n_accepted") else None
    rejected = read("refused", StructType([*df.schema.fields, StructField(REASON, StringType())]))
    return Written(version, total("n_accepted"), total("n_refused"), total("writes"), rejected.withColumn(REASON, F.col(REASON)))
