"""Cuts of lineage: tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where the session names none and all
    runs on one machine (tests) is a temporary one chosen; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = os.path.join(tempfile.gettempdir(), "ravelin-shared")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back. The plan above it
    starts from files, so a lost executor costs a re-read and no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ravelin-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._ravelin_path = path
    return back


def bucketed(df: DataFrame, name: str, by: list[str], buckets: int | None = None, sort: list[str] | None = None) -> DataFrame:
    """Write df as a table of the catalog, bucketed and sorted by the columns by (sorted by sort if
    given), and read it back: one file a bucket, in the shared folder. Tables with the same
    buckets are joined on by, and aggregated over more than by, without an exchange."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ident = uuid.uuid4().hex
    path, table = f"{shared_dir(spark)}/ravelin-{name}-{ident}", f"ravelin_{name.replace('-', '_')}_{ident}"
    df.repartition(n, *by).write.option("path", path).option("compression", "zstd").bucketBy(n, *by).sortBy(*(sort or by)).saveAsTable(table)
    _written.append((spark, path))
    back = spark.table(table)
    back._ravelin_path, back._ravelin_table = path, table
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() or bucketed() wrote, once everything read from them is written itself."""
    for df in tables:
        entry = (df.sparkSession, df._ravelin_path)
        if entry in _written:
            _written.remove(entry)
            if hasattr(df, "_ravelin_table"):
                df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._ravelin_table}")
            _delete(*entry)


def written_so_far() -> int:
    """A mark for discard_since()."""
    return len(_written)


def discard_since(mark: int, *keep: DataFrame) -> None:
    """Delete the tables written since the mark but for those in keep. Only for steps whose result is
    written itself, or read from keep alone."""
    paths = {df._ravelin_path for df in keep}
    for entry in [x for x in _written[mark:] if x[1] not in paths]:
        _written.remove(entry)
        _delete(*entry)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_materialized() -> None:
    """Delete what materialize() wrote; also runs when the driver ends."""
    while _written:
        try:
            _delete(*_written.pop())
        except Exception:  # the session may be gone by then
            return


atexit.register(drop_materialized)
