"""Sinks: partitioned query log, index table with upsert, state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import index


def log_partitions(records: DataFrame, ts: str = "ts") -> DataFrame:
    return records.withColumn("dt", F.date_format(ts, "yyyy-MM-dd"))


def write_query_log(records: DataFrame, path: str, ts: str = "ts") -> None:
    """JSON lines, a folder for each UTC day, appended."""
    log_partitions(records, ts).write.mode("append").partitionBy("dt").json(path)


def write_index(points: DataFrame, path: str, *partitions: str) -> None:
    """The index table. Partition columns prune scans by metadata; ids are clustered inside files."""
    points.sortWithinPartitions("id").write.mode("overwrite").partitionBy(*partitions).parquet(path)


def write_bucketed(points: DataFrame, name: str, path: str, key: str = "doc_id", within: str = "chunk_index", buckets: int = 64, blooms: tuple[str, ...] = ("id",)) -> DataFrame:
    """The index as a table of the catalog, bucketed by key and sorted by (key, within): chunks of a document lie together, and
    tables with the same buckets meet without an exchange. A scan for one document reads one bucket if
    spark.sql.sources.bucketing.autoBucketedScan.enabled is off. Each file gets bloom filters for the columns in blooms."""
    writer = points.repartition(buckets, key).write.mode("overwrite").option("path", path).option("compression", "zstd")
    for column in blooms:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.bucketBy(buckets, key).sortBy(key, within).saveAsTable(name)
    return points.sparkSession.table(name)


def clear(points: DataFrame, path: str) -> None:
    """An empty table with the same columns."""
    points.limit(0).write.mode("overwrite").parquet(path)


def upsert_index(current: DataFrame, fresh: DataFrame, path: str) -> DataFrame:
    """Writes the merged table to a new path (the old one stays readable until it is swapped) and returns the quarantined rows."""
    merged, bad = index.upsert(current, fresh, good=F.col("id").isNotNull() & (F.length(F.coalesce("text", F.lit(""))) > 0))
    merged.write.mode("overwrite").parquet(path)
    return bad
