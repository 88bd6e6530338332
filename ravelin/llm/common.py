"""Helpers shared by the corpus operators: tables, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import gc
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..written import bucketed, discard, discard_since, drop_materialized, materialize, shared_dir, written_so_far  # noqa: F401

#: ASCII white space, as the contracts spell it.
SPACES = r"[\x20\x09-\x0D]+"


def free_name(df: DataFrame, name: str) -> str:
    """name, lengthened until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps. It does so when the driver's garbage
    is collected, which a quiet driver may put off while executors' disks fill."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_or_plain(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Mark df for broadcast only if its counted rows are within limit; beyond that the join
    shuffles both sides."""
    return F.broadcast(df) if rows <= limit else df


def fold_or(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))
