"""Embedding: the interface of a model, and the offline default (hashed term frequencies)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..batches import pieces
from ..functions.text import WORD
from ..shipping import ship
from ..sources.versions import VersionedTable
from ..written import materialize

DIMENSIONS = 64


class Embedder(Protocol):
    """Loaded once in a worker; turns a list of texts into rows of a matrix."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


def sparse_hashed(df: DataFrame, key: str, text: Column, buckets: int = 1 << 20) -> DataFrame:
    """key, idx, weight: term frequencies by hashed word."""
    words = df.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))).alias("w"))
    return words.groupBy(key, F.pmod(F.xxhash64("w"), F.lit(buckets)).alias("idx")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def hashed_embedder(dimensions: int = DIMENSIONS) -> Embedder:
    """Each word adds or takes one at a place that its hash gives; rows are scaled to length 1."""
    import re
    import zlib

    word = re.compile(r"[\w\-_/]+")

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions))
        for i, t in enumerate(texts):
            for w in word.findall((t or "").lower()):
                h = zlib.crc32(w.encode())
                out[i, h % dimensions] += 1 if h >> 16 & 1 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)

    return embed


def embed(df: DataFrame, key: str, text: Column, load: Callable[[], Embedder], batch: int = 512, width: int = DIMENSIONS, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, the carried columns, dense, embed_ok. The model is loaded once for each task; a batch that
    fails gives zero vectors of its width for its rows only and embed_ok false."""
    ship(df.sparkSession)
    names = [key, *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for part in pieces(batches, batch):
            try:
                dense, ok = model(part.column(len(names)).to_pylist()), True
            except Exception:  # one bad batch must not fail the job
                dense, ok = np.zeros((part.num_rows, width)), False
            vectors = pa.array([np.asarray(v, float) for v in dense], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], vectors, pa.array([ok] * part.num_rows)], names=[*names, "dense", "embed_ok"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    return df.select(*names, text.alias("__text")).mapInArrow(run, f"{kinds}, dense array<double>, embed_ok boolean")


def cached_vectors(df: DataFrame, key: str, text: Column, cache: VersionedTable, model: str, load: Callable[[], Embedder] = hashed_embedder, width: int = DIMENSIONS) -> DataFrame:
    """key, dense, embed_ok of every row. cache(content_hash, model, dense) holds the vectors of texts that were
    embedded before; each text that it lacks for the model reaches the model once, however many rows have it, and its
    vector is appended as a new version. A text that fails is not stored and is tried again next time."""
    spark = df.sparkSession
    rows = df.select(F.col(key), F.sha2(F.coalesce(text, F.lit("")), 256).alias("content_hash"), F.coalesce(text, F.lit("")).alias("__text"))
    if cache.current() is None:
        cache.write(spark.createDataFrame([], "content_hash string, model string, dense array<double>"), "create")
    known = cache.read().where(F.col("model") == model).select("content_hash", "dense")
    fresh = rows.join(known.select("content_hash"), "content_hash", "left_anti").groupBy("content_hash").agg(F.first("__text").alias("__text"))
    made = materialize(embed(fresh, "content_hash", F.col("__text"), load, width=width), "embed-new")
    good = made.where("embed_ok").select("content_hash", F.lit(model).alias("model"), "dense")
    if good.limit(1).count():
        cache.append(good, f"embed {model}")
    both = known.withColumn("embed_ok", F.lit(True)).unionByName(made)
    return rows.select(key, "content_hash").join(both, "content_hash").select(key, "dense", "embed_ok")


def hashed_vectors(df: DataFrame, key: str, text: Column, carry: tuple[str, ...] = ()) -> DataFrame:
    return embed(df, key, text, hashed_embedder, carry=carry)


def model_length(text: Column, query: bool) -> Column:
    """Most tokens a model reads, by the length of the text."""
    small, middle, large = (256, 512, 1024) if query else (512, 1024, 2048)
    n = F.length(text)
    return F.when(n < 1000, small).when(n < 4000, middle).otherwise(large)
