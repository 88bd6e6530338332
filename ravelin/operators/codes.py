"""Cells whose vectors are coded. A vector is scaled to length 1 and stands in the cell of its nearest centre; what it
differs from the centre is cut into equal parts, and each part is named by the nearest of its part's entries: a byte
for each part in place of its numbers. A search scores codes from tables of products, and only the best of them by
code are compared by their whole vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import search

#: Entries of a part; a code is a byte.
ENTRIES = 256


def _parts(x: np.ndarray, parts: int) -> np.ndarray:
    """Rows cut into equal parts, the last one filled up with zeros: rows x parts x width."""
    width = -(-x.shape[1] // parts)
    return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)


def _nearest(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The nearest entry of each row, the first of equal ones."""
    return ((entries * entries).sum(axis=1)[None, :] - 2 * x @ entries.T).argmin(axis=1)


def _residuals(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
    cell = (x @ centres.T).argmax(axis=1)
    return cell, x - centres[cell]


def residual_books(vectors: DataFrame, centres: np.ndarray, parts: int = 16, sample: int = 20_000, rounds: int = 10, seed: int = 1) -> np.ndarray:
    """parts x entries x width, by k-means in each part, fitted on at most sample rows. Codes are whole for every row."""
    kept = vectors.where("vector IS NOT NULL").select("vector")
    share = min(1.0, 2 * sample / max(1, kept.count()))
    x = search.stacked(kept.sample(share, seed=seed).limit(sample).toArrow().column("vector")).astype(np.float64)
    rest = _parts(_residuals(x, centres)[1], parts)
    rng = np.random.default_rng(seed)
    books = rest[rng.choice(len(rest), min(ENTRIES, len(rest)), replace=False)].transpose(1, 0, 2).copy()
    for p, book in enumerate(books):
        for _ in range(rounds):
            own = _nearest(rest[:, p], book)
            total, n = np.zeros_like(book), np.bincount(own, minlength=len(book))
            np.add.at(total, own, rest[:, p])
            book[n > 0] = total[n > 0] / n[n > 0, None]
    return books


def coded_index(vectors: DataFrame, centres: np.ndarray, books: np.ndarray) -> DataFrame:
    """vectors(id, vector) -> id, cell, code. Rows without an id or a vector have no place in it."""
    ship(vectors.sparkSession)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                cell, rest = _residuals(x, centres)
                cut = _parts(rest, len(books))
                code = np.stack([_nearest(cut[:, p], book) for p, book in enumerate(books)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary())], names=["id", "cell", "code"])

    return vectors.where("id IS NOT NULL AND vector IS NOT NULL").select("id", "vector").mapInArrow(run, "id long, cell int, code binary")


def _by_codes(centres: np.ndarray, books: np.ndarray):
    def scores(cell: int, asking: pa.Table, rows: pa.Table) -> np.ndarray:
        q = search.stacked(asking.column("vector"))
        code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(rows.num_rows, len(books))
        cut = _parts(q, len(books))
        out = np.repeat((q @ centres[cell])[:, None], rows.num_rows, axis=1)
        for p, book in enumerate(books):
            out += (cut[:, p] @ book.T)[:, code[:, p]]
        return out

    return scores


def coded_topk(queries: DataFrame, index: DataFrame, vectors: DataFrame, centres: np.ndarray, books: np.ndarray, k: int, probes: int, compare: int = 8) -> DataFrame:
    """Approximate dense_topk over coded_index(). The compare * k best of each query by code meet their whole vectors, which
    are joined by id after that cut; the k best of these are the result, scored as dense_topk scores.
    Recall depends on probes, parts and compare: see the test."""
    probe = search.materialize(search._nearest_cells(queries, "query_id", centres, probes), "code-probes")
    most = k * compare
    near = search.ranked(search.in_cells(probe, index, _by_codes(centres, books), most), most, F.desc("score"), F.col("id")).select("query_id", "id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    own = queries.select("query_id", F.col("vector").alias("q"))
    both = near.join(vectors.select("id", "vector"), "id").join(own, "query_id")
    size = F.sqrt(dot("q", "q") * dot("vector", "vector"))
    scored = both.select("query_id", "id", F.round(F.when(size > 0, dot("q", "vector") / size).otherwise(0.0), search.DIGITS).alias("score"))
    return search.ranked(scored, k, F.desc("score"), F.col("id"))
