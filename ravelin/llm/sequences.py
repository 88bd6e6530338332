"""Documents as token pieces, and their places in packed sequences.

Two operators share this: packing by linear grouping (places only) and packed id output by
best-fit decreasing (places, ids, segment bounds and positions).

A document is its ids and an end id. Longer ones than the capacity are cut into pieces of that
length without loss; nothing else is cut. In the pass that tokenizes, each piece gets the
number of its task and its rank among that task's pieces of its length. Counts by task and
length turn these into global ranks without a sort, so no length, however common, meets in one
task; only the histogram (at most one row for each length) reaches the driver.

Defined cases: null and empty texts are one piece, the end id; repeated rows are packed each;
a null doc_id is carried; columns other than doc_id and text are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import packing, tokens
from ..shipping import ship
from .common import materialize, small_or_plain, text_or_empty

CAPACITY = 2048
#: Lengths up to this share of the capacity are small.
SMALL_SHARE = 8
#: Most groups of equal cardinality; fewer for few pieces, as each may leave one part-filled bin.
GROUPS = 96
#: Broadcast limit for counts by task and length (24 bytes each).
BROADCAST_COUNTS = 250_000


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, keep_ids: bool) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, task, nth (rank in its task) and, if asked for, ids (binary, unsigned 16 bit)."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        model = tokens.tokenizer(vocabulary)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            row, piece, start, length, crc, data = [], [], [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(model.ids(text), np.uint32(end_id)).astype("<u4")
                for p, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    row.append(k)
                    piece.append(p)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if keep_ids:
                        if part.max() > np.iinfo(np.uint16).max:
                            raise ValueError(f"{vocabulary} has ids of more than 16 bits")
                        data.append(part.astype("<u2").tobytes())
            sizes = np.array(length, np.int64)
            order = np.argsort(sizes, kind="stable")
            grouped = sizes[order]
            first = np.searchsorted(grouped, grouped)
            nth = np.empty(len(sizes), np.int64)
            nth[order] = np.arange(len(sizes)) - first + seen[grouped]
            seen += np.bincount(sizes, minlength=capacity + 1)
            columns = {
                "doc_id": batch.column(0).take(pa.array(row, pa.int64())),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(sizes),
                "ids_crc32": pa.array(crc, pa.int64()),
                "task": pa.array(np.full(len(sizes), task, np.int32)),
                "nth": pa.array(nth),
            }
            if keep_ids:
                columns["ids"] = pa.array(data, pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long" + ", ids binary" * keep_ids
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(cut, schema)


def place(cut: DataFrame, plan, capacity: int) -> DataFrame:
    """cut with sequence_id and offset instead of task and nth; plan turns the histogram of lengths into patterns."""
    counts = materialize(cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # capacity rows at most
        histogram[r["length"]] = r["n"]
    places = packing.Places(plan(histogram), capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    bases = small_or_plain(bases, counts.count(), BROADCAST_COUNTS)
    ranked = cut.join(bases, ["task", "length"]).withColumn("rank", F.col("nth") + F.col("before"))
    names = [c for c in cut.columns if c not in ("task", "nth")]
    schema = ", ".join(f"{c} {cut.schema[c].dataType.simpleString()}" for c in names) + ", sequence_id long, offset long"

    def placed(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = places.find(length, rank)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in names] + [pa.array(sequence), pa.array(offset)],
                names=[*names, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(placed, schema)


def grouped_plan(capacity: int = CAPACITY, share: int = SMALL_SHARE, groups: int = GROUPS):
    def plan(histogram: np.ndarray):
        small = capacity // share
        large = int(histogram[small + 1 : capacity].sum())
        return packing.grouped_packing(histogram, capacity, small, max(1, min(groups, int(large**0.5 / 2))))

    return plan


def linear_grouping(docs: DataFrame, vocabulary: str = tokens.WORD_BPE, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cut = materialize(pieces(docs, vocabulary, end_id, capacity, keep_ids=False), "pieces")
    return place(cut, grouped_plan(capacity), capacity)


def packed_sequences(docs: DataFrame, vocabulary: str = tokens.BYTE_BPE, end_id: int = tokens.BYTE_BPE_END, capacity: int = CAPACITY) -> DataFrame:
    """One row for each packed sequence: sequence_id, n_tokens, ids (binary: capacity unsigned
    16-bit ids, padded with end_id), cu_seqlens (segment bounds from 0), position_ids (binary,
    unsigned 16 bit: from 0 again at each segment), doc_ids and pieces of its segments."""
    cut = materialize(pieces(docs, vocabulary, end_id, capacity, keep_ids=True).drop("ids_crc32"), "piece-ids")
    placed = place(cut, lambda h: packing.best_fit_decreasing(h, capacity), capacity)
    kind = docs.schema["doc_id"].dataType.simpleString()
    # A sequence has at most capacity segments of capacity tokens in all.
    segments = placed.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids"))).alias("s")
    )
    flat = segments.select(
        "sequence_id", F.col("s.length").alias("length"), F.col("s.doc_id").alias("doc_ids"), F.col("s.piece").alias("pieces"), F.col("s.ids").alias("ids")
    )

    def rows(batches):
        for batch in batches:
            ids, bounds, positions, n = [], [], [], []
            for parts, lengths in zip(batch.column(4).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = np.full(capacity, end_id, "<u2")
                whole = np.frombuffer(b"".join(parts), "<u2")
                row[: len(whole)] = whole
                place = np.zeros(capacity, "<u2")
                at = 0
                for length in lengths:
                    place[at : at + length] = np.arange(length)
                    at += length
                ids.append(row.tobytes())
                positions.append(place.tobytes())
                bounds.append([0, *np.cumsum(lengths).tolist()])
                n.append(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int32()), pa.array(ids, pa.binary()), pa.array(bounds, pa.list_(pa.int32())),
                 pa.array(positions, pa.binary()), batch.column(2), batch.column(3)],
                names=["sequence_id", "n_tokens", "ids", "cu_seqlens", "position_ids", "doc_ids", "pieces"],
            )

    return flat.mapInArrow(
        rows,
        "sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_ids binary, "
        f"doc_ids array<{kind}>, pieces array<int>",
    )


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """The packed sequences as a Parquet data set: id matrix rows, segment bounds and positions."""
    packed_sequences(docs, **options).write.option("compression", "zstd").parquet(path)


def packed_digest(docs: DataFrame) -> DataFrame:
    return packed_sequences(docs).select(
        "sequence_id",
        "n_tokens",
        F.size("doc_ids").alias("n_segments"),
        F.crc32("ids").alias("ids_crc32"),
        F.crc32("position_ids").alias("positions_crc32"),
        F.array_join(F.col("cu_seqlens").cast("array<string>"), ",").alias("cu_seqlens"),
        F.array_join(F.transform(F.arrays_zip("doc_ids", "pieces"), lambda s: F.concat_ws(":", s["doc_ids"], s["pieces"])), ",").alias("segments"),
    )
