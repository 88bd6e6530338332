"""Removal of repeated byte strings by sparse distributed prefix doubling.

Every byte covered by a LENGTH-byte string that also starts earlier (smaller doc_id, or the
same document, earlier start) is removed. Ranking each byte position round after round would
sort a row for every byte of the corpus in each round; ranks are therefore given first to
sampled positions that no string of LENGTH bytes can do without:

  - rank of SEED bytes. Each window of LENGTH bytes is owned by its minimizer, the SEED-byte
    string in it with the smallest hash (leftmost of equals). That choice depends on the
    window's bytes only, so equal windows are owned alike, at the same distance. A sampled position's
    rank is that hash; Spark sorts positions by it, and unique ones leave for good.
  - rank pair, past the threshold. Neighbouring windows of one owner form a range of up to
    2 * LENGTH bytes; the position's second rank is its range's content. In the order of (first, second) rank,
    all but the first position of a pair repeat an earlier range whole. A first position whose
    first rank has one second rank only is new and leaves.
  - ranks of LENGTH bytes, for the windows of the ranges that are left. These share their first
    rank, so Spark sorts the ranges by it and a task ranks the windows of one such group after
    the other. Groups of more than GROUP ranges are not held in a task: their windows get rank
    pairs of their own, whose first position is found by an aggregate and joined back.

Hot ranks are kept out of single tasks in two ways. Equal ranges within a batch are merged
before the shuffle, so a passage that a third of the documents share meets in one task once for
each batch, not for each document. And first ranks with many different ranges (HOT) are known
beforehand from a sample of rows, which decides on the layout only: their ranges meet by both
ranks, and what is left of them goes the way of groups beyond GROUP.

Ranks are hashes of content; strings are taken as equal when two independent 64-bit ranks are.

Documents are numbered in the order of doc_id. Whole numbers serve as they are; where doc_id is
of another type, or different texts share one, rows are numbered by a sort of (doc_id, hash of text).

Defined cases: null and empty texts have no bytes; rows with equal doc_id and text are one
document (neither repeats the other); texts that share a doc_id but differ are documents of
their own, in the order of their hashes; a null doc_id is smaller than any other; doc_id may be
of any type that sorts; columns other than doc_id and text are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..shipping import ship
from .common import discard, materialize, release, small_or_plain, text_or_empty

LENGTH = 100
SEED = 32
#: Bytes that are hashed at a time; positions in a block take 20 bits.
BLOCK = (1 << 20) - 1
#: Ranges with one first rank that a task may hold, and how many it ranks together at least.
GROUP, TOGETHER = 50_000, 20_000
#: First ranks with so many ranges are hot, judged by that many rows and seen so often in them.
HOT, SAMPLE_ROWS, SEEN = 2_000, 50_000, 8
#: place = (start << 8 | windows) << 2 | whether its first rank is hot << 1 | whether it is known to repeat
WINDOW_BITS, FLAG_BITS = 8, 2
#: Broadcast limit for the numbers of documents (24 bytes and the doc_id each).
BROADCAST_NUMBERS = 200_000
NULL_ID = np.iinfo(np.int64).min


@cache
def _constants(which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random 64-bit value for each byte, and the powers of an odd base and of its inverse, modulo 2^64."""
    rng = np.random.default_rng((2024, which))
    table = rng.integers(0, 1 << 64, 256, np.uint64)
    base = (int(rng.integers(0, 1 << 62)) << 1 | 1) & ((1 << 64) - 1)
    inverse = pow(base, -1, 1 << 64)

    def powers(x: int) -> np.ndarray:
        steps = np.full(BLOCK + 2, x, np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    return table, powers(base), powers(inverse)


def _place(start, n):
    return (start << WINDOW_BITS | n) << FLAG_BITS


def _start(place):
    return place >> WINDOW_BITS + FLAG_BITS


def _windows(place):
    return place >> FLAG_BITS & (1 << WINDOW_BITS) - 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Rolling:
    """Hashes of any substring of a block from prefix sums."""

    def __init__(self, data: np.ndarray, which: int):
        table, power, self.inverse = _constants(which)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * power[: len(data)], out=self.prefix[1:])

    def fixed(self, length: int) -> np.ndarray:
        """Of every substring of that length."""
        n = len(self.prefix) - length
        return _mix((self.prefix[length:] - self.prefix[:n]) * self.inverse[:n])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.prefix[end] - self.prefix[start]) * self.inverse[start])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Owned ranges of the documents data[starts:ends]: (document, start in it, windows, first rank, second rank)."""
    none = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none
    first, second = Rolling(data, 0), Rolling(data, 1)
    seed = first.fixed(SEED)
    low = np.uint64((1 << 20) - 1)
    owner = _sliding_min((seed & ~low) | np.arange(len(seed), dtype=np.uint64), LENGTH - SEED + 1) & low
    # Windows inside one document, and where ownership changes hands among them.
    change = np.zeros(len(data) + 1, np.int32)
    fits = ends - starts >= LENGTH
    np.add.at(change, starts[fits], 1)
    np.add.at(change, ends[fits] - LENGTH + 1, -1)
    valid = np.cumsum(change)[: len(owner)] > 0
    cut = np.empty(len(owner), bool)
    cut[0] = True
    cut[1:] = (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1])
    cut[starts[fits]] = True
    begin = np.flatnonzero(cut)
    finish = np.append(begin[1:], len(owner))
    keep = valid[begin]
    begin, finish = begin[keep], finish[keep]
    anchor = owner[begin].astype(np.int64)
    n = finish - begin
    where = _mix((anchor - begin).astype(np.uint64) * np.uint64(257) + n.astype(np.uint64))
    doc = np.searchsorted(starts, begin, side="right") - 1
    return doc, begin - starts[doc], n, seed[anchor].view(np.int64), (second.of(begin, finish + (LENGTH - 1)) ^ where).view(np.int64)


def blocks(texts: list[bytes]):
    """(document numbers, starts in them, joined bytes, starts in the joined bytes, ends) of at most BLOCK bytes;
    a document longer than that comes in stretches that overlap by LENGTH - 1."""
    docs, offsets, parts, size = [], [], [], 0

    def flush():
        ends = np.cumsum([len(p) for p in parts])
        return np.array(docs), np.array(offsets), np.frombuffer(b"".join(parts), np.uint8), ends - [len(p) for p in parts], ends

    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), BLOCK - LENGTH + 1):
            part = text[at : at + BLOCK]
            if len(part) < LENGTH:
                continue
            if size + len(part) > BLOCK:
                yield flush()
                docs, offsets, parts, size = [], [], [], 0
            docs.append(k)
            offsets.append(at)
            parts.append(part)
            size += len(part)
    if parts:
        yield flush()


def _sampled(hot: np.ndarray):
    """A task's function: id, text -> first, second, id, place of every owned range. Ranges that repeat
    one of the same batch are marked and leave the rank they would meet under; those of a hot
    first rank (hot is sorted) are marked and meet under both ranks."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            found = []
            for docs, offsets, data, starts, ends in blocks(texts):
                doc, at, n, first, second = ranges(data, starts, ends)
                found.append((docs[doc], at + offsets[doc], n, first, second))
            if not found:
                continue
            doc, at, n, first, second = (np.concatenate(x) for x in zip(*found, strict=True))
            own, place = ids[doc], _place(at, n)
            order = np.lexsort((place, own, second, first))
            doc, place, own, first, second = (x[order] for x in (doc, place, own, first, second))
            again = np.zeros(len(order), bool)
            same = (first[1:] == first[:-1]) & (second[1:] == second[:-1])
            # Later than the first of its run, not merely beside an equal position of a repeated row.
            lead = np.maximum.accumulate(np.where(np.append(True, ~same), np.arange(len(order)), 0))
            again[1:] = same[...] & ((own != own[lead]) | (place != place[lead]))[1:]
            if len(hot):
                row = np.minimum(np.searchsorted(hot, first), len(hot) - 1)
                many = hot[row] == first
                place = place | many.astype(np.int64) << 1
                first = np.where(many, _mix((first ^ _mix(second.view(np.uint64)).view(np.int64)).view(np.uint64)).view(np.int64), first)
            place = place | again
            spread = _mix((own ^ place).view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(again, spread, first)), pa.array(second), pa.array(own), pa.array(place)],
                names=["first", "second", "id", "place"],
            )

    return run


def hot_ranks(rows: DataFrame, n_rows: int) -> np.ndarray:
    """First ranks with many different ranges, in order: at most one for SEEN ranges of the sampled rows."""
    share = min(1.0, SAMPLE_ROWS / max(1, n_rows))
    seen = rows.sample(share, seed=1).mapInArrow(_sampled(np.empty(0, np.int64)), "first long, second long, id long, place long")
    many = seen.groupBy("first").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(SEEN, HOT * share)).select("first").toArrow()
    return np.sort(many.column("first").to_numpy())


def _texts_of(batches):
    """id, text, ranges(first, place) -> first, id, place, text of each range."""
    for batch in batches:
        ids = batch.column(0)
        for k, (text, ranges_) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
            data = text.as_py().encode()
            place = ranges_.values.field("place").to_numpy()
            at, n = _start(place), _windows(place)
            parts = [data[a : a + m + LENGTH - 1] for a, m in zip(at.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [ranges_.values.field("first"), pa.array(np.full(len(parts), ids[k].as_py())), pa.array(place), pa.array(parts, pa.binary())],
                names=["first", "id", "place", "text"],
            )


def _window_ranks(texts: list[bytes], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent ranks of the n LENGTH-byte windows of each text, in order."""
    left, right, begin = [], [], 0
    while begin < len(texts):
        size, end = 0, begin
        while end < len(texts) and size + len(texts[end]) <= BLOCK:
            size += len(texts[end])
            end += 1
        data = np.frombuffer(b"".join(texts[begin:end]), np.uint8)
        m = n[begin:end]
        starts = np.append(0, np.cumsum(m[:-1] + LENGTH - 1))
        at = np.repeat(starts - np.append(0, np.cumsum(m[:-1])), m) + np.arange(m.sum())
        left.append(Rolling(data, 0).fixed(LENGTH)[at])
        right.append(Rolling(data, 1).fixed(LENGTH)[at])
        begin = end
    return np.concatenate(left), np.concatenate(right)


def _repeats(ids: np.ndarray, place: np.ndarray, texts: list[bytes]):
    """(id, place) of runs of windows that equal an earlier window of these ranges."""
    n = _windows(place)
    left, right = _window_ranks(texts, n)
    row = np.repeat(np.arange(len(n)), n)
    start = _start(place)[row] + np.arange(len(row)) - np.repeat(np.append(0, np.cumsum(n[:-1])), n)
    own = ids[row]
    order = np.lexsort((start, own, right, left))
    same = (left[order][1:] == left[order][:-1]) & (right[order][1:] == right[order][:-1])
    lead = np.maximum.accumulate(np.where(np.append(True, ~same), np.arange(len(order)), 0))
    again = np.zeros(len(order), bool)
    again[order] = (own[order] != own[order][lead]) | (start[order] != start[order][lead])
    # Neighbouring windows of one range go out as one run.
    edge = np.flatnonzero(again & ~np.append(False, again[:-1] & (row[1:] == row[:-1])))
    stop = np.flatnonzero(again & ~np.append(again[1:] & (row[1:] == row[:-1]), False)) + 1
    return own[edge], _place(start[edge], stop - edge)


def _ranked_groups(batches):
    """first, id, place, text sorted by first -> id, place of repeated windows, whole groups at a time."""
    held: list[tuple] = []

    def emit(first, ids, place, texts):
        own, found = _repeats(ids, place, texts)
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array(found)], names=["id", "place"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_pylist()))
        if sum(len(x[0]) for x in held) < TOGETHER:
            continue
        first, ids, place = (np.concatenate([x[i] for x in held]) for i in range(3))
        texts = [t for x in held for t in x[3]]
        cut = int(np.searchsorted(first, first[-1]))  # the last group may go on in the next batch
        if cut:
            yield emit(first[:cut], ids[:cut], place[:cut], texts[:cut])
        held = [(first[cut:], ids[cut:], place[cut:], texts[cut:])]
    if held and sum(len(x[0]) for x in held):
        yield emit(*(np.concatenate([x[i] for x in held]) for i in range(3)), [t for x in held for t in x[3]])


def _each_window(batches):
    """first, id, place, text -> rank pair (left, right) of each window of the ranges, with id and place."""
    for batch in batches:
        ids, place = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        n = _windows(place)
        left, right = _window_ranks(batch.column(3).to_pylist(), n)
        nth = np.arange(n.sum()) - np.repeat(np.append(0, np.cumsum(n[:-1])), n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(left.view(np.int64)), pa.array(right.view(np.int64)), pa.array(np.repeat(ids, n)), pa.array(_place(np.repeat(_start(place), n) + nth, 1))],
            names=["left", "right", "id", "place"],
        )


def _taken(text: bytes, places: np.ndarray) -> tuple[bytes, int, int]:
    """What is left of text, the bytes removed, and the maximal removed runs."""
    at, n = _start(places), _windows(places)
    order = np.argsort(at, kind="stable")
    at, end = at[order], np.maximum.accumulate((at + n + (LENGTH - 1))[order])
    head = np.flatnonzero(np.append(True, at[1:] > end[:-1]))
    start, stop = at[head], end[np.append(head[1:] - 1, len(end) - 1)]
    left = b"".join(text[a:b] for a, b in zip([0, *stop.tolist()], [*start.tolist(), len(text)], strict=True))
    return left, len(text) - len(left), len(start)


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, id, text: id numbers documents in the order of doc_id."""
    base = docs.select("doc_id", text_or_empty().alias("text"))
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):
        plain = base.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NULL_ID))).alias("id"), "text")
        prints = plain.select("id", F.xxhash64("text", F.col("doc_id").isNull()).alias("print"))
        if not prints.groupBy("id").agg(F.min("print").alias("a"), F.max("print").alias("b")).where("a <> b").limit(1).count():
            return plain
    prints = base.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__print")).distinct()
    # A sort over both columns, so that no doc_id is too common for a task; rows are numbered within and across its parts.
    numbers = materialize(
        prints.orderBy(F.col("__id").asc_nulls_first(), "__print").select("__id", "__print", F.monotonically_increasing_id().alias("id")), "suffix-numbers"
    )
    numbers = small_or_plain(numbers, numbers.count(), BROADCAST_NUMBERS)
    return base.join(numbers, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__print"))).select("doc_id", "id", "text")


def removed_places(docs: DataFrame) -> DataFrame:
    """docs(id, text) -> id, place: windows (runs of them) that repeat earlier ones."""
    spark, rows = docs.sparkSession, docs.select("id", "text")
    hot = hot_ranks(rows, rows.count())
    position = F.struct("id", "place")
    flag = lambda bit: F.col("place").bitwiseAND(F.lit(bit)) > 0
    group = Window.partitionBy("first")
    ranked = materialize(
        rows.mapInArrow(_sampled(hot), "first long, second long, id long, place long")
        .withColumn("lead", F.min(position).over(Window.partitionBy("first", "second")))
        .withColumn("again", flag(1) | (position > F.col("lead")))
        .withColumn("open", (flag(2) | (F.min("second").over(group) != F.max("second").over(group))) & ~F.col("again"))
        .withColumn("n_open", F.count_if("open").over(group))
        .where("again OR open")
        .select(F.when(F.col("open"), F.col("first")).alias("first"), "id", "place", F.when(F.col("open"), flag(2) | (F.col("n_open") > GROUP)).alias("large")),
        "suffix-ranks",
    )
    release(spark)
    again = ranked.where("large IS NULL").select("id", "place")
    open_ranges = (
        ranked.where("large IS NOT NULL")
        .groupBy(F.col("id").alias("__id"))
        .agg(F.collect_set(F.struct("first", "place")).alias("ranges"))
    )
    texts = materialize(
        rows.join(open_ranges, F.col("id") == F.col("__id")).select("id", "text", "ranges").mapInArrow(_texts_of, "first long, id long, place long, text binary"),
        "suffix-texts",
    )
    release(spark)
    large = ranked.where("large").select("first").distinct()
    out = again.union(
        texts.join(large, "first", "left_anti")
        .repartition("first")
        .sortWithinPartitions("first")
        .select("first", "id", "place", "text")
        .mapInArrow(_ranked_groups, "id long, place long")
    )
    spent = ()
    if ranked.where("large").limit(1).count():
        windows = materialize(
            texts.join(large, "first", "left_semi").select("first", "id", "place", "text").mapInArrow(_each_window, "left long, right long, id long, place long"),
            "suffix-windows",
        )
        # Written first, so that both sides of the join are plain exchanges and a hot window can be split.
        leads = materialize(
            windows.groupBy("left", "right").agg(F.min(position).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "suffix-leads"
        )
        spent = (windows, leads)
        out = out.union(windows.join(leads, ["left", "right"]).where(position > F.col("lead")).select("id", "place"))
    out = materialize(out, "suffix-repeats")
    discard(ranked, texts, *spent)
    release(spark)
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, kept (binary), n_bytes, n_removed, n_spans for every row of docs."""
    ship(docs.sparkSession)
    rows = numbered(docs)
    gone = removed_places(rows).groupBy(F.col("id").alias("__id")).agg(F.collect_set("place").alias("places"))
    joined = rows.join(gone, F.col("id") == F.col("__id"), "left").select("doc_id", "text", "places")

    def take(batches):
        for batch in batches:
            kept, size, removed, spans = [], [], [], []
            for text, places in zip(batch.column(1), batch.column(2), strict=True):
                data = text.as_py().encode()
                left, n, runs = _taken(data, np.asarray(places.values)) if places.is_valid else (data, 0, 0)
                kept.append(left)
                size.append(len(data))
                removed.append(n)
                spans.append(runs)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (size, removed, spans))],
                names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(take, f"doc_id {kind}, kept binary, n_bytes long, n_removed long, n_spans long")


def digest(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[tuple[int, str]]) -> dict[int, tuple[int, int, int, str]]:
    """The definition, for tests: doc_id -> n_bytes, n_removed, n_spans, kept_sha256."""
    seen: set[bytes] = set()
    out = {}
    for doc_id, text in sorted(texts):
        data = text.encode()
        covered = bytearray(len(data))
        for i in range(len(data) - LENGTH + 1):
            s = data[i : i + LENGTH]
            if s in seen:
                covered[i : i + LENGTH] = b"\1" * LENGTH
            seen.add(s)
        left = bytes(b for b, c in zip(data, covered, strict=True) if not c)
        spans = sum(c and not (i and covered[i - 1]) for i, c in enumerate(covered))
        out[doc_id] = (len(data), sum(covered), spans, hashlib.sha256(left).hexdigest())
    return out
