"""Benchmark decontamination by q-gram lemma filtering.

Texts and items are compared as UTF-8 bytes, letters of all scripts case-folded and white space
collapsed. An item of m bytes counts as found where a stretch of a text is within
k = EDITS * m edits of it. Such a stretch shares at least m - q + 1 - k*q q-grams with the
item, all of them on k + 1 neighbouring diagonals. So shared q-grams are counted in
overlapping bands of 2 * (k + 1) diagonals, a band below the bound is dropped, and those left
are verified by an alignment that moves within the band and k diagonals on either side, where its
ends may lie.

Items often share their wording. A q-gram of more than COMMON items is common, and common ones are not looked
up: of an item's c common places a match can save c at most, so it shares at least its bound less c of the others.
q is the largest of QS that leaves such a bound. Items for which none does (nearly all of them
is shared) are looked up whole, with the largest q that leaves any bound; there, places of a text
with equal surroundings on either side are taken once, since the first of them finds what the others would.

A bitmap over hashed q-grams, of a size that follows the items alone, passes over the rest of a text at a few
operations a byte. Before a band is aligned, the 4-grams that the item and the stretch have in common are
counted against their bound, and once a place is known only better ones are aligned.

The items travel to every task. They are a reference set, not corpus data; should they exceed
BLOCK_BYTES they are taken in blocks of that size, each against all texts.

Defined cases: null and empty texts match nothing, and so do null and empty items; items
too short for an edit are found where they stand exactly, however short; equal items are reported each; repeated rows are
reported each; a null doc_id or item_id is carried; other columns are ignored by contamination()
and kept by decontaminate(); empty tables give empty or unchanged results.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..shipping import ship
from .common import text_or_empty

#: Edits allowed, as a share of an item's bytes.
EDITS = 0.08
#: q and the least bound it is taken for, common q-grams left out.
QS = ((16, 16), (8, 1), (6, 1), (5, 4), (4, 4))
#: The same for items that are looked up whole; at q = 1 the bound holds for any item longer than its edits.
WHOLE_QS = ((16, 16), (8, 1), (4, 1), (2, 1), (1, 1))
#: Items that may share a q-gram before it counts as common.
COMMON = 32
#: q of the count before an alignment.
CLOSE_Q = 4
#: Bytes of items that are searched for together: an index takes some 100 times as much of a worker's
#: memory at most (a bitmap of 64 cells for a q-gram, and 48 bytes).
BLOCK_BYTES = 2 << 20
#: Bytes of a text that are filtered at a time.
STRETCH = 1 << 20
_SPACES = re.compile(rb"[\x20\x09-\x0d]+")


def normalise(text: str) -> bytes:
    return _SPACES.sub(b" ", text.casefold().encode()).strip(b" ")


def _grams(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit code for each q-gram (q is 16, 8 or less)."""
    n = len(data) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if q < 8:
        code = np.zeros(n, np.uint64)
        for j in range(q):
            code |= data[j : j + n].astype(np.uint64) << np.uint64(8 * j)
        return code * np.uint64(0xD6E8FEB86659FD93)
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    code = np.ascontiguousarray(words).view("<u8").ravel().astype(np.uint64, copy=False)
    if q == 16:
        code = code[:n] * np.uint64(0x9E3779B97F4A7C15) ^ code[8 : 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    return code[:n] * np.uint64(0xD6E8FEB86659FD93)


def _common(items: list[bytes], q: int) -> np.ndarray:
    """Codes of the q-grams that more than COMMON items hold, sorted."""
    held = [np.unique(_grams(np.frombuffer(t, np.uint8), q)) for t in items]
    code, n = np.unique(np.concatenate(held) if held else np.empty(0, np.uint64), return_counts=True)
    return code[n > COMMON]


class QGramIndex:
    """Items of one q: where their q-grams stand, but for common ones, and the bounds."""

    def __init__(self, q: int, items: list[tuple[int, bytes]], edits: float, common: np.ndarray, around: int = 0):
        """around: bytes on either side within which equal places of a text are taken once (0: all are taken)."""
        self.q, self.items, self.around = q, items, around
        self.length = np.array([len(t) for _, t in items], np.int64)
        self.k = (self.length * edits).astype(np.int64)
        codes = [_grams(np.frombuffer(t, np.uint8), q) for _, t in items]
        code = np.concatenate(codes) if codes else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(items)), [len(c) for c in codes])
        place = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.empty(0, np.int64)
        shared = np.isin(code, common)
        self.need = self.length - q + 1 - self.k * q - np.bincount(item[shared], minlength=len(items))
        code, item, place = code[~shared], item[~shared], place[~shared]
        order = np.argsort(code, kind="stable")
        self.code, self.item, self.place = code[order], item[order], place[order]
        self.distinct, self.first = np.unique(self.code, return_index=True)
        self.count = np.diff(np.append(self.first, len(self.code)))
        self.shift = np.uint64(64 - max(16, (len(self.distinct) * 32).bit_length()))
        self.bitmap = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bitmap[(self.distinct >> self.shift).astype(np.int64)] = True

    def regions(self, data: np.ndarray) -> list[tuple[int, int]]:
        """(item, lowest diagonal of a band) that reach their bound."""
        code = _grams(data, self.q)
        at = np.flatnonzero(self.bitmap[(code >> self.shift).astype(np.int64)])
        if not len(at):
            return []
        row = np.searchsorted(self.distinct, code[at])
        row[row == len(self.distinct)] = 0
        real = self.distinct[row] == code[at]
        at, row = at[real], row[real]
        if not len(at):
            return []
        if self.around:
            text, seen, keep = data.tobytes(), set(), []
            for k, p in enumerate(at.tolist()):
                window = (text[max(0, p - self.around) : p + self.around], min(p, self.around))
                if window not in seen:
                    seen.add(window)
                    keep.append(k)
            at, row = at[keep], row[keep]
        n = self.count[row]
        entry = np.repeat(self.first[row] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        item, diagonal = self.item[entry], np.repeat(at, n) - self.place[entry]
        width = self.k[item] + 1
        band = (diagonal + self.length[item]) // width  # not negative
        span = int(band.max()) + 2
        # A hit counts for its band and for the one that began a width lower.
        cell, hits = np.unique(np.concatenate([item * span + band + 1, item * span + band]), return_counts=True)
        item, band = cell // span, cell % span
        good = hits >= self.need[item]
        item, band = item[good], band[good]
        return list(zip(item.tolist(), ((band - 1) * (self.k[item] + 1) - self.length[item]).tolist(), strict=True))

    def close(self, item: int, data: np.ndarray, low: int, high: int, most: int) -> bool:
        """Whether the item and data on diagonals low to high have enough 4-grams in common for most edits."""
        m = int(self.length[item])
        need = m - CLOSE_Q + 1 - CLOSE_Q * most
        if need <= 0:
            return True
        own = _grams(np.frombuffer(self.items[item][1], np.uint8), CLOSE_Q)
        there = np.unique(_grams(data[max(0, low) : max(0, high + m)], CLOSE_Q))
        if not len(there):
            return False
        row = np.searchsorted(there, own)
        row[row == len(there)] = 0
        return int((there[row] == own).sum()) >= need


def banded_distance(item: bytes, text: bytes, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best stretch of text for item on diagonals low to high, if within
    most edits: for each number of edits, the furthest row each diagonal reaches."""
    m, n = len(item), len(text)

    def slide(row: int, diagonal: int) -> int:
        at, step = row + diagonal, 64
        while row < m and at < n and step:
            if item[row : row + step] == text[at : at + step] and row + step <= m and at + step <= n:
                row, at = row + step, at + step
            else:
                step //= 2
        return row

    front = {d: (slide(max(0, -d), d) if d >= 0 else -1, d) for d in range(max(low, 0), high + 1) if d <= n}
    for edits in range(most + 1):
        best = None
        for d, (row, start) in front.items():
            if row >= m and (best is None or start < best[1]):
                best = (edits, start, row + d)
        if best:
            return best
        after = {}
        for d in range(low, high + 1):
            options = []
            if d in front and front[d][0] >= 0:
                options.append((front[d][0] + 1, front[d][1]))  # replaced
            if d + 1 in front and front[d + 1][0] >= 0:
                options.append((front[d + 1][0] + 1, front[d + 1][1]))  # missing from the text
            if d - 1 in front and front[d - 1][0] >= 0:
                options.append((front[d - 1][0], front[d - 1][1]))  # added in the text
            if options:
                row, start = max(options)
                row = min(row, m)
                if 0 <= row + d <= n:
                    after[d] = (slide(row, d), start)
        front = after
        # A text may lack the first letters of an item: begin lower on the item's rows.
        if edits < most and -edits - 1 >= low and 0 <= n:
            d = -edits - 1
            row = slide(edits + 1, d)
            if d not in front or row > front[d][0]:
                front[d] = (row, 0)
    return None


class Searcher:
    def __init__(self, items: list[tuple[int, bytes]], edits: float = EDITS):
        self.overlap = max([len(t) + 2 * int(len(t) * edits) + 64 for _, t in items], default=0)
        self.indexes: list[QGramIndex] = []
        bound = lambda m, q: m - q + 1 - int(m * edits) * q
        left = [(ident, text) for ident, text in items if text]
        for q, least in QS:
            common = _common([t for _, t in items], q) if left else None
            fit = lambda t, q=q, least=least, common=common: bound(len(t), q) >= least and (
                bound(len(t), q) - int(np.isin(_grams(np.frombuffer(t, np.uint8), q), common).sum()) >= least)
            taken = [fit(t) for _, t in left]
            if any(taken):
                self.indexes.append(QGramIndex(q, [x for x, f in zip(left, taken, strict=True) if f], edits, common))
            left = [x for x, f in zip(left, taken, strict=True) if not f]
        by_q: dict[int, list[tuple[int, bytes]]] = {}
        for ident, text in left:
            q = next((q for q, least in WHOLE_QS if bound(len(text), q) >= least), None)
            if q:
                by_q.setdefault(q, []).append((ident, text))
        self.indexes += [QGramIndex(q, found, edits, np.empty(0, np.uint64), self.overlap) for q, found in by_q.items()]

    def _places(self, text: str, best: dict[tuple[int, int], tuple[int, int, int]]):
        """Puts each item's best place so far into best, and yields at each change."""
        data = normalise(text)
        whole = np.frombuffer(data, np.uint8)
        step = max(STRETCH, 4 * self.overlap)
        for low in range(0, max(1, len(data)), step):
            part = whole[low : low + step + self.overlap]
            bytes_of = cache(part.tobytes)
            for x, index in enumerate(self.indexes):
                for item, diagonal in index.regions(part):
                    k = int(index.k[item])
                    most = best[x, item][0] - 1 if (x, item) in best else k
                    first, last = diagonal - k, diagonal + 2 * (k + 1) + k
                    if most < 0 or not index.close(item, part, first, last, most):
                        continue
                    found = banded_distance(index.items[item][1], bytes_of(), first, last, most)
                    if found:
                        best[x, item] = (found[0], found[1] + low, found[2] + low)
                        yield

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, edits, start, end) of each item's best place; offsets in the normalised bytes."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for _ in self._places(text, best):
            pass
        return sorted(((self.indexes[x].items[i][0], *place) for (x, i), place in best.items()), key=lambda p: (p[0] is not None, p))

    def holds(self, text: str) -> bool:
        """Whether any item is found."""
        return any(True for _ in self._places(text, {}))


def _blocks(items: DataFrame):
    """Lists of (item_id, normalised text) of BLOCK_BYTES at most (one item at least)."""
    block, size = [], 0
    for r in items.select("item_id", text_or_empty().alias("text")).orderBy("item_id").toLocalIterator():
        text = normalise(r["text"])
        if block and size + len(text) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((r["item_id"], text))
        size += len(text)
    if block:
        yield block


def contamination(docs: DataFrame, items: DataFrame, edits: float = EDITS) -> DataFrame:
    """doc_id, item_id, edits, start, end for each document and item found in it."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind, item_type = items.schema["item_id"].dataType.simpleString(), to_arrow_type(items.schema["item_id"].dataType)
    schema = f"doc_id {kind}, item_id {item_kind}, edits int, start long, end long"
    base = docs.select("doc_id", text_or_empty().alias("text"))
    found = None
    for block in _blocks(items):

        def search(batches, block=block):
            searcher = Searcher(block, edits)
            for batch in batches:
                rows, hits = [], []
                for k, text in enumerate(batch.column(1)):
                    for hit in searcher.find(text.as_py()):
                        rows.append(k)
                        hits.append(hit)
                columns = list(zip(*hits, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())),
                     pa.array(columns[0], item_type), pa.array(columns[1], pa.int32()),
                     pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())],
                    names=["doc_id", "item_id", "edits", "start", "end"],
                )

        part = base.mapInArrow(search, schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def decontaminate(docs: DataFrame, items: DataFrame, edits: float = EDITS) -> DataFrame:
    """docs without the rows that hold an item. Rows are judged where they are; nothing is shuffled."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")
    out = docs
    for block in _blocks(items):

        def clean(batches, block=block):
            searcher = Searcher(block, edits)
            for batch in batches:
                yield batch.filter(pa.array([not searcher.holds(t.as_py() or "") for t in batch.column(at)], pa.bool_()))

        out = out.mapInArrow(clean, docs.schema)
    return out
