"""Near-duplicates by word shingles: SimHash segments with Golay keys, joined and verified.

At a similarity of 0.8 two 64-bit fingerprints differ in ten bits or so, more than exact
segments survive. So fingerprints are longer here, SEGMENTS of 23 bits, and each segment is
decoded to its Golay keys (one or six codeword indices). A key of one segment is made
selective by an exact segment that survives with the similarity itself: the smallest of the
shingles' hashes under the segment's own permutation. For texts of similarity 0.8 a segment
meets with a probability of about 0.48, one of the eight with 0.995; at 0.9, 0.9999.

Texts with the same shingles are one node. Nodes that share a key and whose fingerprints
differ in MOST_BITS at most are joined to families; of each bucket only a link to the smallest
node of its tree leaves the task for each member, so rows grow with the members and not with
their pairs. Within a family all pairs are verified by the Jaccard similarity of their shingle
sets, nearest fingerprints first, skipping those that are in one group already; again a link
a member leaves. No pair that met goes unexamined.

Few shingles make unsteady fingerprints, so texts of SHORT shingles or fewer are also compared
exactly: two sets of similarity t share one of the n - ceil(t n) + 1 rarest shingles of each, and
all that share such a shingle are verified as a family is, at any distance of fingerprints.

What fingerprints leave apart is then looked for exactly, among texts of any length: in one order of
all shingles two sets of similarity t share one of the first n - ceil(t n) + 1 of each, so a shingle that
stands there in nodes of more than one group is a bucket, whose pairs are compared inside its task. A node carries the parity of how
many of its shingles fall on each bit of a string about as long as its set: two such strings differ in no more bits than the sets in
shingles, so a pair that differs in too many is not similar. What is left joins buckets to families as fingerprints do, and
their pairs are verified by the sets. Rows grow with members, not with pairs. The order is that of
the hashes, with shingles that many texts of a sample hold behind all others; the sample decides on the cost only.

Large buckets and families (more than BLOCK nodes or BLOCK_SHINGLES shingles) are first compared
with up to PIVOTS of their own nodes, a join whose cost is linear. What was found linked with a
pivot is one group already; the rest, usually nothing, meets all others in cells of a grid, so
that no task holds more than two blocks.

Defined cases: null and empty texts have no shingles and are one node; texts of fewer words
than a shingle are one shingle; rows that repeat a doc_id and its text are one document, other
texts of one doc_id are documents of their own (ordered by a hash of the text); a null doc_id
groups with no other row and stays; columns other than doc_id and text are ignored by
near_groups() and kept by keep_one(), whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import golay
from .common import discard, discard_since, materialize, release, small_or_plain, text_or_empty, written_so_far
from .components import connected_components
from .simhash import SHINGLE_WORDS, words_of

SIMILARITY = 0.8
SEGMENTS = 8
#: 64-bit words of a fingerprint.
WORDS = 3
#: Differing bits up to which pairs are verified: nearly four standard deviations above what a similarity of 0.8 gives (29).
MOST_BITS = 48
#: Different shingles up to which a text meets all that are similar to it, whatever their fingerprints.
SHORT = 12
#: Nodes of a bucket or family, and their shingles, that are compared as one block.
BLOCK, BLOCK_SHINGLES = 1_000, 2_000_000
#: Nodes that all others of a large bucket or family are compared with before pairs are.
PIVOTS = 3
#: Nodes of a bucket of prefixes that are compared as one block; they come without sets.
PREFIX_BLOCK = 4_000
#: Nodes of small buckets of prefixes that are compared at a time.
SMALL_ROWS = 8_192
#: Rows of fingerprints that are compared at a time with those of their cell.
ROWS = 64
#: Texts of the sample for common shingles, in how many of them one stands, and how many are known at most.
SAMPLE_TEXTS, COMMON_TEXTS, MOST_COMMON = 2_000, 3, 100_000
#: Broadcast limit for document ids.
BROADCAST_IDS = 500_000
#: Broadcast limits for pivots, and for the shingles they carry.
BROADCAST_PIVOTS, BROADCAST_SHINGLES = 20_000, 1_000_000

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                         0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165,
                         0x94D049BB133111EB, 0xBF58476D1CE4E5B9], np.uint64)
_BYTE_BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    x = h * _MULTIPLIERS[k]
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """docs without text and with shingles: hashes of the word shingles, in order, repeats
    included. The shingles are zipped from shifted copies of the word list, so nothing is split twice."""
    names = [c for c in docs.columns if c != "text"]
    base = docs.select(*names, words_of(text_or_empty()).alias("w"))
    n = F.size("w") - (words - 1)
    # The generator keeps the word list from being rebuilt for each of the uses below.
    base = base.select(F.explode(F.array(F.struct(*names, "w"))).alias("r")).select("r.*")
    shifted = [F.slice("w", k + 1, F.greatest(n, F.lit(0))).alias(f"w{k}") for k in range(words)]
    many = F.transform(F.arrays_zip(*shifted), lambda s: F.xxhash64(F.concat_ws(" ", *[s[f"w{k}"] for k in range(words)])))
    few = F.when(F.size("w") > 0, F.array(F.xxhash64(F.array_join("w", " ")))).otherwise(F.array().cast("array<bigint>"))
    return base.select(*names, F.when(n >= 1, many).otherwise(few).alias("shingles"))


def _common(docs: DataFrame, words: int) -> np.ndarray:
    """Hashes of shingles that many texts of a sample hold, ascending."""
    share = min(1.0, 2 * SAMPLE_TEXTS / max(1, docs.count()))
    some = shingle_sets(docs.select("text").sample(share, seed=1).limit(SAMPLE_TEXTS), words).select(F.explode(F.array_distinct("shingles")).alias("h"))
    often = some.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON_TEXTS)
    return np.sort(often.orderBy(F.desc("n"), "h").limit(MOST_COMMON).select("h").toArrow().column("h").to_numpy().astype(np.int64).view(np.uint64))


def prefix(h: np.ndarray, similarity: float, common: np.ndarray) -> np.ndarray:
    """Of a set of ascending hashes those of which a set of that similarity holds one: the first in the order of all shingles."""
    n = len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1 if len(h) else 0
    late = np.isin(h, common)
    return np.concatenate([h[~late], h[late]])[:n].view(np.int64)


def parity(h: np.ndarray) -> bytes:
    """For each bit of a power of two of at least len(h) bits whether an odd number of the hashes falls on it."""
    bits = 1 << max(6, int(len(h) - 1).bit_length())
    with np.errstate(over="ignore"):
        at = (_mixed(h, WORDS + SEGMENTS) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def sketch(shingles: np.ndarray, reach: int) -> tuple[int, np.ndarray, np.ndarray, int, np.ndarray | None]:
    """(node, fingerprint words, minima, number of different shingles, these if reach or fewer) of a text's shingle hashes."""
    h = np.unique(shingles.view(np.uint64))
    few = h.view(np.int64) if len(h) <= reach else None
    if not len(h):
        return 0, np.zeros(WORDS, np.int64), np.zeros(SEGMENTS, np.uint64), 0, few
    with np.errstate(over="ignore"):
        node = int((_mixed(h, WORDS + SEGMENTS).sum() + np.uint64(len(h))).astype(np.uint64).view(np.int64))
        prints = np.empty(WORDS, np.uint64)
        for k in range(WORDS):
            columns = _mixed(h, k).view(np.uint8).reshape(-1, 8)
            ones = np.array([np.bincount(columns[:, b], minlength=256) @ _BYTE_BITS for b in range(8)]).ravel()
            prints[k] = np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]
        minima = np.array([_mixed(h, WORDS + s).min() for s in range(SEGMENTS)], np.uint64)
    return node, prints.view(np.int64), minima, len(h), few


def segments(prints: np.ndarray) -> np.ndarray:
    """The SEGMENTS 23-bit segments of rows of fingerprint words."""
    bits = np.unpackbits(prints.astype("<i8").view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")
    part = bits[:, : SEGMENTS * golay.BITS].reshape(len(prints), SEGMENTS, golay.BITS)
    return part.astype(np.int64) @ (1 << np.arange(golay.BITS, dtype=np.int64))


def _reach(similarity: float) -> int:
    """Shingles of the largest set that one of SHORT shingles can be similar to."""
    return int(SHORT / similarity + 1e-9)


def _sketched(similarity: float, common: np.ndarray):
    """(doc_id, text_h, shingles) -> node, fingerprint, keys and prefix of each row, and the shingles of short ones."""
    reach = _reach(similarity)

    def run(batches):
        for batch in batches:
            column = batch.column(2)
            rows = [sketch(np.asarray(x.values), reach) for x in column]
            if not rows:
                continue
            node = np.array([r[0] for r in rows], np.int64)
            prints = np.array([r[1] for r in rows])
            seg = segments(prints)
            keys = [[] for _ in rows]
            for s in range(SEGMENTS):
                row, index = golay.keys(seg[:, s])
                low = np.array([int(r[2][s]) & ((1 << 47) - 1) for r in rows], np.int64)
                for r, k in zip(row.tolist(), (((low[row] << 12) | index) << 3 | s).tolist(), strict=True):
                    keys[r].append(k)
            longs = pa.list_(pa.int64())
            sets = [np.unique(np.asarray(x.values).view(np.uint64)) for x in column]
            first = [prefix(h, similarity, common) for h in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(node), pa.array([r[3] for r in rows], pa.int64()),
                 *(pa.array(prints[:, k]) for k in range(WORDS)), pa.array(keys, longs), pa.array([r[4] for r in rows], longs), pa.array(first, longs),
                 pa.array([parity(h) for h in sets], pa.binary())],
                names=["doc_id", "text_h", "node", "shingles", *(f"p{k}" for k in range(WORDS)), "keys", "s", "prefix", "parity"],
            )

    return run


def pivot_hits(large: DataFrame, group: str, linked, weight: str, name: str) -> DataFrame:
    """large(group, node, ...) -> group, node, tie: nodes found linked with a pivot of their group.
    linked(pivot) compares a row with the pivot's columns. In each turn the smallest node of a
    group that no pivot was linked with is the next pivot, for all nodes of the group."""
    spark, hits = large.sparkSession, None
    for turn in range(PIVOTS):
        open_rows = large if hits is None else large.join(hits.select(group, "node"), [group, "node"], "left_anti")
        pivots = materialize(open_rows.groupBy(group).agg(F.min_by(F.struct(*[c for c in large.columns if c != group]), "node").alias("pivot")), f"{name}-pivots")
        size = pivots.agg(F.count(F.lit(1)).alias("n"), F.sum(f"pivot.{weight}").alias("w")).first()
        if not size["n"]:
            break
        few = size["w"] <= BROADCAST_SHINGLES and size["n"] <= BROADCAST_PIVOTS
        found = materialize(
            large.join(F.broadcast(pivots) if few else pivots, group).where(linked(F.col("pivot"))).select(group, "node", F.col("pivot.node").alias("tie")), f"{name}-hits"
        )
        hits = found if hits is None else hits.unionByName(found)
    return hits if hits is not None else spark.createDataFrame([], f"{group} long, node long, tie long")


def cells(df: DataFrame, group: str, large: DataFrame | None = None, hits: DataFrame | None = None) -> DataFrame:
    """(group, lo, hi) are cells of at most two blocks. Each group of df is one cell. Of the
    groups of large, blocks being their number of blocks, each node without a hit meets all nodes
    in some cell; tie names the pivot a node was linked with."""
    names = [c for c in df.columns if c not in (group, "blocks")]
    shape = lambda d, lo, hi, tie: d.select(group, lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), tie.cast("long").alias("tie"), *names)
    out = shape(df, F.lit(0), F.lit(0), F.lit(None))
    if large is not None:
        ties = hits.groupBy(group, "node").agg(F.min("tie").alias("tie"))
        tied = materialize(large.select(group, "node").join(ties, [group, "node"], "left"), f"{group}-ties")
        rest = tied.groupBy(group).agg(F.count_if(F.col("tie").isNull()).alias("rest"), F.count(F.lit(1)).alias("n")).where("rest > 0")
        marked = large.join(tied, [group, "node"]).join(rest, group)
        some = F.ceil(F.col("rest") / F.col("n") * F.col("blocks")).cast("int")
        own_all, own_rest = (F.pmod(F.xxhash64("node", F.lit(k)), b).cast("int") for k, b in ((0, F.col("blocks")), (1, some)))
        at = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
        as_any = F.transform(F.sequence(F.lit(0), some - 1), lambda i: at(i, own_all))
        as_rest = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: at(own_rest, j))
        placed = marked.withColumn("cell", F.explode(F.when(F.col("tie").isNull(), F.array_union(as_any, as_rest)).otherwise(as_any)))
        out = out.unionByName(shape(placed, F.col("cell.lo"), F.col("cell.hi"), F.col("tie")))
    return out.repartition(group, "lo", "hi").sortWithinPartitions(group, "lo", "hi")


def _cells(batches):
    """Whole cells of a sorted stream (group, lo, hi first), as Arrow tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        g, lo, hi = (batch.column(k).to_numpy() for k in range(3))
        if (g[0], lo[0], hi[0]) == (g[-1], lo[-1], hi[-1]) and len(held) > 1 and held[0].column(0)[0].as_py() == g[0]:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        g, lo, hi = (table.column(k).to_numpy() for k in range(3))
        edge = np.flatnonzero((g[1:] != g[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
        for a, b in zip([0, *edge[:-1].tolist()], edge.tolist(), strict=False):
            yield table.slice(a, b - a)
        held = table.slice(int(edge[-1]) if len(edge) else 0).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        g, lo, hi = (table.column(k).to_numpy() for k in range(3))
        edge = np.flatnonzero((g[1:] != g[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(g)], strict=True):
            yield table.slice(a, b - a)


def trees(prints: np.ndarray, tie: np.ndarray, similar=None, bits: int = MOST_BITS) -> np.ndarray:
    """For each row of prints the number of its tree: rows that differ in so many bits at most and are
    similar(i, j) are joined, ROWS rows against all behind them at a time, nearest pairs first;
    pairs within one tree are skipped. Rows with the same tie (0: none) are one tree to begin with."""
    k = len(prints)
    label = np.arange(k)
    tied = np.flatnonzero(tie)
    if len(tied):
        _, first, group = np.unique(tie[tied], return_index=True, return_inverse=True)
        label[tied] = tied[first][group]
    for at in range(0, k - 1, ROWS):
        part, rest = prints[at : at + ROWS], prints[at + 1 :]
        distance = np.zeros((len(part), len(rest)), np.int16)
        for w in range(prints.shape[1]):
            distance += np.bitwise_count(part[:, w, None] ^ rest[None, :, w])
        near = (distance <= bits) & (label[at : at + ROWS, None] != label[None, at + 1 :])
        a, b = np.nonzero(near)
        behind = b >= a  # each pair once
        a, b = a[behind], b[behind]
        order = np.argsort(distance[a, b], kind="stable")
        a, b = a[order] + at, b[order] + at + 1
        for begin in range(0, len(a), 4096):
            x, y = a[begin : begin + 4096], b[begin : begin + 4096]
            apart = label[x] != label[y]
            for i, j in zip(x[apart].tolist(), y[apart].tolist(), strict=True):
                if label[i] != label[j] and (similar is None or similar(i, j)):
                    label[label == label[j]] = label[i]
    return label


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Members that two arrays without repeats have in common."""
    if len(a) + len(b) < 512:
        return len(set(a.tolist()).intersection(b.tolist()))
    return len(np.intersect1d(a, b, assume_unique=True))


def _star(node: np.ndarray, label: np.ndarray) -> pa.RecordBatch | None:
    """Each member of a tree linked with its smallest node, so that cells with like members give like links."""
    order = np.lexsort((node, label))
    node, label = node[order], label[order]
    first = np.searchsorted(label, label)
    rest = first != np.arange(len(label))
    return pa.RecordBatch.from_arrays([pa.array(node[first][rest]), pa.array(node[rest])], names=["a", "b"]) if rest.any() else None


def _words(table: pa.Table) -> np.ndarray:
    return np.column_stack([table.column(f"p{k}").to_numpy() for k in range(WORDS)]).view(np.uint64)


def _ties(table: pa.Table) -> np.ndarray:
    tie = table.column("tie")
    return np.where(tie.is_valid().to_numpy(), tie.fill_null(0).to_numpy() | 1, 0)


def _near(batches):
    """Cells of buckets -> links of nodes with near fingerprints."""
    for cell in _cells(batches):
        links = _star(cell.column("node").to_numpy(), trees(_words(cell), _ties(cell)))
        if links:
            yield links


def _verified(similarity: float, bits: int):
    """Cells of families -> links of nodes with similar shingle sets, directly or through others of the cell."""

    def run(batches):
        for cell in _cells(batches):
            sets = cell.column("s").combine_chunks()
            values, bounds = sets.values.to_numpy(), sets.offsets.to_numpy()

            def similar(i, j, values=values, bounds=bounds):
                a, b = values[bounds[i] : bounds[i + 1]], values[bounds[j] : bounds[j + 1]]
                if min(len(a), len(b)) < similarity * max(len(a), len(b)):
                    return False
                both = shared(a, b)
                return both >= similarity * (len(a) + len(b) - both)

            links = _star(cell.column("node").to_numpy(), trees(_words(cell), _ties(cell), similar, bits))
            if links:
                yield links

    return run


def _links(whole: DataFrame, group: str, marked: DataFrame, similarity: float, bits: int, name: str) -> DataFrame:
    """(a, b): verified links within the groups of whole(group, node, fingerprint words, blocks,
    shingles, s), between fingerprints of so many different bits at most. marked has all blocks."""
    hits = large = None
    if marked.where("blocks > 1").limit(1).count():
        large = materialize(whole.where("blocks > 1"), f"{name}-large")

        def alike(pivot):
            both = F.size(F.array_intersect("s", pivot["s"]))
            total = F.col("shingles") + pivot["shingles"]
            sized = F.least("shingles", pivot["shingles"]) >= similarity * F.greatest("shingles", pivot["shingles"])
            return sized & (both >= similarity * (total - both))

        hits = pivot_hits(large, group, alike, "shingles", name)
    links = cells(whole.where("blocks = 1").drop("shingles"), group, large, hits).mapInArrow(_verified(similarity, bits), "a long, b long")
    if hits is not None:
        links = links.unionByName(hits.where("tie <> node").select(F.col("tie").alias("a"), F.col("node").alias("b")))
    return links


def _short_links(nodes: DataFrame, similarity: float) -> DataFrame:
    """(a, b): verified links between all nodes of few shingles that share one of their rarest."""
    prints = [f"p{k}" for k in range(WORDS)]
    short = nodes.where("s IS NOT NULL AND shingles > 0").select("node", *prints, "shingles", "s")
    items = short.select("node", "shingles", F.explode("s").alias("key"))
    counts = materialize(items.groupBy("key").agg(F.count(F.lit(1)).alias("f")), "near-short-counts")
    rarest = F.col("shingles") - F.ceil(similarity * F.col("shingles") - F.lit(1e-9)) + 1
    ordered = items.join(counts, "key").groupBy("node", "shingles").agg(F.sort_array(F.collect_list(F.struct("f", "key"))).alias("o"))
    keyed = materialize(ordered.select("node", F.explode(F.slice("o", F.lit(1), rarest.cast("int"))).alias("o")).select("node", "o.key"), "near-short-keys")
    blocks = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    blocks = materialize(blocks, "near-short-blocks")
    return _links(keyed.join(blocks, "key").join(short, "node"), "key", blocks, similarity, 64 * WORDS, "near-short")


def _sets(known: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node, s: the different shingles of the wanted(node, first), whose texts are read again."""
    wanted = wanted.select("node", "first.*")
    wanted = small_or_plain(wanted, wanted.count(), BROADCAST_IDS)
    texts = known.join(wanted, ["doc_id", "text_h"]).select("doc_id", "text_h", "node", "text").dropDuplicates(["doc_id", "text_h"])
    return shingle_sets(texts.select("node", "text"), words).select("node", F.array_distinct("shingles").alias("s"))


def possible(n: np.ndarray, root: np.ndarray, strings: list[bytes], similarity: float):
    """Pairs (i, j) of places, in arrays, whose roots differ and whose sets of n shingles may be similar by their sizes and parities.
    The longer of two strings is folded to the shorter one's length."""
    size = np.array([len(x) // 8 for x in strings])
    for words in np.unique(size).tolist():
        own = np.flatnonzero(size == words)
        own = own[np.argsort(n[own], kind="stable")]
        longer = np.flatnonzero((size > words) & (n <= n[own[-1]] / similarity + 1e-6))
        folded = [np.bitwise_xor.reduce(np.frombuffer(strings[i], np.uint64).reshape(-1, words)) for i in longer.tolist()]
        rows = np.concatenate([own, longer])
        bits = np.vstack([np.frombuffer(b"".join(strings[i] for i in own.tolist()), np.uint64).reshape(-1, words), *folded])
        for at in range(0, len(own), ROWS):
            a, b = rows[at : at + ROWS][: len(own) - at], rows[at + 1 :]
            most = (n[a, None] + n[None, b]) * ((1 - similarity) / (1 + similarity)) + 1e-6
            small, large = np.minimum(n[a, None], n[None, b]), np.maximum(n[a, None], n[None, b])
            good = (root[a, None] != root[None, b]) & (small >= similarity * large)
            good &= np.arange(len(b))[None] >= np.arange(len(a))[:, None]  # each pair once
            there = np.flatnonzero(good.any(axis=0))
            if not len(there):
                continue
            part, rest = bits[at : at + len(a)], bits[at + 1 :][there]
            distance = np.zeros((len(a), len(there)), np.int32)
            for w in range(words):
                distance += np.bitwise_count(part[:, w, None] ^ rest[None, :, w])
            x, y = np.nonzero(good[:, there] & (distance <= most[:, there]))
            if len(x):
                yield a[x], b[there[y]]


def possible_in(cell: np.ndarray, n: np.ndarray, root: np.ndarray, strings: list[bytes], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The same pairs of many small cells at once; rows of a cell stand together."""
    size, found = np.array([len(x) // 8 for x in strings]), []
    for step in range(1, len(cell)):
        a = np.flatnonzero(cell[:-step] == cell[step:])
        if not len(a):
            break
        b = a + step
        good = (root[a] != root[b]) & (np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]))
        found.append((a[good], b[good]))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    a, b = np.where(size[a] <= size[b], a, b), np.where(size[a] <= size[b], b, a)
    most, keep = (n[a] + n[b]) * ((1 - similarity) / (1 + similarity)) + 1e-6, np.zeros(len(a), bool)
    for words, longer in {*zip(size[a].tolist(), size[b].tolist(), strict=True)}:
        for at in np.array_split(np.flatnonzero((size[a] == words) & (size[b] == longer)), 1 + len(a) * longer // (1 << 20)):
            if len(at):
                x, y = (np.frombuffer(b"".join(strings[i] for i in side[at].tolist()), np.uint64) for side in (a, b))
                y = np.bitwise_xor.reduce(y.reshape(len(at), -1, words), axis=1)
                keep[at] = np.bitwise_count(x.reshape(len(at), words) ^ y).sum(axis=1, dtype=np.int64) <= most[at]
    return a[keep], b[keep]


def _joined(label: np.ndarray, pairs, similar=None):
    """Trees of label joined along the pairs that are similar; yields the pairs that joined two."""
    for a, b in pairs:
        for begin in range(0, len(a), 4096):
            x, y = a[begin : begin + 4096], b[begin : begin + 4096]
            apart = label[x] != label[y]
            for i, j in zip(x[apart].tolist(), y[apart].tolist(), strict=True):
                if label[i] != label[j] and (similar is None or similar(i, j)):
                    label[label == label[j]] = label[i]
                    yield i, j


def _possible(similarity: float):
    """Cells of buckets of prefixes -> links of nodes that may be similar; nodes without such a pair give none. Small cells are
    compared many at a time."""

    def small(held):
        table = pa.concat_tables(held).combine_chunks()
        node, root, n = (table.column(c).to_numpy() for c in ("node", "root", "shingles"))
        cell = np.repeat(np.arange(len(held)), [len(t) for t in held])
        a, b = possible_in(cell, n, root, table.column("parity").to_pylist(), similarity)
        return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    def run(batches):
        held, rows = [], 0
        for cell in _cells(batches):
            if len(cell) <= ROWS:
                held.append(cell)
                rows += len(cell)
                if rows >= SMALL_ROWS:
                    yield small(held)
                    held, rows = [], 0
                continue
            node, root, n = (cell.column(c).to_numpy() for c in ("node", "root", "shingles"))
            label = np.arange(len(node))
            if root.min() != root.max():
                for _ in _joined(label, possible(n, root, cell.column("parity").to_pylist(), similarity)):
                    pass
            links = _star(node, label)
            if links:
                yield links
        if held:
            yield small(held)

    return run


def _similar_apart(similarity: float):
    """Cells of families -> the links of nodes with similar sets that join groups."""

    def run(batches):
        for cell in _cells(batches):
            node, root, n = (cell.column(c).to_numpy() for c in ("node", "root", "shingles"))
            sets = cell.column("s").combine_chunks()
            values, bounds = sets.values.to_numpy(), sets.offsets.to_numpy()

            def similar(i, j, values=values, bounds=bounds):
                a, b = values[bounds[i] : bounds[i + 1]], values[bounds[j] : bounds[j + 1]]
                both = shared(a, b)
                return both >= similarity * (len(a) + len(b) - both)

            label = np.unique(root, return_inverse=True)[1]
            found = list(_joined(label, possible(n, root, cell.column("parity").to_pylist(), similarity), similar))
            if found:
                x, y = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y])], names=["a", "b"])

    return run


def _met(rows: DataFrame, group: str, blocks: DataFrame) -> DataFrame:
    """Cells of rows(group, node, ...), where each pair of a group of more than one of its blocks(group, blocks) meets."""
    rows, large, hits = rows.join(blocks, group), None, None
    if blocks.where("blocks > 1").limit(1).count():
        large = materialize(rows.where("blocks > 1"), "near-missed-large")
        hits = rows.sparkSession.createDataFrame([], f"{group} long, node long, tie long")
    return cells(rows.where("blocks = 1"), group, large, hits)


def _missed_links(known: DataFrame, nodes: DataFrame, groups: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b): verified links of nodes whose prefixes share a shingle and that groups(node, root) leave apart."""
    mark, spark = written_so_far(), nodes.sparkSession
    long = nodes.where(F.col("shingles") > SHORT)
    rooted = materialize(long.join(groups, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "shingles", "parity", "prefix"), "near-missed-rooted")
    release(spark)
    keys = rooted.select(F.explode("prefix").alias("key"), "node", "root")
    apart = keys.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high")
    apart = materialize(apart.select("key", F.ceil(F.col("n") / PREFIX_BLOCK).cast("int").alias("blocks")), "near-missed-apart")
    release(spark)
    keyed = materialize(keys.select("key", "node").join(apart.select("key"), "key"), "near-missed-keys")
    release(spark)
    carried = keyed.join(rooted.drop("prefix"), "node").select("key", "node", "root", "shingles", "parity")
    near = materialize(_met(carried, "key", apart).mapInArrow(_possible(similarity), "a long, b long").distinct(), "near-missed-pairs")
    discard(apart, keyed)
    release(spark)

    families = connected_components(near).withColumnRenamed("root", "family")
    members = families.join(rooted.drop("prefix"), "node").join(nodes.select("node", "first"), "node")
    members = materialize(members, "near-missed-nodes")
    blocks = members.groupBy("family").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    whole = members.drop("first").join(_sets(known, members, words), "node").select("family", "node", "root", "shingles", "parity", "s")
    links = _met(whole, "family", materialize(blocks, "near-missed-blocks")).mapInArrow(_similar_apart(similarity), "a long, b long")
    links = materialize(links.distinct(), "near-missed-links")
    discard_since(mark, links)
    release(spark)
    return links


def _groups(docs: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_h, node of every row with a doc_id; node, keep: the smallest (doc_id, text_h) of its group)."""
    spark = docs.sparkSession
    ship(spark)
    known = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64(text_or_empty()).alias("text_h"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    prints = [f"p{k}" for k in range(WORDS)]
    sketches = materialize(
        shingle_sets(known, words).mapInArrow(
            _sketched(similarity, _common(known, words)),
            f"doc_id {kind}, text_h long, node long, shingles long, {', '.join(f'{p} long' for p in prints)}, keys array<long>, s array<long>, prefix array<long>, parity binary",
        ),
        "near-sketches",
    )
    release(spark)
    nodes = materialize(
        sketches.groupBy("node").agg(
            F.min(F.struct("doc_id", "text_h")).alias("first"), *[F.min(p).alias(p) for p in prints], F.min("shingles").alias("shingles"),
            F.min("keys").alias("keys"), F.min("s").alias("s"), F.min("prefix").alias("prefix"), F.min("parity").alias("parity"),
        ),
        "near-nodes",
    )
    rows = materialize(sketches.select("doc_id", "text_h", "node"), "near-rows")
    discard(sketches)
    mark = written_so_far()
    keyed = nodes.select(F.explode("keys").alias("key"), "node", *prints)
    buckets = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-buckets")
    met = keyed.join(buckets.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n"), "key")
    hits = large = None
    if buckets.where(F.col("n") > BLOCK).limit(1).count():
        large = materialize(met.where("blocks > 1"), "near-large")
        far = lambda pivot: sum(F.bit_count(F.col(p).bitwiseXOR(pivot[p])) for p in prints)
        hits = pivot_hits(large.withColumn("one", F.lit(1)), "key", lambda pivot: far(pivot) <= MOST_BITS, "one", "near-bucket")
    near = cells(met.where("blocks = 1"), "key", large, hits).mapInArrow(_near, "a long, b long")
    if hits is not None:
        near = near.unionByName(hits.where("tie <> node").select(F.col("tie").alias("a"), F.col("node").alias("b")))
    near = materialize(near.distinct(), "near-pairs")
    discard_since(mark, near)
    release(spark)

    families = connected_components(near).withColumnRenamed("root", "family")
    discard(near)
    members = families.join(nodes.drop("keys", "s", "prefix", "parity"), "node")
    sizes = members.groupBy("family").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    members = materialize(members.join(sizes, "family"), "near-families")
    sets = _sets(known, members, words)
    whole = members.select("family", "node", *prints, "blocks", "shingles").join(sets, "node")
    links = _links(whole, "family", members, similarity, MOST_BITS, "near-family").unionByName(_short_links(nodes, similarity))
    links = materialize(links, "near-links")
    discard_since(mark, links)
    release(spark)

    groups = connected_components(links)
    missed = _missed_links(known, nodes, groups, words, similarity)
    if missed.limit(1).count():
        groups = connected_components(links.unionByName(missed))
    discard(links, missed)
    rooted = nodes.join(groups, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    keep = rooted.groupBy("root").agg(F.min("first").alias("keep"))
    keepers = materialize(rooted.join(keep, "root").select("node", "keep"), "near-keep")
    discard(nodes)
    return rows, keepers


def near_groups(docs: DataFrame, words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, keep_id: each document with the smallest doc_id of its group."""
    rows, keepers = _groups(docs, words, similarity)
    return rows.join(keepers, "node").select("doc_id", F.col("keep.doc_id").alias("keep_id"))


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs without the documents that a smaller doc_id of their group stands for."""
    mark = written_so_far()
    rows, keepers = _groups(docs, words, similarity)
    own = F.struct("doc_id", "text_h")
    gone = materialize(rows.join(keepers, "node").where(own != F.col("keep")).select("doc_id", "text_h").distinct(), "near-gone")
    discard_since(mark, gone)
    release(docs.sparkSession)
    gone = small_or_plain(gone, gone.count(), BROADCAST_IDS)
    return docs.join(gone, (docs["doc_id"] == gone["doc_id"]) & (F.xxhash64(text_or_empty(docs["text"])) == gone["text_h"]), "left_anti")
