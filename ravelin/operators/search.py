"""Dense and sparse top-k, fusion, filters with fallback. Every table of hits carries query_id."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..batches import pieces
from ..functions import constants as C
from ..functions.text import WORD
from ..shipping import ship
from ..written import materialize
from .best import Best

#: Queries and vectors of one matrix product.
QUERY_BLOCK, VECTOR_BLOCK = 512, 2048
#: Queries that one pass over the rows answers; they travel with the tasks.
PASS_BYTES = 64 << 20
#: Queries of one pass times the hits kept of each: a task holds some three times so many rows.
PASS_HITS = 1 << 19
#: Texts of a batch that are turned into postings at a time.
TEXT_ROWS = 2_048
HITS = "query_id long, id long, score double"
DIGITS = 6
#: Vectors of a cell that are compared at a time.
SLICE = 8_000
#: Vectors that are given a row for each of their cells at a time.
PROBE_ROWS = 1_024


def ranked(hits: DataFrame, k: int | None, *order: Column, by: str = "query_id") -> DataFrame:
    """rank by the given order within each query, cut to k. The cut runs before and after the exchange."""
    out = hits.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return out if k is None else out.where(F.col("rank") <= k)


def _passes(rows: Iterator[Row], size: Callable[[Row], int], k: int = 1) -> Iterator[list[Row]]:
    """Rows in lists of about PASS_BYTES, and of no more hits than PASS_HITS."""
    block, held = [], 0
    for row in rows:
        block.append(row)
        held += size(row)
        if held >= PASS_BYTES or len(block) * k >= PASS_HITS:
            yield block
            block, held = [], 0
    if block:
        yield block


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1))
    return np.divide(x, norm[:, None], out=np.zeros_like(x), where=norm[:, None] > 0)


def _answered(asked: DataFrame, size: Callable[[Row], int], search: Callable[[list[Row]], DataFrame], k: int) -> DataFrame:
    """The k best of each query, pass by pass. Where there is more than one pass, each one's hits are written before the
    next is read, so the driver holds two passes of queries at most and no plan grows with their texts or vectors. What
    the passes and asked are read from should be files: it is read again for each of them."""
    written = lambda hits: materialize(ranked(hits, k, F.desc("score"), F.col("id")).drop("rank"), "pass-hits")
    done, last = [], None
    for block in _passes(asked.toLocalIterator(), size, k):
        if last is not None:
            done.append(written(last))
        last = search(block)
    if last is None:
        return asked.sparkSession.createDataFrame([], HITS)
    return reduce(DataFrame.unionByName, [*done, written(last)]) if done else last


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """queries(query_id, vector[, need]), vectors(id, vector[, bits]) -> query_id, id, score, rank by
    cosine, among the vectors whose bits hold all that a query needs.

    A pass over the vectors answers PASS_BYTES of query vectors. Blocks of queries meet blocks of vectors in one
    matrix product each, and a task keeps its k best of every query, so what is shuffled grows with tasks times
    queries times k and not with the vectors. Zero vectors score 0; rows without an id or a vector take no part."""
    ship(vectors.sparkSession)
    masked = "need" in queries.columns and "bits" in vectors.columns
    kept = vectors.where("id IS NOT NULL AND vector IS NOT NULL").select("id", "vector", *(["bits"] if masked else []))

    def search(block: list[Row]) -> DataFrame:
        names, m = np.array([r["query_id"] for r in block], np.int64), _unit(np.array([r["vector"] for r in block], np.float64))
        need = np.array([r["need"] for r in block], np.int64) if masked else None

        def run(batches):
            best = Best(len(names), k)
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = _unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1))
                own = batch.column(0).to_numpy(zero_copy_only=False)
                bits = batch.column(2).to_numpy(zero_copy_only=False) if masked else None
                for j in range(0, len(v), VECTOR_BLOCK):
                    for i in range(0, len(m), QUERY_BLOCK):
                        s = np.round(m[i : i + QUERY_BLOCK] @ v[j : j + VECTOR_BLOCK].T, DIGITS)
                        if masked:
                            n = need[i : i + QUERY_BLOCK, None]
                            s[(bits[None, j : j + VECTOR_BLOCK] & n) != n] = -np.inf
                        best.offer_block(i, s, own[j : j + VECTOR_BLOCK])
            yield from best.batches(names)

        return kept.mapInArrow(run, HITS)

    asked = queries.where("query_id IS NOT NULL AND vector IS NOT NULL").select("query_id", "vector", *(["need"] if masked else []))
    found = _answered(asked, lambda r: 8 * len(r["vector"]), search, k)
    return ranked(found, k, F.desc("score"), F.col("id"))


def dense_topk_expression(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The same by column expressions only, for at most QUERY_BLOCK queries, which are counted and broadcast; dense_topk takes any number."""
    n = queries.limit(QUERY_BLOCK + 1).count()
    if n > QUERY_BLOCK:
        raise ValueError(f"more than {QUERY_BLOCK} queries: use dense_topk")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    q = queries.select("query_id", F.col("vector").alias("q")).withColumn("qn", F.sqrt(dot(F.col("q"), F.col("q"))))
    v = vectors.select("id", F.col("vector").alias("v")).withColumn("vn", F.sqrt(dot(F.col("v"), F.col("v"))))
    score = F.round(F.when((F.col("qn") > 0) & (F.col("vn") > 0), dot(F.col("q"), F.col("v")) / (F.col("qn") * F.col("vn"))).otherwise(0.0), DIGITS)
    pairs = v.join(F.broadcast(q)).select("query_id", "id", score.alias("score"))
    return ranked(pairs, k, F.desc("score"), F.col("id"))


def postings(texts: DataFrame, key: str) -> DataFrame:
    """key, token, weight: term frequencies of lower-cased words."""
    token = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))
    return texts.select(key, token.alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def _spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each span of n places, one span after the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _counted(row: np.ndarray, word: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, word) with how often each occurs, ordered by row and word."""
    key, n = np.unique(row.astype(np.int64) * words + word, return_counts=True)
    return key // words, key % words, n.astype(np.float64)


def sparse_topk(queries: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """queries(query_id, text[, need]), texts(id, text[, bits]) -> query_id, id, score, rank by the dot
    product of term frequencies; texts that share no word with a query are no hits.

    A pass over the texts answers PASS_BYTES of query words. Texts stay where they are read: a batch turns into
    postings of the words that queries hold, a query is scored only where the largest counts of its words in the
    batch could reach its k-th best score so far, and a task keeps its k best of every query. No pair becomes a row,
    and a word that all texts and queries share is no key of a shuffle. Rows without an id or a text take no part."""
    ship(texts.sparkSession)
    masked = "need" in queries.columns and "bits" in texts.columns
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)).alias("tokens")
    # Every pass reads the words again; written once, they are neither joined, shuffled nor split again for each.
    kept = materialize(texts.where("id IS NOT NULL AND text IS NOT NULL").select("id", tokens, *(["bits"] if masked else [])), "search-words")

    def search(block: list[Row]) -> DataFrame:
        names = np.array([r["query_id"] for r in block], np.int64)
        need = np.array([r["need"] for r in block], np.int64) if masked else None
        words = sorted({w for r in block for w in r["tokens"]})
        place = {w: i for i, w in enumerate(words)}
        asker = np.repeat(np.arange(len(block)), [len(r["tokens"]) for r in block])
        asker, word, weight = _counted(asker, np.array([place[w] for r in block for w in r["tokens"]], np.int64), max(1, len(words)))
        begin = np.searchsorted(asker, np.arange(len(block) + 1))

        def run(batches):
            known, best = pa.array(words, pa.string()), Best(len(names), k)
            # Rows are bounded, not bytes alone: each piece costs a bound for every query.
            for batch in (b.slice(i, TEXT_ROWS) for b in batches for i in range(0, b.num_rows, TEXT_ROWS)):
                lists = batch.column(1)
                found = pc.index_in(lists.flatten(), value_set=known)
                row = pc.list_parent_indices(lists).filter(found.is_valid()).to_numpy(zero_copy_only=False)
                own, bits = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False) if masked else None
                for_word, text, n = _counted(found.drop_null().to_numpy(zero_copy_only=False), row, max(1, batch.num_rows))
                start = np.searchsorted(for_word, np.arange(len(words) + 1))
                most = np.zeros(len(words))
                np.maximum.at(most, for_word, n)
                bound = np.bincount(asker, weights=weight * most[word], minlength=len(names))
                for i in np.flatnonzero((bound > 0) & (bound >= best.floor)):
                    own_words = word[begin[i] : begin[i + 1]]
                    size = start[own_words + 1] - start[own_words]
                    at = _spans(start[own_words], size)
                    score = np.bincount(text[at], weights=n[at] * np.repeat(weight[begin[i] : begin[i + 1]], size), minlength=batch.num_rows)
                    if masked:
                        score[(bits & need[i]) != need[i]] = 0
                    best.offer_block(i, np.where(score > 0, score, -np.inf)[None, :], own)
            yield from best.batches(names)

        return kept.mapInArrow(run, HITS)

    asked = queries.where("query_id IS NOT NULL AND text IS NOT NULL").select("query_id", tokens, *(["need"] if masked else []))
    found = _answered(asked, lambda r: 64 * len(r["tokens"]), search, k)
    return ranked(found, k, F.desc("score"), F.col("id"))


def pruned_postings(texts: DataFrame, key: str, cap: int = C.SPARSE_CAP) -> DataFrame:
    """prune_sparse(postings(texts, key), key, cap) of texts(key, text). A text whose key no other row has is counted and cut in its
    own row, so its words are not shuffled; rows that share a key (or have none) are, and the keys that repeat."""
    again = texts.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(key).isNull()).select(F.col(key).alias("_again"))
    again = materialize(again, "repeated-keys")
    marked = texts.select(key, "text").join(again, F.col(key).eqNullSafe(F.col("_again")), "left")
    words = F.array_sort(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))
    # The generators keep the lists from being built again for each of their uses.
    once = lambda df, **cols: df.select(F.explode(F.array(F.struct(key, *[c.alias(n) for n, c in cols.items()]))).alias("r")).select("r.*")
    rows = once(marked.where("_again IS NULL AND " + f"`{key}` IS NOT NULL AND text IS NOT NULL"), w=words)
    first = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (i == 0) | (F.get("w", i) != F.get("w", i - 1)))
    rows = once(rows.where(F.size("w") > 0), w=F.col("w"), first=first)
    counted = lambda i, j: F.struct((i - F.coalesce(F.get("first", j + 1), F.size("w"))).alias("less"), F.get("w", i).alias("token"))
    kept = rows.select(key, F.explode(F.slice(F.array_sort(F.transform("first", counted)), 1, cap)).alias("p"))
    single = kept.select(key, F.col("p.token").alias("token"), (-F.col("p.less")).cast("double").alias("weight"))
    shared = marked.where(f"_again IS NOT NULL OR `{key}` IS NULL").select(key, "text")
    return single.unionByName(prune_sparse(postings(shared, key), key, cap))


def prune_sparse(postings_: DataFrame, key: str, cap: int = C.SPARSE_CAP, absolute: bool = True) -> DataFrame:
    """Zero weights dropped, the cap heaviest tokens of each row kept (by absolute weight unless told otherwise)."""
    weight = F.abs("weight") if absolute else F.col("weight")
    rows = postings_.where("weight <> 0")
    return ranked(rows, cap, weight.desc(), F.col("token"), by=key).drop("rank")


def fuse(dense: DataFrame, sparse: DataFrame, k: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of two rankings(query_id, id, rank)."""
    a = dense.select("query_id", "id", F.col("rank").alias("dense_rank"))
    b = sparse.select("query_id", "id", F.col("rank").alias("sparse_rank"))
    part = lambda rank, w: F.coalesce(F.lit(w) / (F.lit(C.RRF_K) + F.col(rank)), F.lit(0.0))
    score = part("dense_rank", C.DENSE_WEIGHT) + part("sparse_rank", C.SPARSE_WEIGHT)
    both = a.join(b, ["query_id", "id"], "full").withColumn("rrf_score", F.round(score, 9))
    return ranked(both, k, F.desc("rrf_score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), F.col("id"))


def hybrid_search(query_vectors: DataFrame, query_texts: DataFrame, vectors: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Both branches at 2k, fused and cut to k; a query that only one branch answers keeps that branch's hits."""
    return fuse(dense_topk(query_vectors, vectors, 2 * k), sparse_topk(query_texts, texts, 2 * k), k)


def filtered_fusion(dense: DataFrame, sparse: DataFrame, payload: DataFrame, wanted: dict[str, str | list[str]], k: int | None = None) -> DataFrame:
    """Fusion of the hits whose payload(id, ...) meets every condition. Values of a list must all hold at
    once, so two different ones let nothing through."""
    conditions = [F.col(c) == v for c, vs in wanted.items() for v in ([vs] if isinstance(vs, str) else vs)]
    allowed = payload.where(reduce(lambda a, b: a & b, conditions, F.lit(True))).select("id")
    return fuse(dense.join(allowed, "id", "left_semi"), sparse.join(allowed, "id", "left_semi"), k)


def preview(hits: DataFrame, most: int, prefix: int) -> DataFrame:
    """What a log keeps of hits: the first ones of each query, no vectors, texts cut."""
    kept = [c for c in hits.columns if c not in ("vector", "dense", "sparse")]
    return hits.where(F.col("rank") <= most).select(*[F.substring("text", 1, prefix).alias("text") if c == "text" else F.col(c) for c in kept])


# ---------------------------------------------------------------- dense search by cells


def cell_centres(vectors: DataFrame, cells: int, sample: int = 20_000, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Centres of cells by k-means on directions, fitted on a bounded sample of rows."""
    share = min(1.0, 2 * sample / max(1, vectors.count()))
    found = vectors.sample(share, seed=seed).select("vector").limit(sample).toArrow().column("vector").combine_chunks()
    if not len(found):
        return np.zeros((0, 0))
    x = found.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(found), -1)
    x = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        size = np.sqrt((total * total).sum(axis=1, keepdims=True))
        centres = np.where(size > 0, total / np.maximum(size, 1e-12), x[rng.choice(len(x), len(centres))])
    return centres


def _lists(x: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists, without a Python object for each."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _nearest_cells(df: DataFrame, key: str, centres: np.ndarray, probes: int) -> DataFrame:
    """key, vector (scaled to length 1), cell: a row for each of the nearest cells."""
    ship(df.sparkSession)

    def run(batches):
        for batch in pieces(batches, PROBE_ROWS):
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            x = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
            n = min(probes, len(centres))
            cell = np.argpartition(-(x @ centres.T), n - 1, axis=1)[:, :n]
            row = np.repeat(np.arange(len(x)), n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), _lists(x[row]), pa.array(cell.ravel().astype(np.int32))], names=[key, "vector", "cell"]
            )

    kind = df.schema[key].dataType.simpleString()
    return df.where(F.col(key).isNotNull() & F.col("vector").isNotNull()).select(key, "vector").mapInArrow(run, f"{key} {kind}, vector array<double>, cell int")


def cell_index(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """id, vector, cell: every vector in its cell. Write it partitioned by cell to search it more than once."""
    return _nearest_cells(vectors, "id", centres, 1)


def in_cells(probe: DataFrame, index: DataFrame, scores: Callable[[int, pa.Table, pa.Table], np.ndarray], k: int) -> DataFrame:
    """probe(query_id, cell, ...), index(id, cell, ...) -> the k best (query_id, id, score) of each slice. scores(cell, asking,
    rows) is a matrix of both. The rows and the queries of a cell are cut into slices of SLICE or so, and each pair of slices is one
    group: no pair of rows becomes a row, and no task holds more than two slices and a block of scores."""
    parts = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias(name))
    # A row for each cell; their number is that of the centres.
    sizes = F.broadcast(materialize(parts(index, "slices").join(parts(probe, "shares"), "cell"), "cell-sizes"))
    place = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    placed = index.join(sizes, "cell").withColumn("slice", place("id", "slices")).withColumn("share", each("shares")).drop("slices", "shares")
    asked = probe.join(sizes, "cell").withColumn("share", place("query_id", "shares")).withColumn("slice", each("slices")).drop("slices", "shares")

    def run(key: tuple, rows: pa.Table, asking: pa.Table) -> pa.Table:
        best, cell = Best(asking.num_rows, k), key[0].as_py()
        own = rows.column("id").to_numpy()
        for j in range(0, rows.num_rows, VECTOR_BLOCK):
            for i in range(0, asking.num_rows, QUERY_BLOCK):
                s = np.round(scores(cell, asking.slice(i, QUERY_BLOCK), rows.slice(j, VECTOR_BLOCK)), DIGITS)
                best.offer_block(i, s, own[j : j + VECTOR_BLOCK])
        names = asking.column("query_id").to_numpy()
        return pa.Table.from_batches(list(best.batches(names)), pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())]))

    return placed.groupBy("cell", "slice", "share").cogroup(asked.groupBy("cell", "slice", "share")).applyInArrow(run, HITS)


def stacked(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def cell_topk(queries: DataFrame, index: DataFrame, centres: np.ndarray, k: int, probes: int) -> DataFrame:
    """Approximate dense_topk over cell_index(): a query meets the vectors of its nearest cells only, by a matrix product for
    each pair of slices. Recall depends on probes: see the test against dense_topk."""
    probe = materialize(_nearest_cells(queries, "query_id", centres, probes), "cell-probes")
    product = lambda cell, asking, rows: stacked(asking.column("vector")) @ stacked(rows.column("vector")).T
    return ranked(in_cells(probe, index, product, k), k, F.desc("score"), F.col("id"))


def with_fallback(filtered: DataFrame, unfiltered: DataFrame) -> DataFrame:
    """The filtered hits, and the unfiltered ones of queries that the filter left empty."""
    names = filtered.columns
    empty = unfiltered.join(filtered.select("query_id").distinct(), "query_id", "left_anti")
    return filtered.withColumn("fallback", F.lit(False)).unionByName(empty.select(*names).withColumn("fallback", F.lit(True)))


def search_weights(page_type: Column, complexity: Column, density: Column) -> tuple[Column, Column]:
    """(dense, sparse) weights by metadata: exact matching for API pages, meaning for complex or dense ones."""
    dense = F.when(page_type == "api", 0.3).when(complexity > 0.7, 0.7).when(density > 0.6, 0.6).otherwise(0.5)
    return dense, F.round(1 - dense, 1)


def rerank(hits: DataFrame, top_n: int, most_chars: int = 384, scorer=None, ties: Column | None = None) -> DataFrame:
    """hits(query_id, id, query_text, text) rescored and cut. The default scorer is the share of
    query words in the text's first characters plus the Jaccard similarity of both. Equal scores stand
    in the order of ties, if given, then of id."""
    return ranked(hits.withColumn("rerank_score", F.round((scorer or coverage_score)(F.col("query_text"), F.substring("text", 1, most_chars)), 9)),
                  top_n, F.desc("rerank_score"), *([] if ties is None else [ties]), F.col("id"))


class Scorer(Protocol):
    """Loaded once in a task; scores pairs of a query and a text."""

    def __call__(self, queries: list[str], texts: list[str]) -> np.ndarray: ...


def rerank_by_model(hits: DataFrame, load: Callable[[], Scorer], top_n: int, most_chars: int = 384, batch: int = 256) -> DataFrame:
    """hits(query_id, id, query_text, text, rank, ...) rescored by a model and cut, with rerank_score and reranked. The columns
    stay. A batch that the model fails on is scored like rerank(), with reranked false; null texts count as empty."""
    ship(hits.sparkSession)

    def run(batches):
        model = load()
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                queries, texts = ([t or "" for t in part.column(c).to_pylist()] for c in ("query_text", "_text"))
                try:
                    score = pa.array(np.asarray(model(queries, texts), np.float64).reshape(part.num_rows))
                except Exception:  # whatever a model raises, its rows keep a place
                    score = pa.nulls(part.num_rows, pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, score], names=[*part.schema.names, "_score"])

    cut = hits.withColumn("_text", F.substring("text", 1, most_chars))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", _score double"
    scored = cut.mapInArrow(run, schema).withColumn("reranked", F.col("_score").isNotNull())
    score = F.round(F.coalesce("_score", coverage_score(F.col("query_text"), F.col("_text"))), 9)
    return ranked(scored.withColumn("rerank_score", score).drop("_text", "_score"), top_n, F.desc("rerank_score"), F.col("id"))


def hit_records(hits: DataFrame) -> DataFrame:
    """hits(query_id, id, score, ...) in the form all searches share: id as text, score 0.0 where there is none, and the other columns as a
    payload without its nulls."""
    rest = [c for c in hits.columns if c not in ("query_id", "id", "score")]
    pairs = [F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("string").alias("value")) for c in rest]
    payload = F.map_from_entries(F.filter(F.array(*pairs), lambda x: x["value"].isNotNull())) if pairs else F.create_map().cast("map<string,string>")
    return hits.select("query_id", F.col("id").cast("string").alias("id"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), payload.alias("payload"))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def coverage_score(query: Column, text: Column) -> Column:
    q, t = word_set(query), word_set(text)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(0.0) + jaccard(q, t)
