"""Neighbour merging, budgets, truncation, ordering, sources, answers."""

from __future__ import annotations

import re
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import context_tokens, merge_tokens
from ..shipping import ship
from ..written import materialize

# ---------------------------------------------------------------- merging of neighbours


def merge_document(hits: list[tuple[int, int]], chunks: dict[int, tuple[str, str]], budget: int) -> list[dict]:
    """hits (chunk_index, rank) of one query and document, chunks by index (chunk_id, text).

    Hits are taken by index. Around each one that no window covers yet, a window grows by the
    chunk on its left, then on its right, round after round, while it stays within the budget
    (text lengths by quarters, one token at least) and takes no covered chunk. The window's
    rank is the best of the hits in it. Hits without a chunk pass through alone."""

    def cost(index: int) -> int:
        n = len(chunks[index][1])
        return max(1, n // 4) if n else 0

    ranks: dict[int, int] = {}
    for index, rank in hits:
        ranks[index] = min(rank, ranks.get(index, rank))
    covered: set[int] = set()
    out = []
    for index in sorted(ranks):
        if index in covered:
            continue
        if index not in chunks:
            out.append({"indices": [index], "text": None, "rank": ranks[index]})
            continue
        low = high = index
        total = cost(index)
        grew = True
        while grew:
            grew = False
            for side in (low - 1, high + 1):
                if side in chunks and side not in covered and total + cost(side) <= budget:
                    total += cost(side)
                    low, high, grew = min(low, side), max(high, side), True
        window = list(range(low, high + 1))
        covered.update(window)
        out.append({"indices": window, "text": "\n\n".join(chunks[i][1] for i in window), "rank": min(ranks[i] for i in window if i in ranks)})
    return out


MERGED = ["query_id", "doc_id", "merged_chunk_indices", "merged_chunk_ids", "merged_chunk_count", "auto_merged", "text"]


def windows(hits: list[tuple[int, int]], cost: dict[int, int], budget: int) -> list[tuple[int, int, int]]:
    """(first place, last place, best rank) of the windows that merge_document() makes of hits (place, rank)."""
    ranks: dict[int, int] = {}
    for place, rank in hits:
        ranks[place] = min(rank, ranks.get(place, rank))
    covered: set[int] = set()
    out = []
    for place in sorted(ranks):
        if place in covered:
            continue
        low = high = place
        left, grew = budget - cost[place], True
        while grew:
            grew = False
            for side in (low - 1, high + 1):
                if side in cost and side not in covered and cost[side] <= left:
                    left -= cost[side]
                    low, high, grew = min(low, side), max(high, side), True
        covered.update(range(low, high + 1))
        out.append((low, high, min(ranks[i] for i in range(low, high + 1) if i in ranks)))
    return out


def _merged(budget: int):
    """Rows (query_id, doc_id, place, cost, rank or null) of whole groups, in order -> query_id, doc_id, low, high, hit_rank."""

    def run(batches):
        held = None  # the group that the next batch may go on with
        key = lambda r: (r["query_id"], r["doc_id"])
        schema = None

        def closed(rows: list[dict]) -> list[dict]:
            cost = {r["place"]: r["cost"] for r in rows}
            hits = [(r["place"], r["rank"]) for r in rows if r["rank"] is not None]
            return [{"query_id": rows[0]["query_id"], "doc_id": rows[0]["doc_id"], "low": a, "high": e, "hit_rank": k} for a, e, k in windows(hits, cost, budget)]

        for batch in batches:
            schema = schema or pa.schema([batch.schema.field("query_id"), batch.schema.field("doc_id"), ("low", pa.int64()), ("high", pa.int64()), ("hit_rank", pa.int64())])
            out = []
            for k, group in groupby(batch.to_pylist(), key):
                rows = list(group)
                if held and key(held[0]) == k:
                    held += rows
                else:
                    out += closed(held) if held else []
                    held = rows
            yield pa.RecordBatch.from_pylist(out, schema)
        if held:
            yield pa.RecordBatch.from_pylist(closed(held), schema)

    return run


def auto_merge(hits: DataFrame, chunks: DataFrame, budget: int = C.MERGE_TOKENS, tokens: Column | None = None) -> DataFrame:
    """hits(query_id, doc_id, chunk_index, rank[, text]), chunks(doc_id, chunk_index, chunk_id, text)
    -> windows in the order of their best hit, as merge_document() makes them of chunks in the order of their index.
    tokens counts a chunk's text (by default its length in quarters).

    What moves is light: a chunk's place and cost. Sums of costs up to each chunk put it into a bin of the budget's
    width, and a window around a hit cannot leave the hit's bin and its two neighbours, so a hit meets those
    chunks alone and not its document. Texts are joined to the finished windows."""
    ship(hits.sparkSession)
    cost = merge_tokens(F.coalesce("text", F.lit(""))) if tokens is None else tokens
    wanted = hits.select("doc_id").distinct()
    light = chunks.join(wanted, "doc_id", "left_semi").select("doc_id", "chunk_index", cost.cast("long").alias("cost"))
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    before = F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, -1))
    light = light.select("doc_id", "chunk_index", "cost", (F.row_number().over(order) - 1).cast("long").alias("place"), F.floor(F.coalesce(before, F.lit(0)) / (budget + 1)).alias("bin"))
    light = materialize(light, "merge-places")

    text = F.col("text") if "text" in hits.columns else F.lit(None).cast("string")
    best = hits.groupBy("query_id", "doc_id", "chunk_index").agg(F.min(F.col("rank").cast("long")).alias("rank"), F.min_by(text, "rank").alias("text"))
    found = best.join(light, ["doc_id", "chunk_index"], "left")
    placed = materialize(found, "merge-hits")
    bins = placed.where("bin IS NOT NULL").select("query_id", "doc_id", F.explode(F.array(*[F.col("bin") + i for i in (-1, 0, 1)])).alias("bin")).distinct()
    near = light.join(bins, ["doc_id", "bin"]).join(placed.select("query_id", "doc_id", "place", "rank"), ["query_id", "doc_id", "place"], "left")
    rows = near.select("query_id", "doc_id", "place", "cost", "rank").repartition("query_id", "doc_id").sortWithinPartitions("query_id", "doc_id", "place")
    q, d = (rows.schema[c].dataType.simpleString() for c in ("query_id", "doc_id"))
    found = rows.mapInArrow(_merged(budget), f"query_id {q}, doc_id {d}, low long, high long, hit_rank long")

    parts = found.select("*", F.explode(F.sequence("low", "high")).alias("place")).join(light.select("doc_id", "place", "chunk_index"), ["doc_id", "place"])
    parts = parts.join(chunks.select("doc_id", "chunk_index", "chunk_id", "text"), ["doc_id", "chunk_index"])
    part = F.struct("place", F.col("chunk_index").cast("int").alias("chunk_index"), "chunk_id", F.coalesce("text", F.lit("")).alias("text"))
    merged = parts.groupBy("query_id", "doc_id", "low", "hit_rank").agg(F.sort_array(F.collect_list(part)).alias("p"))  # chunks of one window
    merged = merged.select(
        "query_id", "doc_id", F.col("p.chunk_index").alias("merged_chunk_indices"), F.col("p.chunk_id").alias("merged_chunk_ids"), F.size("p").alias("merged_chunk_count"),
        (F.size("p") > 1).alias("auto_merged"), F.array_join("p.text", "\n\n").alias("text"), "hit_rank",
    )
    alone = placed.where("bin IS NULL").select(
        "query_id", "doc_id", F.array(F.col("chunk_index").cast("int")).alias("merged_chunk_indices"), F.array().cast("array<string>").alias("merged_chunk_ids"),
        F.lit(1).alias("merged_chunk_count"), F.lit(False).alias("auto_merged"), "text", F.col("rank").alias("hit_rank"),
    )
    out = merged.unionByName(alone)
    first = Window.partitionBy("query_id").orderBy("hit_rank", "doc_id", F.col("merged_chunk_indices")[0])
    return out.withColumn("rank", F.row_number().over(first)).select(*MERGED, "rank")


# ---------------------------------------------------------------- budgets and order


def budgets(docs: DataFrame, tokens: int = C.CONTEXT_TOKENS, reserve: Column | float = C.RESERVE) -> DataFrame:
    """docs(query_id, rank, …) with max_tokens: the share of each, more for the first ones."""
    reserve = reserve if isinstance(reserve, Column) else F.lit(reserve)
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    each = F.floor(F.floor(F.round(tokens * (1 - reserve), 6)) / n)
    most = F.when(F.col("rank") <= C.FIRST_DOCS, F.least(each * 1.5, F.lit(float(C.FIRST_MOST)))).otherwise(F.least(each, F.lit(C.OTHER_MOST)))
    return docs.withColumn("max_tokens", F.floor(most).cast("int"))


def attention_order(docs: DataFrame, *order: Column) -> DataFrame:
    """position: best ones at both ends. By rank i from 0: even ones from the left, odd ones from the right."""
    w = Window.partitionBy("query_id")
    i = F.row_number().over(w.orderBy(*order)) - 1
    n = F.count(F.lit(1)).over(w)
    ranked = docs.withColumns({"__i": i, "__n": n})
    position = F.when(F.col("__i") % 2 == 0, F.col("__i") / 2).otherwise(F.col("__n") - 1 - (F.col("__i") - 1) / 2).cast("int")
    return ranked.withColumn("position", F.when(F.col("__n") > 2, position).otherwise(F.col("__i"))).drop("__i", "__n")


FENCED = re.compile(r"(?ms)^```.*?(?:^```[^\S\n]*$|\Z)")


def truncate_paragraphs(text: str, most: int) -> str:
    """Whole paragraphs and fences while they fit; the one that does not is cut at a line, and an
    open fence is closed again."""
    if len(text) <= most:
        return text
    parts, at = [], 0
    for m in FENCED.finditer(text):
        parts += [p for p in re.split(r"\n\s*\n", text[at : m.start()]) if p.strip()]
        parts.append(m[0])
        at = m.end()
    parts += [p for p in re.split(r"\n\s*\n", text[at:]) if p.strip()]
    out: list[str] = []
    left = most
    for part in (p.strip("\n") for p in parts):
        if len(part) + 2 * bool(out) <= left:
            left -= len(part) + 2 * bool(out)
            out.append(part)
            continue
        fence = part.startswith("```")
        room = left - 2 * bool(out) - 4 * fence
        cut = part[: max(0, room)]
        cut = cut[: cut.rfind("\n")] if "\n" in cut else "" if fence else cut
        if cut.strip():
            out.append(cut + "\n```" if fence else cut)
        break
    return "\n\n".join(out)


def section(text: str, heading: str, most: int) -> str:
    """From a heading that matches to the next one of its level or higher, at most most characters."""
    m = re.search(heading, text, re.M)
    if not m:
        return ""
    level = len(m[0]) - len(m[0].lstrip("#"))
    end = re.search(rf"^#{{1,{level}}}\s", text[m.end() :], re.M)
    return text[m.start() : m.end() + end.start() if end else len(text)].rstrip()[:most]


def fit_texts(docs: DataFrame) -> DataFrame:
    """docs(text, max_tokens, …) with text cut to its budget (four characters a token)."""
    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def fit(text: pd.Series, most: pd.Series) -> pd.Series:
        return pd.Series([truncate_paragraphs(t or "", int(m)) for t, m in zip(text, most, strict=True)])

    over = context_tokens(F.col("text")) > F.col("max_tokens")
    return docs.withColumns(
        {"original_length": F.length("text"), "text": F.when(over, fit("text", F.col("max_tokens") * 4)).otherwise(F.col("text"))}
    )


def list_answers(docs: DataFrame, heading: str = r"^##\s+Каналы", most: int = 8000, tokens: int = 2250) -> DataFrame:
    """Only the first document of a query: the named section, else the document cut to tokens."""
    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def take(text: pd.Series) -> pd.Series:
        return text.map(lambda t: section(t or "", heading, most) or truncate_paragraphs(t or "", tokens * 4))

    return docs.where("rank = 1").withColumn("text", take("text"))


# ---------------------------------------------------------------- sources and answers


def normalize_url(url: Column) -> Column:
    """Without fragment, query and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(F.trim(url), r"[?#].*$", ""), "/+$", "")


def sources(docs: DataFrame, most: int = C.SOURCES_MOST) -> DataFrame:
    """docs(query_id, rank, query_text, url, title, text) -> the first row of each address, those
    that hold words of the query first, most words first."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("query_text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: F.length(w) >= C.SOURCE_WORD))
    text, title = F.lower(F.coalesce("text", F.lit(""))), F.lower(F.coalesce("title", F.lit("")))
    score = F.size(F.filter(words, lambda w: F.contains(text, w) | F.contains(title, w)))
    found = docs.withColumns({"url": normalize_url(F.col("url")), "score": score}).where("url <> ''")
    first = found.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", "url").orderBy("rank"))).where("__n = 1")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    return first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("query_id", "place", "url", "title", "score")


def context_block(docs: DataFrame) -> DataFrame:
    """query_id, context: the documents in order as one prompt block, and the numbered sources."""
    one = F.concat_ws("\n", F.concat(F.lit("### "), F.col("title")), F.concat(F.lit("Тема: "), F.col("theme_label")), F.col("url"), F.col("text"))
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", c.alias("t")))), lambda x: x["t"]), "\n\n")
    return docs.groupBy("query_id").agg(joined(one).alias("context"))


def sources_block(found: DataFrame) -> DataFrame:
    """sources() -> query_id, block: a numbered line for each source."""
    line = F.struct("place", F.concat(F.col("place").cast("string"), F.lit(". "), F.coalesce("title", F.lit(C.SOURCE_TITLE)), F.lit(": "), F.col("url")).alias("line"))
    return found.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "\n").alias("block"))


def theme_instruction(first: Column, second: Column) -> Column:
    return F.when(
        first.isNotNull() & second.isNotNull(),
        F.concat(F.lit("Если ответ затрагивает несколько тематик, сформируй отдельные разделы соответственно: "), first, F.lit(", "), second, F.lit(".")),
    )


def whitelisted(answer: str, allowed: set[str]) -> str:
    """answer without addresses that are not allowed: a link keeps its label, a bare address goes. Fenced code stays."""

    def norm(url: str) -> str:
        return re.sub(r"[?#].*$", "", url.strip()).rstrip("/")

    def plain(part: str) -> str:
        part = re.sub(r"\[([^\]]+)\]\(([^)]+)\)", lambda m: m[0] if norm(m[2]) in allowed else m[1], part)
        return re.sub(r"https?://[^\s)]+", lambda m: m[0] if norm(m[0]) in allowed else "", part)

    return "".join(p if p.startswith("```") else plain(p) for p in re.split(r"(```.*?```)", answer, flags=re.S))


def whitelist(answers: DataFrame) -> DataFrame:
    """answers(answer, allowed array<string>, …) with only allowed addresses."""
    ship(answers.sparkSession)

    @F.pandas_udf("string")
    def clean(answer: pd.Series, allowed: pd.Series) -> pd.Series:
        return pd.Series([whitelisted(a or "", {re.sub(r"[?#].*$", "", u).rstrip("/") for u in (ok if ok is not None else [])}) for a, ok in zip(answer, allowed, strict=True)])

    return answers.withColumn("answer", clean("answer", "allowed"))


def extractive_answer(docs: DataFrame, sentences: int = 3) -> DataFrame:
    """The offline answer: the sentences of a query's documents that share most words with it."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    each = docs.select("query_id", "rank", "query_text", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("at", "sentence"))
    scored = each.withColumn("score", F.size(F.array_intersect(words("query_text"), words("sentence"))))
    best = scored.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank", "at"))).where(F.col("n") <= sentences)
    return best.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "sentence"))), lambda x: x["sentence"]), " ").alias("answer"))
