"""The index table: point ids, payloads, upserts, changed documents, state, caches, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C

HEAVY = ("content", "html", "raw", "raw_content", "dom")


def uuid_of(text: Column) -> Column:
    """The first 32 hex digits of a SHA-1, as a UUID."""
    h = F.sha1(text)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def point_id(chunk_id: Column, doc_id: Column, chunk_index: Column, text: Column) -> Column:
    by_place = F.when(doc_id.isNotNull() & chunk_index.isNotNull(), F.concat(doc_id, F.lit("#"), chunk_index.cast("string")))
    return uuid_of(F.coalesce(chunk_id, by_place, text))


def payload(df: DataFrame, indexed_at: Column, indexed_via: str) -> DataFrame:
    """Heavy fields dropped, time and way of indexing added."""
    return df.drop(*HEAVY).withColumn("indexed_at", indexed_at).withColumn("indexed_via", F.lit(indexed_via))


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in the given order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def upsert(current: DataFrame, fresh: DataFrame, key: str = "id", good: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(table after the upsert, quarantined rows). Re-running with the same rows changes nothing.
    fresh wins over current, among fresh rows the last version (column version, then all columns) wins."""
    bad = fresh.where(~good) if good is not None else fresh.limit(0)
    fresh = fresh.where(good) if good is not None else fresh
    rows = current.withColumn("__fresh", F.lit(0)).unionByName(fresh.withColumn("__fresh", F.lit(1)), allowMissingColumns=True)
    order = [F.desc("__fresh")] + ([F.desc("version")] if "version" in rows.columns else [])
    return latest(rows, [key], *order, *[F.col(c) for c in current.columns if c != key]).drop("__fresh"), bad


def changed(docs: DataFrame, state: DataFrame) -> DataFrame:
    """docs(doc_key, content_hash, mtime) that are new or differ from state in hash or time; with reason."""
    s = state.select("doc_key", F.col("content_hash").alias("old_hash"), F.col("mtime").alias("old_mtime"))
    reason = (
        F.when(F.col("old_hash").isNull(), "new")
        .when(F.col("old_hash") != F.col("content_hash"), "content")
        .when(F.col("old_mtime") != F.col("mtime"), "mtime")
    )
    return docs.join(s, "doc_key", "left").withColumn("reason", reason).where("reason IS NOT NULL").drop("old_hash", "old_mtime")


def document_key(source: Column, uri: Column) -> Column:
    return F.sha1(F.concat_ws(":", source, uri))


def expired(state: DataFrame, as_of: Column, days: int = C.EXPIRY_DAYS) -> DataFrame:
    return state.where(F.col("last_checked") < as_of - F.expr(f"INTERVAL {days} DAYS"))


def state_statistics(state: DataFrame) -> DataFrame:
    return state.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.max("indexed_at").alias("last_indexed"))


def orphans(cache: DataFrame, live: DataFrame, key: str = "url") -> DataFrame:
    """Cached pages whose address is gone."""
    return cache.join(live.select(key).distinct(), key, "left_anti")


def cache_entries(pages: DataFrame) -> DataFrame:
    """File key by address, hash of the content."""
    return pages.select("url", F.md5("url").alias("file_key"), F.sha2("content", 256).alias("content_hash"), F.length("content").alias("content_length"))


def freshness(cache: DataFrame, pages: DataFrame) -> DataFrame:
    """pages(url, content) with fresh: whether the cache(url, content_hash) holds the page as it is."""
    held = cache.select("url", F.col("content_hash").alias("__hash"))
    return pages.join(held, "url", "left").withColumn("fresh", F.coalesce(F.sha2("content", 256) == F.col("__hash"), F.lit(False))).drop("__hash")


def ordered_distinct(df: DataFrame, key: str, order: str) -> DataFrame:
    """Each key once, at its first position."""
    return df.groupBy(key).agg(F.min(order).alias(order))


def coverage(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Characters of each document that its chunks carry, in per cent."""
    c = chunks.groupBy("doc_id").agg(F.sum(F.length("text")).alias("chunk_chars"), F.count(F.lit(1)).alias("n_chunks"))
    return docs.select("doc_id", F.length("text").alias("chars")).join(c, "doc_id", "left").select(
        "doc_id",
        F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
        F.when(F.col("chars") > 0, F.round(F.coalesce("chunk_chars", F.lit(0)) * 100.0 / F.col("chars"), 4)).otherwise(0.0).alias("percent"),
    )


def ancestors(rel_path: Column) -> Column:
    """Directories from the root down to the file's own."""
    parts = F.split(rel_path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def directory_labels(files: DataFrame, labels: DataFrame) -> DataFrame:
    """files(rel_path), labels(dir, label) -> labels joined by |, current_label, breadcrumbs joined by ' > '."""
    has_dir = F.size(F.split("rel_path", "/")) > 1
    each = files.where(has_dir).select("rel_path", F.posexplode(ancestors(F.col("rel_path"))).alias("level", "dir"))
    found = each.join(labels, "dir").groupBy("rel_path").agg(F.sort_array(F.collect_list(F.struct("level", "label"))).alias("l"))
    names = F.transform("l", lambda x: x["label"])
    return files.join(found, "rel_path", "left").select(
        "rel_path",
        F.array_join(names, "|").alias("labels"),
        F.try_element_at(names, F.lit(-1)).alias("current_label"),
        F.array_join(names, " > ").alias("breadcrumbs"),
    )


def top_directory_metadata(files: DataFrame, extra: DataFrame) -> DataFrame:
    """files(rel_path, category map), extra(top_dir, extra map): top_level_dir, then extra, then category; the first that has a key wins."""
    top = F.when(F.size(F.split("rel_path", "/")) > 1, F.split_part("rel_path", F.lit("/"), F.lit(1)))
    joined = files.withColumn("top_dir", top).join(extra, "top_dir", "left")
    empty = F.create_map().cast("map<string,string>")
    extra_map, category = F.coalesce("extra", empty), F.coalesce("category", empty)
    own = F.when(F.col("top_dir").isNotNull(), F.create_map(F.lit("top_level_dir"), F.col("top_dir"))).otherwise(empty)
    extra_new = F.map_filter(extra_map, lambda k, v: k != "top_level_dir")
    rest = F.map_filter(category, lambda k, v: (k != "top_level_dir") & ~F.map_contains_key(extra_map, k))
    return joined.select("rel_path", F.map_concat(own, extra_new, rest).alias("meta"))


def theme_metadata(rel_path: Column, domain: str, by_dir: dict[str, dict[str, str]], role_by_section: dict[str, str] | None = None,
                   fixed: dict[str, str] | None = None, default: dict[str, str] | None = None) -> Column:
    """struct(domain, section, platform, role, page_type) of a file by its top directory, without number
    and in lower case. section, platform and role: a fixed value, else that of the directory (of
    the section for role), else the default; page_type by directory only. by_dir: field -> directory -> value."""
    fixed, default = fixed or {}, default or {}
    top = F.lower(F.regexp_replace(F.split_part(F.coalesce(rel_path, F.lit("")), F.lit("/"), F.lit(1)), r"^\d+-", ""))

    def lookup(values: dict[str, str] | None, key: Column) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key) if values else F.lit(None).cast("string")

    def chosen(field: str, found: Column) -> Column:
        return F.coalesce(F.lit(fixed.get(field)).cast("string"), found, F.lit(default.get(field)).cast("string"))

    section = chosen("section", lookup(by_dir.get("section"), top))
    return F.struct(
        F.lit(domain).alias("domain"),
        section.alias("section"),
        chosen("platform", lookup(by_dir.get("platform"), top)).alias("platform"),
        chosen("role", lookup(role_by_section, section)).alias("role"),
        lookup(by_dir.get("page_type"), top).alias("page_type"),
    )


def chunk_metrics(chunks: DataFrame, group: str, low: int = 410, high: int = 614) -> DataFrame:
    """Chunks, their tokens and the share of them that have between low and high."""
    n = F.count(F.lit(1))
    return chunks.groupBy(group).agg(
        n.alias("n"),
        F.sum("n_tokens").alias("tokens"),
        F.round(F.avg("n_tokens"), 6).alias("mean"),
        F.round(F.count_if(F.col("n_tokens").between(low, high)) / n, 6).alias("optimal"),
    )


def chunk_size(page_type: Column, complexity: Column | None = None, size: int = 800) -> Column:
    """Chunk size by page type; for other types by complexity, if it is known."""
    rest = F.lit(size)
    if complexity is not None:
        rest = F.when(complexity > 0.8, min(int(size * 0.9), 800)).when(complexity < 0.3, min(int(size * 1.3), 1000)).otherwise(size)
    return (
        F.when(page_type == "api", min(int(size * 1.5), 1200))
        .when(page_type == "guide", min(int(size * 1.2), 1000))
        .when(page_type == "faq", min(int(size * 0.8), 600))
        .otherwise(rest)
    )


def scroll(chunks: DataFrame, doc_id) -> DataFrame:
    """All chunks of one document in order; the filter reaches the scan."""
    return chunks.where(F.col("doc_id") == doc_id).orderBy("chunk_index")


def quality_check(chunks: DataFrame, group: str) -> DataFrame:
    """Lengths, share of texts with Cyrillic letters, and of rows with a title."""
    n = F.count(F.lit(1))
    return chunks.groupBy(group).agg(
        n.alias("n"),
        F.min(F.length("text")).alias("shortest"),
        F.max(F.length("text")).alias("longest"),
        F.round(F.count_if(F.lower("text").rlike("[а-яё]")) / n, 6).alias("cyrillic"),
        F.round(F.count_if(F.length(F.trim(F.coalesce("title", F.lit("")))) > 0) / n, 6).alias("titled"),
    )
