"""From raw documents to the index table: detect, normalise, chunk, embed, upsert what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, index
from ..operators.embed import hashed_vectors


def normalised(raw: DataFrame) -> DataFrame:
    """raw(doc_id, uri, text) with format, title and cleaned text."""
    kind = T.detect_format(F.col("uri"), F.col("text"))
    title = F.regexp_extract("text", r"(?m)^\s*#\s+(.+?)\s*$", 1)
    page_title = F.regexp_extract("text", r"(?is)<title[^>]*>\s*(.*?)\s*</title>", 1)
    out = raw.withColumns({"format": kind, "title": F.when(kind == "html", page_title).otherwise(title)})
    clean = (
        F.when(F.col("format") == "html", T.html_clean(F.col("text")))
        .when(F.col("format") == "markdown", T.mdx_clean(T.strip_frontmatter(F.col("text"))))
        .otherwise(T.strip(F.col("text")))
    )
    return out.withColumn("text", T.normalize_whitespace(clean)).where(T.quality_reason(F.col("text")) == "")


def build(raw: DataFrame, state: DataFrame, now: Column, cfg: chunking.ChunkConfig = chunking.PRODUCTION) -> tuple[DataFrame, DataFrame]:
    """raw(doc_id, source, uri, text, mtime), state(doc_key, content_hash, mtime) -> (points of changed documents, new state).

    Narrow from the scan to the points but for the join with the state."""
    keyed = raw.withColumns({"doc_key": index.document_key(F.col("source"), F.col("uri")), "content_hash": F.sha2("text", 256)})
    fresh = index.changed(keyed, state)
    docs = normalised(fresh)
    chunks = chunking.chunk_documents(docs.withColumn("format", F.when(F.col("format") == "html", "html").otherwise("markdown")), "doc_id", cfg=cfg)
    points = hashed_vectors(chunks, "chunk_id", F.col("text"), tuple(c for c in chunks.columns if c != "chunk_id"))
    points = points.withColumn("id", index.point_id(F.col("chunk_id"), F.lit(None).cast("string"), F.col("chunk_index"), F.col("text")))
    updated = fresh.select("doc_key", "content_hash", "mtime", F.lit(1).alias("version")).unionByName(state.select("doc_key", "content_hash", "mtime", F.lit(0).alias("version")))
    return index.payload(points, now, "pipeline"), index.latest(updated, ["doc_key"], F.desc("version")).drop("version")
