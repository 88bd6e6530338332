"""Steps that bring raw pages into one form; each is a transformation of a table, for steps.Pipeline or DataFrame.transform."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .steps import Step


def repaired(df: DataFrame) -> DataFrame:
    """content or text -> text without bytes that are no UTF-8, with one kind of line ends and single blanks; null is empty."""
    raw = T.repaired_utf8(F.col("content")) if "content" in df.columns else F.col("text")
    return df.withColumn("text", F.coalesce(T.normalize_whitespace(raw), F.lit("")))


def flagged(name: str) -> Step:
    """Marks rows as normalised, and by what; the first normaliser's name stays."""

    def step(df: DataFrame) -> DataFrame:
        old = F.col("normalizer") if "normalizer" in df.columns else F.lit(None).cast("string")
        return df.withColumns({"normalized": F.lit(True), "normalizer": F.coalesce(old, F.lit(name))})

    return step


def documentation_page(site_base: str) -> Step:
    """text, rel_path -> head (title, category, description, sidebar_position, content_type) and the text without its head and mark-up."""

    def step(df: DataFrame) -> DataFrame:
        head = T.document_head(F.col("text"), T.stem_title(F.col("rel_path")), F.lower("rel_path").endswith(".md"))
        body = T.normalize_whitespace(T.mdx_clean(T.strip_frontmatter(F.col("text"))))
        return df.withColumns({"head": head, "text": body, "site_base_url": F.lit(site_base)}).transform(flagged("docusaurus"))

    return step


def html_page(df: DataFrame) -> DataFrame:
    """text -> text without tags; the head holds the page's title."""
    title = F.nullif(T.strip(F.regexp_extract("text", r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    return df.withColumns({"head": F.struct(title.alias("title")), "text": T.normalize_whitespace(T.html_clean(F.col("text")))}).transform(flagged("html"))


def mapped_urls(site_base: str, prefix: str) -> Step:
    """canonical_url and doc_id: the page's site_url, else the address of the whole documentation."""

    def step(df: DataFrame) -> DataFrame:
        own = F.nullif(F.col("site_url"), F.lit("")) if "site_url" in df.columns else F.lit(None).cast("string")
        return df.withColumn("canonical_url", F.coalesce(own, F.lit(site_base + prefix))).withColumns({"doc_id": F.col("canonical_url"), "url_mapped": F.lit(True)})

    return step


def documentation_steps(site_base: str, prefix: str) -> list[tuple[str, Step]]:
    return [("repaired", repaired), ("page", documentation_page(site_base)), ("urls", mapped_urls(site_base, prefix))]


def website_steps(site_base: str, prefix: str = "") -> list[tuple[str, Step]]:
    return [("repaired", repaired), ("page", html_page), ("urls", mapped_urls(site_base, prefix))]
