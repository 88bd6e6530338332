"""Sources: documentation trees, local folders, crawled pages, sitemaps, reader texts, configuration, plugins."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..shipping import ship
from ..written import materialize
from . import dom

# ---------------------------------------------------------------- configuration and plugins


def overlay(base: dict, over: dict) -> dict:
    """base with over laid on it, nested maps merged."""
    out = dict(base)
    for k, v in over.items():
        out[k] = overlay(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def source_configs(config: dict, profile: str | None = None, supported=("docusaurus", "website", "local")) -> list[dict]:
    """Enabled sources of supported types, with global defaults and the profile's overlay."""
    if profile:
        config = overlay(config, config.get("profiles", {}).get(profile, {}))
    out = []
    for name, types in config.get("sources", {}).items():
        for kind, cfg in (types or {}).items():
            if kind in supported and isinstance(cfg, dict) and cfg.get("enabled", True):
                out.append({**overlay(config.get("global", {}), cfg), "name": name, "type": kind})
    return out


_plugins: dict[str, Callable[..., DataFrame]] = {}


def register(name: str):
    def add(f: Callable[..., DataFrame]):
        _plugins[name] = f
        return f

    return add


def unregister(name: str) -> None:
    _plugins.pop(name, None)


def plugins() -> list[str]:
    return sorted(_plugins)


def read(spark: SparkSession, name: str, **options) -> DataFrame:
    return _plugins[name](spark, **options)


# ---------------------------------------------------------------- files


@register("docusaurus")
def documentation(spark: SparkSession, root: str, site_base: str, prefix: str = "docs", all_levels: bool = True, max_pages: int | None = None,
                  mapper: Callable[[Column], dict[str, Column]] | None = None) -> DataFrame:
    """Markdown files under root: uri, rel_path, mtime, content, site_url, file_extension, source, and what mapper makes of
    rel_path; a mapped null leaves a column of that name as it was. max_pages takes the first by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,mdx}").load(root)
    base = re.sub(r"^\w+:/*", "/", root).rstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", "/"), "^" + re.escape(base) + "/", "")
    out = files.select(F.col("path").alias("uri"), rel.alias("rel_path"), F.col("modificationTime").alias("mtime"), F.col("content"))
    out = out.withColumn("site_url", U.path_to_url(F.col("rel_path"), site_base, prefix, all_levels))
    out = out.withColumns({"file_extension": F.regexp_extract("rel_path", r"(\.[^./]*)$", 1), "source": F.lit("docusaurus")})
    for name, value in (mapper(F.col("rel_path")) if mapper else {}).items():
        out = out.withColumn(name, F.coalesce(value, F.col(name)) if name in out.columns else value)
    return out.orderBy("rel_path").limit(max_pages) if max_pages else out


def _single_byte(data: bytes) -> str:
    try:
        return data.decode("cp1251")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def decoded(content: Column) -> Column:
    """UTF-8, else Windows-1251, else Latin-1 (the JVM functions know UTF-8 only)."""
    ship(SparkSession.active())

    @F.pandas_udf("string")
    def other(column: pd.Series) -> pd.Series:
        return column.map(_single_byte, na_action="ignore")

    utf8 = F.try_validate_utf8(content.cast("string"))
    return F.coalesce(utf8, other(F.when(utf8.isNull(), content)))


@register("local")
def local_folder(spark: SparkSession, root: str, glob: str = "*.{md,txt,html,htm}") -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    docs = files.select(F.col("path").alias("uri"), F.col("modificationTime").alias("mtime"), F.col("content")).withColumn("text", decoded(F.col("content")))
    title = (
        F.when(F.lower("uri").rlike(r"\.html?$"), F.regexp_extract("text", r"(?is)<title[^>]*>\s*(.*?)\s*</title>", 1))
        .when(F.lower("uri").endswith(".md"), F.regexp_extract("text", r"(?m)^\s*#\s+(.+?)\s*$", 1))
        .otherwise("")
    )
    stem = F.regexp_extract("uri", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return docs.withColumn("title", F.when(title != "", title).otherwise(stem)).drop("content")


def category_labels(spark: SparkSession, root: str) -> DataFrame:
    """dir, label from the _category_.json files of a documentation tree. Spark's readers pass over
    names with a leading underscore, so these few files are listed and read through the file system."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base, rows = fs.makeQualified(top).toUri().getPath().rstrip("/"), []
    files = fs.listFiles(top, True)
    while files.hasNext():
        path = files.next().getPath()
        if path.getName() == "_category_.json":
            stream = fs.open(path)
            try:
                label = json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")).get("label")
            finally:
                stream.close()
            if label:
                rows.append((path.getParent().toUri().getPath()[len(base) :].strip("/"), label))
    return spark.createDataFrame(rows, "dir string, label string")


# ---------------------------------------------------------------- web pages


def parse_pages(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, title, text, links (absolute, without fragments, each once)."""
    return dom.page_documents(pages, ("title", "text", "links")).select("page_id", "url", "title", "text", F.array_distinct("links").alias("links"))


def crawl(pages: DataFrame, start: str, max_pages: int, per_page: int = 20) -> DataFrame:
    """Breadth-first order over stored pages: url, depth. Of a page's links those that may be crawled count, the
    first per_page of them. A page comes after those of lower depth, and among its own in the order in which
    pages before it name it: a place is its parent's place and the link's number. Each round joins the edge's
    links with the pages and leaves out what was visited; only counts reach the driver."""
    links = dom.page_documents(pages, ("links",)).select("url", "links")
    links = links.select("url", F.slice(F.filter("links", lambda x: U.is_crawlable(x, F.lit(start))), 1, per_page).alias("links"))
    links = materialize(links.dropDuplicates(["url"]), "crawl-links")
    first = pages.sparkSession.createDataFrame([(start, 0, [0])], "url string, depth int, place array<int>")
    edge = materialize(first.join(links.select("url"), "url", "left_semi"), "crawl-edge")
    visited, depth, n = edge, 0, edge.count()
    while n < max_pages:
        found = edge.join(links, "url").select("place", F.posexplode("links").alias("k", "url"))
        found = found.groupBy("url").agg(F.min(F.concat("place", F.array("k"))).alias("place"))
        fresh = found.join(links.select("url"), "url", "left_semi").join(visited.select("url"), "url", "left_anti")
        depth += 1
        edge = materialize(fresh.select("url", F.lit(depth).alias("depth"), "place"), "crawl-edge")
        more = edge.count()
        if not more:
            break
        visited, n = visited.unionByName(edge), n + more
    return visited.orderBy("depth", "place").limit(max_pages).select("url", "depth")


def sitemaps(files: DataFrame, host: str, deny: tuple[str, ...] = ()) -> DataFrame:
    """files(uri, xml) -> url, uri, position of the locations on the host, each where it stands first, denied prefixes left out."""
    each = files.select("uri", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("position", "url"))
    kept = each.where(U.host(F.col("url")) == host)
    for prefix in deny:
        kept = kept.where(~U.path(F.col("url")).startswith(prefix))
    return kept.groupBy("url").agg(F.min(F.struct("uri", "position")).alias("at")).select("url", "at.uri", "at.position")


def sitemap(spark: SparkSession, text: str, host: str, deny: tuple[str, ...] = ()) -> DataFrame:
    """position, url of one sitemap's locations."""
    return sitemaps(spark.createDataFrame([("", text)], "uri string, xml string"), host, deny).select("url", "position")


def reader_pages(texts: DataFrame) -> DataFrame:
    """texts(uri, text) of a page reader -> title, url and body."""
    head = lambda name: F.regexp_extract("text", rf"(?m)^{name}:[ \t]*(.*)$", 1)
    return texts.select(
        "uri",
        F.trim(F.split_part(head("Title"), F.lit("|"), F.lit(1))).alias("title"),
        F.trim(head("URL Source")).alias("url"),
        F.trim(head("Published Time")).alias("published"),
        T.strip(F.regexp_extract("text", r"(?s)Markdown Content:\n?(.*)\z", 1)).alias("text"),
    )
