"""Column expressions over URLs and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of

EXCLUDED = (".pdf", ".doc", ".docx", ".zip", ".tar.gz")


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def is_crawlable(url: Column, base: Column | None = None) -> Column:
    """http or https, on the base's host if one is given, and no download."""
    low = F.lower(url)
    ok = url.rlike("^https?://") & ~low.rlike(r"(?:\.pdf|\.doc|\.docx|\.zip|\.tar\.gz)$")
    return ok if base is None else ok & (host(url) == host(base))


def section(url: Column) -> Column:
    parts = F.filter(F.split(path(url), "/"), lambda p: p != "")
    first, second = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    return F.when(first == "docs", second).when(first == "blog", "changelog").otherwise(first)


def role(url: Column) -> Column:
    parts = F.filter(F.split(path(url), "/"), lambda p: p != "")
    first, second = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    docs = (
        F.when(second.isNull(), F.lit(None))
        .when(second.isin("agent", "admin", "supervisor", "integrator"), second)
        .when(second == "api", "integrator")
        .otherwise("all")
    )
    return F.when(first.isNull(), F.lit(None)).when(first == "docs", docs).otherwise("all")


def page_type(url: Column) -> Column:
    low = F.lower(url)
    return (
        F.when(low.contains("api"), "api")
        .when(low.contains("faq"), "faq")
        .when(any_of(low, ("blog", "changelog")), "changelog")
        .when(
            any_of(low, ("guide", "docs")),
            F.when(low.contains("admin"), "admin")
            .when(low.contains("supervisor"), "supervisor")
            .when(low.contains("agent"), "agent")
            .otherwise("guide"),
        )
        .otherwise("unknown")
    )


def page_class(url: Column) -> Column:
    """The source plugins' variant."""
    low = F.lower(url)
    return (
        F.when(low.contains("faq"), "faq")
        .when(low.contains("api"), "api")
        .when(any_of(low, ("release", "changelog", "blog")), "release_notes")
        .otherwise("guide")
    )


def depth(url: Column) -> Column:
    """Segments, scheme and host included."""
    return F.size(F.filter(F.split(url, "/"), lambda s: s != ""))


def path_to_url(rel: Column, base: str, prefix: str, all_levels: bool = True) -> Column:
    """The page's address: extension and numeric prefixes dropped."""
    bare = F.regexp_replace(rel, r"\.[^./]*$", "")
    parts = F.split(bare, "/")
    drop = lambda s: F.regexp_replace(s, r"^\d+-", "")
    parts = F.transform(parts, drop) if all_levels else F.transform(parts, lambda s, i: F.when(i == 0, drop(s)).otherwise(s))
    lead = base.rstrip("/") + ("/" + prefix.strip("/") if prefix.strip("/") else "")
    return F.concat(F.lit(lead + "/"), F.array_join(parts, "/"))


def canonical(url: Column) -> Column:
    return F.regexp_replace(url, "^http://", "https://")


def canonical_pages(url: Column, site: str, aliases: dict[str, str]) -> Column:
    """canonical(), and on the site (https://host) a path of aliases, with or without a slash behind it, is the page it stands for."""
    plain = canonical(url)
    out = plain
    for path_, page in aliases.items():
        out = F.when(F.regexp_replace(plain, "/+$", "").isin(site + path_.rstrip("/"), site + page.rstrip("/")), F.lit(site + page)).otherwise(out)
    return out
