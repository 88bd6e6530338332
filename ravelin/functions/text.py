"""Column expressions over text: tokens, clean-up, detection. All but frontmatter_json stay in the JVM."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens of the chunker, in Unicode classes that Java, RE2 and Python agree on.
TOKEN = r"[\p{L}\p{N}_\-/]+|[^\s\p{Z}\p{L}\p{N}_]"
WORD = r"[\p{L}\p{N}_\-/]+"
SPACE = r"[\s\p{Z}]"


def any_of(text: Column, words) -> Column:
    """Whether text contains one of the words, as plain substrings."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words], F.lit(False))


def strip(text: Column) -> Column:
    """Without white space (of any script) at the ends."""
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def words(text: Column) -> Column:
    """Split at white space, without empty parts."""
    return F.filter(F.split(text, rf"{SPACE}+"), lambda w: w != "")


def replace_all(text: Column, rules) -> Column:
    return reduce(lambda t, rule: F.regexp_replace(t, rule[0], rule[1]), rules, text)


def token_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))


def merge_tokens(text: Column) -> Column:
    """Budget unit of neighbour merging: a quarter of the length, 1 at least unless empty."""
    n = F.length(text)
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.floor(n / 4), F.lit(1))).cast("long")


def context_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / F.lit(3.5)).cast("long")


def word_tokens(text: Column) -> Column:
    return F.floor(F.size(words(text)) * F.lit(1.3)).cast("long")


def size_category(tokens: Column) -> Column:
    return F.when(tokens < 300, "short").when(tokens < 800, "medium").otherwise("long")


def truncate_words(text: Column, most: int) -> Column:
    w = words(text)
    return F.when(F.size(w) <= most, text).otherwise(F.array_join(F.slice(w, 1, most), " "))


# Ordered clean-up rules (pattern, replacement).
WHITESPACE_RULES = ((r"[ \t]+", " "), (r"\n{3,}", "\n\n"))
MDX_RULES = (
    (r"(?m)^\s*(?:import|export)\b[^\n]*\n", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"(?s)::: *(?:tip|note|info|warning|caution|danger)\s*(.*?)\s*:::", "$1"),
    (r"<[A-Z][A-Za-z0-9]*(?:\s[^<>]*?)?/>", ""),
    (r"</?[A-Z][A-Za-z0-9]*(?:\s[^<>]*?)?>", ""),
    (r"</?(?:details|summary)[^>]*>", ""),
    (r"<[^>]+>", ""),
    (r"[ \t]+", " "),
    (r" \n", "\n"),
    (r"\n ", "\n"),
    (r"\n{3,}", "\n\n"),
)
HTML_RULES = (
    *((rf"(?is)<{t}[^>]*>.*?</{t}>", "") for t in ("script", "style", "nav", "header", "footer")),
    (r"<[^>]+>", ""),
    (r"\s+", " "),
)
FLATTEN_RULES = (
    (r"(?m)^#{1,6} +", ""),
    (r"\*\*([^*]+)\*\*", "$1"),
    (r"\*([^*]+)\*", "$1"),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
)
LOG_RULES = (
    ("[​-‍﻿]", ""),
    ("–", "-"), ("—", "--"), ("[‘’]", "'"), ("[“”]", '"'),
)
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
LINK_RULES = (
    (r"\[([^\]]+)\]\(([^)]+)\)", "$1 (см. $2)"),
    (r'<a[^>]+href="([^"]+)"[^>]*>([^<]+)</a>', "$2 (см. $1)"),
)


def mdx_clean(text: Column) -> Column:
    return strip(replace_all(text, MDX_RULES))


def html_clean(text: Column) -> Column:
    return strip(replace_all(text, HTML_RULES))


def normalize_whitespace(text: Column) -> Column:
    return strip(replace_all(text, WHITESPACE_RULES))


def flatten_markdown(text: Column) -> Column:
    return replace_all(text, FLATTEN_RULES)


def clean_for_processing(text: Column) -> Column:
    return F.regexp_replace(strip(F.regexp_replace(text, r"\s+", " ")), CONTROL, "")


def clean_for_logging(text: Column) -> Column:
    return replace_all(text, LOG_RULES)


def content_refs(text: Column, base: str) -> Column:
    """Content references as 'label (см. url)'; a path gets the site's base."""
    ref = r"(?s)<ContentRef\s+url=['\"]{}['\"]>\s*(.*?)\s*</ContentRef>"
    local = F.regexp_replace(text, ref.format(r"(/[^'\"]*)"), f"$2 (см. {base.rstrip('/')}$1)")
    return F.regexp_replace(local, ref.format(r"([^'\"]+)"), "$2 (см. $1)")


def repaired_utf8(content: Column) -> Column:
    """Bytes as text; bytes that are no UTF-8 are dropped."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit("")))


def strip_frontmatter(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n", "")


def quality_reason(text: Column, least: int = 10) -> Column:
    """Why a text is unfit, or an empty string."""
    clean = clean_for_processing(text)
    return (
        F.when(text.isNull() | (strip(text) == ""), "empty")
        .when(F.length(clean) < least, "short")
        .when(~F.lower(clean).rlike("[а-яёa-z]"), "no letters")
        .when(clean.rlike(r"\A[^\s\p{L}\p{N}_]+\z"), "symbols only")
        .otherwise("")
    )


def detect_format(uri: Column, text: Column) -> Column:
    """markdown, html or text: by extension, then by what the text begins with."""
    path, head = F.lower(uri), F.lower(text)
    return (
        F.when(path.endswith(".md") | path.endswith(".mdx"), "markdown")
        .when(path.endswith(".html") | path.endswith(".htm"), "html")
        .when(head.startswith("<!doctype") | head.startswith("<html"), "html")
        .when(text.startswith("#") | text.contains("```"), "markdown")
        .otherwise("text")
    )


def detect_content_type(text: Column) -> Column:
    low = F.lower(strip(text))
    lines = F.slice(F.split(text, "\n"), 1, 10)
    marked = F.size(F.filter(lines, lambda x: strip(x).startswith("#") | strip(x).startswith("*")))
    return (
        F.when(text.isNull() | (strip(text) == ""), "empty")
        .when(text.startswith("Title:") | text.contains("URL Source:") | text.contains("Markdown Content:"), "reader")
        .when(any_of(text, ("theme-doc-breadcrumbs", "theme-doc-markdown", "theme-doc-sidebar")), "html_site")
        .when(low.contains("<html") | low.contains("<!doctype"), "html_generic")
        .when(marked >= 2, "markdown")
        .otherwise("text")
    )


def language(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.rlike("[а-яё]"), "ru").when(low.rlike("[a-z]"), "en").otherwise("unknown")


BLOCKED = (
    r"(?is)<script.*?>.*?</script>", r"(?is)javascript:", r"(?is)on[\p{L}\p{N}_]+\s*=", r"(?is)data:text/html",
    r"(?is)vbscript:", r"(?is)<iframe.*?>.*?</iframe>", r"(?is)<object.*?>.*?</object>", r"(?is)<embed.*?>",
    r"(?is)<link.*?>", r"(?is)<meta.*?>", r"(?is)<style.*?>.*?</style>", r"(?is)<form.*?>.*?</form>",
)
MESSAGE_MOST = 2000


def sanitize(text: Column) -> Column:
    """Escaped for HTML, without blocked patterns, clamped, with single spaces. Escaping comes first."""
    out = text
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    for pattern in BLOCKED:
        out = F.regexp_replace(out, pattern, "")
    return strip(F.regexp_replace(F.substring(out, 1, MESSAGE_MOST), rf"{SPACE}+", " "))


def is_safe(text: Column) -> Column:
    """No blocked pattern in the raw text; null and empty texts are safe."""
    found = reduce(lambda a, b: a | b, [text.rlike(p) for p in BLOCKED])
    return text.isNull() | (text == "") | ~found


def headers(html: Column) -> Column:
    """Texts of the first three heading levels, tags taken off."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>"), F.lit(1))
    return F.transform(found, lambda h: F.trim(F.regexp_replace(h, "<[^>]+>", "")))


def frontmatter(text: Column) -> Column:
    """map of the top-level scalars of a YAML head; nested values are left to frontmatter_json."""
    head = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---\n", 1)
    lines = F.regexp_extract_all(head, F.lit(r"(?m)^([A-Za-z_][\w-]*):[ \t]*(\S.*)$"), F.lit(0))
    key = lambda x: F.regexp_extract(x, r"^([A-Za-z_][\w-]*):", 1)
    value = lambda x: F.regexp_replace(F.regexp_replace(x, r"^[A-Za-z_][\w-]*:\s*", ""), r"^[\"']|[\"']\s*$|\s+$", "")
    return F.map_from_entries(F.transform(lines, lambda x: F.struct(key(x).alias("key"), value(x).alias("value"))))


def frontmatter_json(text: Column) -> Column:
    """The whole YAML head as JSON; null where there is none or it cannot be read."""
    @F.pandas_udf("string")
    def read(heads: pd.Series) -> pd.Series:
        import json

        import yaml

        def one(head):
            try:
                data = yaml.safe_load(head) if head else None
            except yaml.YAMLError:
                return None
            return json.dumps(data, ensure_ascii=False, default=str, sort_keys=True) if isinstance(data, dict) else None

        return heads.map(one)

    return read(F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---\n", 1))


def frontmatter_variant(text: Column) -> Column:
    """The whole YAML head as a variant, lists and nested maps kept; read it by path with variant_at. Null where there is none."""
    return F.try_parse_json(frontmatter_json(text))


def variant_at(head: Column, path: str, kind: str = "string") -> Column:
    """What stands at a path such as $.a.b[0], as kind; null where nothing does or it is of another kind."""
    return F.try_variant_get(head, path, kind)


def heading_path(text: Column) -> Column:
    """All headings of a text in their order, joined by ' > '."""
    lines = F.transform(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n"), strip)
    names = F.transform(F.filter(lines, lambda x: x.startswith("#")), lambda x: strip(F.regexp_replace(x, r"^#+", "")))
    return F.array_join(F.filter(names, lambda x: x != ""), " > ")


def stem_title(path: Column) -> Column:
    """A file's name without extension and leading number, dashes and underscores as blanks."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
    return strip(F.regexp_replace(F.regexp_replace(stem, r"^\d+-", ""), "[-_]+", " "))


#: What structure counts look for.
STRUCTURE = (("h2", "\n## "), ("h3", "\n### "), ("tables", "|---|"), ("items", "\n- "), ("fences", "```"))


def structure(text: Column) -> Column:
    """struct of how often each element of STRUCTURE stands in a text."""
    times = lambda mark: F.floor((F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)).cast("int")
    return F.struct(*[F.coalesce(times(mark), F.lit(0)).alias(name) for name, mark in STRUCTURE])


def document_head(text: Column, fallback: Column, markdown: Column) -> Column:
    """struct of what a documentation page says of itself: title (its head's, else its first heading, else the fallback), category,
    description, sidebar_position, content_type."""
    head = frontmatter(text)
    said = lambda k: F.try_element_at(head, F.lit(k))
    heading = F.regexp_extract(strip_frontmatter(text), r"(?m)^\s*#\s+(.+?)\s*$", 1)
    return F.struct(
        F.coalesce(F.nullif(said("title"), F.lit("")), F.nullif(heading, F.lit("")), fallback).alias("title"),
        said("category").alias("category"), said("description").alias("description"), said("sidebar_position").alias("sidebar_position"),
        F.when(markdown, "docusaurus_markdown").otherwise("docusaurus_mdx").alias("content_type"),
    )


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))
