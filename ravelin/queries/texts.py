"""Text and URL expressions over whole tables, each against the same rules in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import search
from ..plans import normalise, steps
from .base import Registry, case, has_any, q, replaced, strip, table, words

register = Registry()


def _docs(spark, d):
    return table(spark, d, "documents")


def _pages(spark, d):
    return table(spark, d, "pages")


CLEAN = strip(r"regexp_replace(text, '\s+', ' ', 'g')")
TOKENS = r"len(regexp_extract_all(text, '[\p{L}\p{N}_\-/]+|[^\s\p{Z}\p{L}\p{N}_]'))"


@register(f"""SELECT doc_id, {TOKENS}::INT AS n_tokens,
CASE WHEN length(text) = 0 THEN 0 ELSE greatest(length(text) // 4, 1) END::BIGINT AS merge_tokens,
floor(length(text) / 3.5e0)::BIGINT AS context_tokens,
floor(len({words('text')}) * 1.3e0)::BIGINT AS word_tokens FROM documents""")
def token_stats(spark, d):
    t = F.col("text")
    return _docs(spark, d).select(
        "doc_id", T.token_count(t).alias("n_tokens"), T.merge_tokens(t).alias("merge_tokens"),
        T.context_tokens(t).alias("context_tokens"), T.word_tokens(t).alias("word_tokens"),
    )


@register(f"""WITH t AS (SELECT source, {TOKENS} AS n FROM documents)
SELECT source, CASE WHEN n < 300 THEN 'short' WHEN n < 800 THEN 'medium' ELSE 'long' END AS category, count(*) AS n_docs,
count(*) FILTER (n BETWEEN 410 AND 614) AS n_optimal, sum(n)::BIGINT AS n_tokens FROM t GROUP BY ALL""")
def size_category(spark, d):
    n = _docs(spark, d).select("source", T.token_count(F.col("text")).alias("n"))
    return n.groupBy("source", T.size_category(F.col("n")).alias("category")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("n").between(410, 614)).alias("n_optimal"), F.sum("n").alias("n_tokens")
    )


@register(f"SELECT doc_id, CASE WHEN len(w) <= 50 THEN text ELSE array_to_string(w[1:50], ' ') END AS head FROM (SELECT doc_id, text, {words('text')} AS w FROM documents)")
def truncate_words(spark, d):
    return _docs(spark, d).select("doc_id", T.truncate_words(F.col("text"), 50).alias("head"))


#: Markup around each document's text, so that every cleaning rule has something to do.
MDX = ("import X from 'y'\nexport const a = 1\n# Title\n<!-- note\n over lines -->\n::: tip Keep\n this :::\n<Tabs a=\"1\"/>  <Card>",
       "</Card>\n<details open><summary>More</summary>\n\n\n\nbody\t\tend </details>\n<ContentRef url=\"/docs/a\"> Label </ContentRef>")


def _sql_text(s: str) -> str:
    return "(" + " || chr(10) || ".join(q(x).replace("\t", "' || chr(9) || '") for x in s.split("\n")) + ")"


def _mdx():
    return F.concat(F.lit(MDX[0]), F.col("text"), F.lit(MDX[1]))


MDX_SQL = f"({_sql_text(MDX[0])} || text || {_sql_text(MDX[1])})"


@register(f"SELECT doc_id, {strip(replaced(MDX_SQL, T.MDX_RULES))} AS clean FROM documents")
def mdx_clean(spark, d):
    return _docs(spark, d).select("doc_id", T.mdx_clean(_mdx()).alias("clean"))


REF = r"(?s)<ContentRef\s+url=[''\"]{}[''\"]>\s*(.*?)\s*</ContentRef>"


@register(f"""SELECT doc_id, regexp_replace(regexp_replace({MDX_SQL}, '{REF.format("(/[^''\"]*)")}', '\\2 (см. https://host\\1)', 'g'),
'{REF.format("([^''\"]+)")}', '\\2 (см. \\1)', 'g') AS resolved FROM documents""")
def content_refs(spark, d):
    return _docs(spark, d).select("doc_id", T.content_refs(_mdx(), "https://host/").alias("resolved"))


@register(f"SELECT page_id, {strip(replaced('html', T.HTML_RULES))} AS clean FROM pages")
def html_clean_regex(spark, d):
    return _pages(spark, d).select("page_id", T.html_clean(F.col("html")).alias("clean"))


@register(f"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title,
regexp_extract(html, '(?i)<html[^>]*\\slang="([^"]*)"', 1) AS lang,
regexp_extract(html, '(?i)<meta\\s+name="description"\\s+content="([^"]*)"', 1) AS description,
{replaced("html", T.LINK_RULES)} AS linked FROM pages""")
def html_metadata(spark, d):
    h = F.col("html")
    return _pages(spark, d).select(
        "page_id",
        F.trim(F.regexp_extract(h, "(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"),
        F.regexp_extract(h, r'(?i)<html[^>]*\slang="([^"]*)"', 1).alias("lang"),
        F.regexp_extract(h, r'(?i)<meta\s+name="description"\s+content="([^"]*)"', 1).alias("description"),
        T.replace_all(h, T.LINK_RULES).alias("linked"),
    )


@register(f"SELECT doc_id, {strip(replaced('text', T.WHITESPACE_RULES))} AS clean FROM documents")
def ws_normalize(spark, d):
    return _docs(spark, d).select("doc_id", T.normalize_whitespace(F.col("text")).alias("clean"))


@register(rf"""SELECT doc_id, regexp_replace({CLEAN}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g') AS processed,
{replaced("'“' || text || '” – —'", T.LOG_RULES)} AS logged, {replaced("'# A' || chr(10) || '**b** *c* [d](e) ' || text", T.FLATTEN_RULES)} AS flat FROM documents""")
def text_clean(spark, d):
    t = F.col("text")
    return _docs(spark, d).select(
        "doc_id", T.clean_for_processing(t).alias("processed"), T.clean_for_logging(F.concat(F.lit("“"), t, F.lit("” – —"))).alias("logged"),
        T.flatten_markdown(F.concat(F.lit("# A\n**b** *c* [d](e) "), t)).alias("flat"),
    )


#: Texts beside those of the table, so that every answer occurs; their ids are negative.
CASES = ("", "12 34 !!", "!!! ... ??? ---", "abcde", "Пример")
CASES_SQL = " UNION ALL ".join(f"SELECT {-k - 1} AS doc_id, '{c}' AS text" for k, c in enumerate(CASES))


def _with_cases(spark, d):
    return _docs(spark, d).select("doc_id", "text").unionByName(spark.createDataFrame([(-k - 1, c) for k, c in enumerate(CASES)], "doc_id long, text string"))


@register(rf"""WITH v AS (SELECT doc_id, text FROM documents UNION ALL {CASES_SQL}), c AS (SELECT *, {CLEAN} AS clean FROM v)
SELECT doc_id, CASE WHEN {strip('text')} = '' THEN 'empty' WHEN length(clean) < 10 THEN 'short' WHEN NOT regexp_matches(lower(clean), '[а-яёa-z]') THEN 'no letters'
WHEN regexp_matches(clean, '\A[^\s\p{{L}}\p{{N}}_]+\z') THEN 'symbols only' ELSE '' END AS reason,
CASE WHEN regexp_matches(lower(text), '[а-яё]') THEN 'ru' WHEN regexp_matches(lower(text), '[a-z]') THEN 'en' ELSE 'unknown' END AS language FROM c""")
def quality_gate(spark, d):
    return _with_cases(spark, d).select("doc_id", T.quality_reason(F.col("text")).alias("reason"), T.language(F.col("text")).alias("language"))


KINDS = "CASE doc_id % 6 WHEN 1 THEN 'Title: x' || chr(10) || text WHEN 2 THEN '<html>' || text WHEN 3 THEN '# a' || chr(10) || '**b**' || chr(10) || text WHEN 4 THEN '<div class=\"theme-doc-markdown\">' || text ELSE text END"
MARKED = f"len(list_filter(string_split(text, chr(10))[1:10], lambda x: starts_with({strip('x')}, '#') OR starts_with({strip('x')}, '*')))"


@register(f"""WITH d AS (SELECT doc_id, text FROM documents UNION ALL {CASES_SQL}), v AS (SELECT doc_id, {KINDS} AS text FROM d)
SELECT doc_id, CASE WHEN {strip('text')} = '' THEN 'empty' WHEN starts_with(text, 'Title:') OR {has_any('text', ('URL Source:', 'Markdown Content:'))} THEN 'reader'
WHEN {has_any('text', ('theme-doc-breadcrumbs', 'theme-doc-markdown', 'theme-doc-sidebar'))} THEN 'html_site'
WHEN {has_any(f"lower({strip('text')})", ('<html', '<!doctype'))} THEN 'html_generic' WHEN {MARKED} >= 2 THEN 'markdown' ELSE 'text' END AS content_type,
CASE WHEN doc_id % 10 = 7 THEN 'markdown' WHEN starts_with(lower(text), '<html') OR starts_with(lower(text), '<!doctype') THEN 'html'
WHEN starts_with(text, '#') OR contains(text, '```') THEN 'markdown' ELSE 'text' END AS format FROM v""")
def content_type(spark, d):
    v = _with_cases(spark, d).select("doc_id", F.expr(KINDS).alias("text"))
    uri = F.when(F.col("doc_id") % 10 == 7, "a/b.mdx").otherwise("a/b")
    return v.select("doc_id", T.detect_content_type(F.col("text")).alias("content_type"), T.detect_format(uri, F.col("text")).alias("format"))


PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
PARTS = f"list_filter(string_split({PATH}, '/'), lambda p: p <> '')"
LOW = "lower(url)"
PAGE_SQL = case(
    [(has_any(LOW, ("api",)), "'api'"), (has_any(LOW, ("faq",)), "'faq'"), (has_any(LOW, ("blog", "changelog")), "'changelog'"),
     (has_any(LOW, ("guide", "docs")), case([(has_any(LOW, (w,)), q(w)) for w in ("admin", "supervisor", "agent")], "'guide'"))],
    "'unknown'",
)
CLASS_SQL = case([(has_any(LOW, ("faq",)), "'faq'"), (has_any(LOW, ("api",)), "'api'"), (has_any(LOW, ("release", "changelog", "blog")), "'release_notes'")], "'guide'")


@register(f"""SELECT page_id, CASE WHEN parts[1] = 'docs' THEN parts[2] WHEN parts[1] = 'blog' THEN 'changelog' ELSE parts[1] END AS section,
CASE WHEN parts[1] IS NULL THEN NULL WHEN parts[1] = 'docs' THEN CASE WHEN parts[2] IS NULL THEN NULL WHEN parts[2] IN ('agent', 'admin', 'supervisor', 'integrator') THEN parts[2]
 WHEN parts[2] = 'api' THEN 'integrator' ELSE 'all' END ELSE 'all' END AS role, {PAGE_SQL} AS page_type, {CLASS_SQL} AS page_class,
len(list_filter(string_split(url, '/'), lambda s: s <> ''))::INT AS depth, regexp_replace(url, '^http://', 'https://') AS canonical
FROM (SELECT page_id, url, {PARTS} AS parts FROM pages)""")
def url_metadata(spark, d):
    u = F.col("url")
    return _pages(spark, d).select(
        "page_id", U.section(u).alias("section"), U.role(u).alias("role"), U.page_type(u).alias("page_type"), U.page_class(u).alias("page_class"),
        U.depth(u).alias("depth"), U.canonical(u).alias("canonical"),
    )


HOST = r"regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"


@register(rf"""SELECT page_id, regexp_matches(url, '^https?://') AND NOT regexp_matches({LOW}, '(?:\.pdf|\.doc|\.docx|\.zip|\.tar\.gz)$') AS valid,
regexp_matches(url, '^https?://') AND NOT regexp_matches({LOW}, '(?:\.pdf|\.doc|\.docx|\.zip|\.tar\.gz)$') AND {HOST.format('url')} = 'www.site1.example.com' AS same_host FROM pages""")
def url_valid(spark, d):
    u = F.col("url")
    return _pages(spark, d).select("page_id", U.is_crawlable(u).alias("valid"), U.is_crawlable(u, F.lit("https://www.site1.example.com/")).alias("same_host"))


REL = "'10-' || lang || '/' || (doc_id % 90 + 10)::VARCHAR || '-' || source || '/' || '01-page' || doc_id::VARCHAR || '.md'"
REL_SPARK = "concat('10-', lang, '/', cast(doc_id % 90 + 10 as string), '-', source, '/01-page', cast(doc_id as string), '.md')"
BARE = f"string_split(regexp_replace({REL}, '\\.[^./]*$', ''), '/')"


@register(rf"""SELECT doc_id, 'https://host/docs/' || array_to_string(list_transform({BARE}, lambda s: regexp_replace(s, '^\d+-', '')), '/') AS url_all,
'https://host/' || array_to_string(list_concat([regexp_replace({BARE}[1], '^\d+-', '')], {BARE}[2:]), '/') AS url_first FROM documents""")
def path_to_url(spark, d):
    rel = F.expr(REL_SPARK)
    return _docs(spark, d).select("doc_id", U.path_to_url(rel, "https://host/", "docs").alias("url_all"), U.path_to_url(rel, "https://host", "", all_levels=False).alias("url_first"))


MESSAGE = "'<script>alert(1)</script> & \"x\" onclick = javascript: ' || text"
SANITIZED = MESSAGE
for _plain, _escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
    SANITIZED = f"replace({SANITIZED}, {q(_plain)}, {q(_escaped)})"
SANITIZED = replaced(SANITIZED, [(p, "") for p in T.BLOCKED])


@register(rf"SELECT doc_id, {strip(rf"regexp_replace(substring({SANITIZED}, 1, 2000), '[\s\p{{Z}}]+', ' ', 'g')")} AS message FROM documents")
def sanitize_message(spark, d):
    return _docs(spark, d).select("doc_id", T.sanitize(F.expr(MESSAGE.replace("||", "||"))).alias("message"))


WORDS_SQL = "string_split(text, ' ')"


@register(f"""WITH w AS (SELECT doc_id, {words('text')} AS w FROM documents)
SELECT doc_id, (s // 400)::INT AS n, array_to_string(w[s + 1:s + 500], ' ') AS window_text FROM w, LATERAL (SELECT unnest(generate_series(0, greatest(len(w) - 1, 0), 400)) AS s) WHERE len(w) > 0""")
def word_windows(spark, d):
    w = _docs(spark, d).select("doc_id", T.words(F.col("text")).alias("w")).where("size(w) > 0")
    placed = w.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(400))).alias("s"))
    return placed.select("doc_id", (F.col("s") / 400).cast("int").alias("n"), F.array_join(F.slice("w", F.col("s") + 1, 500), " ").alias("window_text"))


WORD_SET = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_\-/]+'))"


@register(f"""WITH t AS (SELECT conv_id, turn, {WORD_SET.format('text')} AS a, lead({WORD_SET.format('text')}) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)
SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(a, b))) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE ELSE 0 END, 9)::DOUBLE AS jaccard
FROM t WHERE b IS NOT NULL""")
def jaccard_pairs(spark, d):
    """Similarity of each turn and the next one."""
    from pyspark.sql import Window

    t = table(spark, d, "conversations").withColumn("a", search.word_set(F.col("text")))
    t = t.withColumn("b", F.lead("a").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b IS NOT NULL")
    return t.select("conv_id", "turn", F.round(search.jaccard(F.col("a"), F.col("b")), 9).alias("jaccard"))


@register(f"""SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '(?is)<h[1-3][^>]*>(.*?)</h[1-3]>', 1), lambda h: trim(regexp_replace(h, '<[^>]+>', '', 'g'))), '|') AS headers FROM pages""")
def html_headers(spark, d):
    return _pages(spark, d).select("page_id", F.array_join(T.headers(F.col("html")), "|").alias("headers"))


@register("""SELECT doc_id, 'Doc ' || doc_id::VARCHAR AS title, source AS category, text AS body FROM documents""")
def frontmatter(spark, d):
    head = F.concat(F.lit("---\ntitle: \"Doc "), F.col("doc_id"), F.lit("\"\ncategory: "), "source", F.lit("\ntags:\n  - a\n---\n"), "text")
    docs = _docs(spark, d).select("doc_id", head.alias("text"))
    m = T.frontmatter(F.col("text"))
    return docs.select("doc_id", F.try_element_at(m, F.lit("title")).alias("title"), F.try_element_at(m, F.lit("category")).alias("category"), T.strip_frontmatter(F.col("text")).alias("body"))


@register(f"""SELECT doc_id, length(text)::INT AS content_length, len({words('text')})::INT AS word_count,
CASE WHEN regexp_matches(lower(text), '[а-яё]') THEN 'ru' WHEN regexp_matches(lower(text), '[a-z]') THEN 'en' ELSE 'unknown' END AS language,
coalesce(nullif(regexp_extract('# Head ' || source || chr(10) || text, '(?m)^\\s*#\\s+(.+?)\\s*$', 1), ''), 'none') AS title FROM documents""".replace("\\\\", "\\"))
def document_metadata(spark, d):
    t = F.col("text")
    headed = F.concat(F.lit("# Head "), "source", F.lit("\n"), t)
    return _docs(spark, d).select(
        "doc_id", F.length(t).alias("content_length"), F.size(T.words(t)).alias("word_count"), T.language(t).alias("language"),
        F.coalesce(F.nullif(F.regexp_extract(headed, r"(?m)^\s*#\s+(.+?)\s*$", 1), F.lit("")), F.lit("none")).alias("title"),
    )


HEADED = "('## Part ' || source || chr(10) || 'x' || chr(10) || '### Deep' || chr(10) || '|---|' || chr(10) || '- a' || chr(10) || '- b' || chr(10) || '```' || chr(10) || text || chr(10) || '#' || chr(10) || '## End')"


@register(f"""WITH v AS (SELECT doc_id, {HEADED} AS v FROM documents)
SELECT doc_id, array_to_string(list_filter(list_transform(list_filter(list_transform(string_split(regexp_replace(v, '\r\n?', chr(10), 'g'), chr(10)), lambda x: {strip('x')}), lambda x: starts_with(x, '#')),
  lambda x: {strip("regexp_replace(x, '^#+', '')")}), lambda x: x <> ''), ' > ') AS headings,
{", ".join(f"((length(v) - length(replace(v, {m}, ''))) // {n})::INT AS {k}" for k, m, n in (("h2", "chr(10) || '## '", 4), ("h3", "chr(10) || '### '", 5), ("tables", "'|---|'", 5), ("items", "chr(10) || '- '", 3), ("fences", "'```'", 3)))} FROM v""")
def structure_counts(spark, d):
    """Heading path and structure of every document under some headings, a table, a list and a fence."""
    text = F.expr(HEADED.replace("chr(10)", "char(10)"))
    docs = _docs(spark, d).select("doc_id", text.alias("v"))
    return docs.select("doc_id", T.heading_path(F.col("v")).alias("headings"), T.structure(F.col("v")).alias("s")).select("doc_id", "headings", "s.*")


@register("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Doc ' || doc_id::VARCHAR WHEN 1 THEN 'Head ' || source ELSE 'page one ' || doc_id::VARCHAR END AS title,
CASE WHEN doc_id % 3 < 2 THEN source END AS category, CASE WHEN doc_id % 3 = 0 THEN 'docusaurus_mdx' ELSE 'docusaurus_markdown' END AS content_type FROM documents""")
def docs_head(spark, d):
    """Title and category of pages with a titled head, with a head and a heading, and with neither (the file's name then)."""
    n, body = F.col("doc_id") % 3, F.regexp_replace("text", "#", "")
    head = F.concat(F.lit("---\n"), F.when(n == 0, F.concat(F.lit('title: "Doc '), F.col("doc_id"), F.lit('"\n'))).otherwise(""), F.lit("category: "), F.col("source"), F.lit("\n---\n"))
    text = F.when(n == 2, body).otherwise(F.concat(head, F.when(n == 1, F.concat(F.lit("# Head "), F.col("source"), F.lit("\n"))).otherwise(""), body))
    name = T.stem_title(F.concat(F.lit("a/b/20-page-one_"), F.col("doc_id"), F.lit(".md")))
    return _docs(spark, d).select("doc_id", T.document_head(text, name, n != 0).alias("h")).select("doc_id", "h.title", "h.category", "h.content_type")


@register(rf"""WITH t AS (SELECT doc_id, lang, source, '# Head ' || source || chr(10) || replace(text, '#', '') AS text FROM documents)
SELECT CASE WHEN doc_id % 3 = 0 THEN 'https://h/docs' ELSE 'https://h/docs/' || lang || '/' || doc_id::VARCHAR END AS canonical_url, doc_id AS n, 'Head ' || source AS title, lang AS category,
true AS normalized, 'docusaurus' AS normalizer, {strip(replaced(strip(replaced(strip(replaced("text", T.WHITESPACE_RULES)), T.MDX_RULES)), T.WHITESPACE_RULES))} AS body FROM t""")
def normalised_docs(spark, d):
    """Every document as the bytes of a documentation page, some of them no UTF-8, through the steps of its normaliser."""
    head = F.concat(F.lit("---\ncategory: "), "lang", F.lit("\n---\n# Head "), "source", F.lit("\n"), F.replace(F.col("text"), F.lit("#"), F.lit("")))
    broken = F.when(F.col("doc_id") % 2 == 0, F.unhex(F.lit("FFC3"))).otherwise(F.unhex(F.lit("")))
    site = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("https://h/docs/"), "lang", F.lit("/"), "doc_id"))
    raw = _docs(spark, d).select(F.col("doc_id").alias("n"), F.concat(F.encode(head, "UTF-8"), broken).alias("content"), site.alias("site_url"), F.lit("a/b.md").alias("rel_path"))
    pages = steps.Pipeline(*normalise.documentation_steps("https://h", "/docs")).run(raw)
    return pages.select("canonical_url", "n", "head.title", "head.category", "normalized", "normalizer", F.col("text").alias("body"))
