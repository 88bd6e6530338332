import pytest

from ravelin.sources import dom, files

PAGE = """<!DOCTYPE html><html lang="en"><head><title> A &amp; B </title><meta name="description" content="d"><meta name="keywords"></head>
<body><header>top</header><nav class="theme-doc-breadcrumbs x"><a href="/">Home</a><span><a href="/g">Guide <b>one</b></a></span></nav>
<div id="content" class="box content"><p class="lead">Lead <i>text</i><br>more<p>unclosed</div></section>
<div class="theme-doc-markdown"><h2>Two</h2><div><h3>Three</h3></div><h4>no</h4></div><h2>off</h2>
<p><strong>Permissions:</strong> read, write ,, </p><p><strong>No Permissions</strong><i>x</i></p><script>var a = "<p>no</p>";</script>
<footer><article>hidden</article></footer></body></html>"""


def texts(root, selector):
    return [n.text(" ") for n in root.select(selector)]


def test_selectors():
    root = dom.parse(PAGE)
    assert texts(root, ".theme-doc-breadcrumbs a") == ["Home", "Guide one"]
    assert texts(root, "nav > a") == ["Home"] and texts(root, "nav.x.theme-doc-breadcrumbs span > a b") == ["one"]
    assert texts(root, "#content p.lead i, h4") == ["text", "no"]
    assert texts(root, "[href='/g']") == ["Guide one"] and len(root.select("a[href]")) == 2 and texts(root, 'meta[name="description"]') == [""]
    assert root.select("div#nothing") == [] and root.select_one("h2 > *") is None
    assert texts(root, "body > div > div > h3") == ["Three"] and texts(root, "html h3") == ["Three"]
    with pytest.raises(ValueError):
        root.select("p:first-child")


def test_descendants_may_stand_further_up():
    """a > b c: the b nearest to c is not a's child, one above it is."""
    root = dom.parse("<a><b id='1'><d><b id='2'><c>x</c></b></d></b></a>")
    assert texts(root, "a > b c") == ["x"] and texts(root, "d > b > c") == ["x"] and texts(root, "a > c") == [] and texts(root, "c b") == []


def test_malformed_pages():
    root = dom.parse("</p><ul><li>a<li>b</ul>c<b>d</i>e</b><p>f" + "<div>" * 5000 + "deep")
    assert root.text("|") == "a|b|c|d|e|f|deep" and len(texts(root, "div")) == 5000
    assert dom.parse("").text() == "" and dom.parse("a <!-- no --> b").text("|") == "a|b"


def test_main_content_by_selectors_in_order():
    long, other = "word " * 30, "other " * 30
    page = lambda inner: dom.main_content(dom.parse(f"<html><body><nav>menu</nav>{inner}</body></html>"), "fallback")
    assert page(f"<div class='content'>{other}</div><main>{long}</main>") == ("main", long.strip())
    assert page(f"<main>short</main><div role='main'>{long}</div><div id=main>{other}</div>") == ('[role="main"]', long.strip())
    assert page(f"<div class='content'>short</div><div class='content'>{long}</div><div class='entry-content'>{other}</div>") == (".entry-content", other.strip())
    for k, attrs in enumerate(("class=content", "class=main-content", "id=content", "id=main", "class=post-content", "class=entry-content"), 3):
        assert page(f"<p>x</p><div {attrs}>{long}</div>") == (dom.MAIN_SELECTORS[k], long.strip())
    assert page("<main>short</main>") == ("body", "menu\nshort") and page("<main>" + "x" * 100 + "</main>")[0] == "body"
    assert dom.main_content(dom.parse("no body"), "fallback") == ("", "fallback")


def test_page_documents(spark):
    pages = spark.createDataFrame([(1, "https://h/d/", PAGE), (2, None, None), (3, "https://h/", "<a href='x#y'>x</a> [m](n) <main><p>in</p><nav>n</nav></main>")],
                                  "page_id int, url string, html string").withColumn("text", dom_lit())
    a, b, c = dom.page_documents(pages).orderBy("page_id").collect()
    assert (a.title, a.lang, a.description, a.keywords, a.breadcrumbs) == ("A & B", "en", "d", "", ["Home", "Guide one"])
    assert (a.section_headers, a.permissions, a.links) == (["Two", "Three"], ["read", "write"], ["https://h/", "https://h/g"])
    assert a.selector == "body" and "hidden" in a.main and "top" in a.main and 'var a' not in a.main
    assert a.text.startswith("Lead\ntext\nmore\nunclosed\nTwo") and "top" not in a.text and "hidden" not in a.text and "Home" not in a.text
    assert (b.title, b.text, b.main, b.lang, b.links, b.permissions) == ("", "", "", None, [], [])
    assert (c.text, c.links) == ("in", ["https://h/x"])
    assert dom.page_documents(pages.limit(0)).count() == 0
    assert dom.normalised_text(dom.parse("see [m](n)")) == "see m (см. n)"


def dom_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_crawl_filters_links_before_it_cuts_them_and_keeps_their_order(spark):
    link = lambda *xs: "".join(f'<a href="{x}">t</a>' for x in xs)
    off = [f"https://out{i}/x" for i in range(20)]
    pages = [
        ("https://h/", link(*off, "/z", "/gone", "/a", "/z")), ("https://h/z", link("/2", "/1")), ("https://h/a", link("/0", "/1", "/")),
        *((f"https://h/{i}", link("/far")) for i in range(3)), ("https://h/far", ""), ("https://h/alone", ""),
    ]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)] + [(90, "https://h/a", "")], "page_id long, url string, html string").where("page_id < 90")
    want = ["", "z", "a", "2", "1", "0", "far"]
    assert [(r.url, r.depth) for r in files.crawl(df, "https://h/", 100).collect()] == [(f"https://h/{u}", d) for u, d in zip(want, (0, 1, 1, 2, 2, 2, 3), strict=True)]
    assert [r.url for r in files.crawl(df, "https://h/", 4).collect()] == [f"https://h/{u}" for u in want[:4]]
    assert [r.url for r in files.crawl(df, "https://h/", 100, per_page=1).collect()] == [f"https://h/{u}" for u in ("", "z", "2", "far")]
    assert files.crawl(df, "https://h/none", 5).count() == 0
