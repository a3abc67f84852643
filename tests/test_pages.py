import pytest
from pyspark.sql import functions as F

from foliant.functions.registry import register
from foliant.operators import dom
from foliant.plans import pages as P


def page(html, url="https://docs.a.example/x/page"):
    title, nav, links, body, found = P.parse_page(html, url)
    for k, h in enumerate(found or []):
        body = body.replace(f"{P.OPEN}{k}{P.CLOSE}", h)
    return title, nav, links, body


def test_content_choice_and_chrome():
    html = "<html><head><title>T</title></head><body><nav>menu</nav><article>art</article><main><h1>Head <b>two</b></h1><div class='toc'>toc</div><p>Hello <em>you</em></p><button class='x copy-button-2'>Copy</button></main></body></html>"
    title, _, _, body = page(html)
    assert title == "Headtwo"
    assert body.startswith("# Head **two**") and "Hello *you*" in body
    for gone in ("menu", "toc", "Copy", "art\n"):
        assert gone not in body


def test_title_falls_back_and_body_is_content():
    assert page("<title>Only</title><body><p>x</p></body>")[0] == "Only"
    assert page("<p>x</p>")[0] == "" and page("<p>x</p>")[3] == "x"
    assert P.parse_page(None, None) == (None,) * 5
    assert page("")[3] == ""


def test_unclosed_tags_nest():
    root = dom.parse("<p><b>one<br><p>two</article><p>three")
    assert [x.tag for x in root.walk()] == ["p", "b", "br", "p", "p"]
    assert root.stripped() == "onetwothree"


def test_code_blocks():
    html = "<main><pre class='highlight-python'><span class='gutter'>1 2</span><code><span>a</span>\tb\n  c</code><button>Copy</button></pre><pre data-lang='sql'>x</pre><pre><code class='language-none lang-go'>g</code></pre></main>"
    body = page(html)[3]
    assert "```python\na\tb\n  c\n```" in body and "```sql\nx\n```" in body and "```go\ng\n```" in body and "Copy" not in body


@pytest.mark.parametrize(
    "html",
    [
        "<main><p>a</p><div class='tabbed-set'><div class='tabbed-labels'><label>One</label></div><div class='tabbed-content'><div class='tabbed-block'><pre>1</pre></div><div class='tabbed-block'><pre>2</pre></div><div class='tabbed-block'>no</div></div></div></main>",
        "<main><p>a</p><div><div role='tablist'><button role='tab'>One</button></div><div role='tabpanel'><pre>1</pre></div><div role='tabpanel'><pre>2</pre></div></div></main>",
        "<main><div role='tablist'><button role='tab'>One</button></div><div role='tabpanel'><pre>1</pre></div><div role='tabpanel'><pre>2</pre></div></main>",
    ],
)
def test_tabs(html):
    body = page(html)[3]
    assert body.index("**One**") < body.index("```\n1\n```") < body.index("**Tab 2**") < body.index("```\n2\n```")


def test_nav_path():
    html = "<nav><h3>Guides</h3><ul><li><button>Start</button><ul><li><a href='/x/other'>O</a></li><li><a href='/x/page/'>This page</a></li></ul></li></ul></nav><main>t</main>"
    assert page(html)[1] == ["Guides", "Start"]
    two = "<nav><h3>A</h3><ul><li><a href='/x/page'>P</a></li></ul><h3>B</h3><ul><li><a href='/x/other'>O</a></li></ul></nav>"
    assert page(two)[1] == ["A"]
    assert page(two.replace("<a href='/x/other'>", "<a class='q active' href='/x/other'>"))[1] == ["B"]
    assert page(two.replace("<a href='/x/other'>", "<a aria-current='page' href='/x/other'>"))[1] == ["B"]
    assert page("<nav><h3>Docs</h3><a href='/x/page'>X</a></nav>")[1] == []  # the menu's own label stands beside the link, not around it
    assert page("<nav><h3>G</h3><p></p><ul><li><a href='/x/page'>X</a></li></ul></nav>")[1] == ["G"]
    assert page("<main>t</main>")[1] == []


def test_rendering():
    html = """<main><ul><li>a<ul><li>b</li></ul></li></ul><ol><li>x</li><li>y</li></ol><table><tr><th>H</th><th>I</th></tr><tr><td>1</td></tr></table>
    <blockquote><p>q</p></blockquote><hr><p>5 * 2_3 <code>a_b</code><br>next</p><img src='/i.png' alt='pic'><img src='data:image/x'></main>"""
    body = page(html)[3]
    for part in ("- a\n  - b", "1. x\n2. y", "| H | I |\n| --- | --- |\n| 1 |  |", "> q", "---", r"5 \* 2\_3 `a_b`  " + "\nnext", "![pic](https://docs.a.example/i.png)", "![](data:image/x)"):
        assert part in body, (part, body)


@pytest.fixture(scope="module")
def site(spark):
    rows = [
        (1, "https://docs.a.example/api/one", "<title>One</title><main><a href='/pay/two#s'>two</a> <a href='https://x.example/q?z=1'>x</a> <a href='#top'>t</a> <a href='mailto:a@b'>m</a> <a href='one'>me</a></main>"),
        (2, "https://docs.a.example/pay/two", "<title>Two</title><main><a href='../api/one?v=2'>one</a> <a href='/gone'>gone</a></main>"),
        (3, "https://docs.a.example/pay/two/", "<title>Two again</title><main>later</main>"),
        (4, "https://docs.a.example/", None),
    ]
    return P.pages_table(spark.createDataFrame(rows, "seq long, url string, html string"))


def test_concepts_in_convert_mode(spark, site):
    got = {r.page_path: r for r in P.concepts(site, site, "2025-01-01T00:00:00+00:00").collect()}
    assert set(got) == {"api/one", "pay/two", "_root"}
    assert got["pay/two"].title == "Two again"  # the later url on the path wins
    body = got["api/one"].body
    for part in ("[two](../pay/two.md#s)", "[x](https://x.example/q?z=1)", "[t](#top)", "[m](mailto:a@b)", "[me](one.md)"):
        assert part in body, body
    assert got["api/one"].md.startswith("---\ntype: Reference\ntitle: One\nresource: https://docs.a.example/api/one\n")
    assert got["_root"].body is None


def test_crawl_order_rewrites_backwards_only(spark, site):
    known = site.withColumn("in_prior", F.lit(False))
    links = {(r.url, r.at): r.link for r in P.link_targets(P.parsed_pages(site), known, "crawl_order").collect()}
    assert links["https://docs.a.example/api/one", 0] == "https://docs.a.example/pay/two#s"
    assert links["https://docs.a.example/pay/two", 0] == "../api/one.md"
    assert links["https://docs.a.example/pay/two", 1] == "https://docs.a.example/gone"
    with pytest.raises(ValueError):
        P.link_targets(P.parsed_pages(site), known, "other")


def test_page_links_keep_the_first(spark, site):
    rows = P.page_links(P.parsed_pages(site), (F.lit("docs.a.example"), F.lit("/"))).filter("url like '%one'").orderBy("pos").collect()
    assert [r.normalized for r in rows] == ["https://docs.a.example/pay/two", "https://docs.a.example/api/one"]


def test_parse_runs_once_a_page(spark, site):
    plan = P.parsed_pages(site).filter("title = 'One'").select("title", "body")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_functions_for_sql(spark):
    names = register(spark)
    assert "foliant_parse_page" in names and register(spark) == names
    spark.createDataFrame([("https://docs.a.example/x/page/?q=1", "<title>T</title><nav><a href='/b'>b</a></nav><main>x</main>"), (None, None)], "url string, html string").createOrReplaceTempView("raw_pages")
    rows = spark.sql("select foliant_page_path(url) p, foliant_normal_url(url) n, foliant_parse_page(html, url).title t, foliant_page_links(html) l, foliant_body_of('---\\na: b\\n---\\nrest') b from raw_pages order by url desc").collect()
    assert tuple(rows[0]) == ("x/page", "https://docs.a.example/x/page/", "T", ["/b"], "rest") and rows[1].l is None and rows[1].t is None
