import os.path
import random
from pathlib import PurePosixPath
from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from foliant.functions import urls as U

SEGMENTS = ["", "a", "b-c", "..", ".", "x;p", "ü", "A b"]
TAILS = ["", "", "?q=1", "#f", "?q=1#f", "?a=/../b"]
HOSTS = ["docs.a.example", "www.docs.a.example", "a.example", "docs.example", "localhost:8000", "API.x.y"]
FIXED = ["", "#x", "?y=2", "//h.example/z", "mailto:a@b", "javascript:void(0)"]


def make_path(r):
    return "/".join(r.choice(SEGMENTS) for _ in range(r.randint(0, 5)))


def make_url(r):
    p = make_path(r)
    return f"{r.choice(['http', 'https'])}://{r.choice(HOSTS)}" + (f"/{p}" if p else "") + r.choice(TAILS)


def make_href(r):
    p = make_path(r)
    return r.choice([p + r.choice(TAILS), "/" + p.lstrip("/") + r.choice(TAILS), make_url(r), r.choice(FIXED)])


def run(spark, rows, columns, **made):
    return spark.createDataFrame(rows, columns).select(*(c.alias(n) for n, c in made.items())).collect()


def test_resolve_is_the_standard_one(spark):
    r = random.Random(7)
    pairs = [(make_url(r), make_href(r)) for _ in range(4000)]
    pairs = [(b, h) for b, h in pairs if not urlparse(h).path.startswith("//") and "//" not in urlparse(h).netloc]
    rows = run(spark, pairs, "b string, h string", out=U.resolve(F.col("b"), F.col("h")))
    bad = [(b, h, x.out, urljoin(b, h)) for (b, h), x in zip(pairs, rows, strict=True) if x.out != urljoin(b, h)]
    assert not bad, bad[:5]


def test_parts(spark):
    r = random.Random(8)
    found = [make_url(r) for _ in range(2000)]
    rows = run(spark, [(u,) for u in found], "u string", p=U.path(F.col("u")), n=U.netloc(F.col("u")), pp=U.page_path(F.col("u")), d=U.parent_directory(F.col("u")))
    for u, x in zip(found, rows, strict=True):
        want = urlparse(u)
        assert (x.n, x.p) == (want.netloc, want.path), u
        assert x.pp == (want.path.strip("/") or "_root"), u
        assert x.d == str(PurePosixPath(want.path).parent) or want.path.startswith("//"), (u, x.d)


def test_relative_links(spark):
    r = random.Random(9)
    some = lambda: "/".join(r.choice(["a", "b", "cc", "d.e"]) for _ in range(r.randint(1, 4)))
    pairs = [(some(), some()) for _ in range(2000)]
    rows = run(spark, pairs, "t string, s string", out=U.relative_md(F.col("t"), F.col("s")))
    for (t, s), x in zip(pairs, rows, strict=True):
        assert x.out == os.path.relpath(f"{t}.md", os.path.dirname(s) or "."), (t, s)


def test_tool_names(spark):
    cases = {
        "https://docs.stripe.example/payments": "stripe", "https://www.docs.a.example": "a", "https://docs.com/x": "docs", "http://localhost:8000/": "localhost:8000",
        "https://m.x.example/": "m", "https://www.docs.api/": "docs", "https://a.example": "a",
    }
    rows = run(spark, [(u,) for u in cases] + [(None,)], "u string", t=U.tool_name(F.col("u")), p=U.page_path(F.col("u")))
    assert [r.t for r in rows[:-1]] == list(cases.values())
    assert rows[-1] == (None, None)


def test_scope(spark):
    cases = [
        ("https://a.b/pay/x", "a.b", "/pay", True), ("https://a.b/pay", "a.b", "/pay", True), ("https://a.b/pay-links", "a.b", "/pay", False),
        ("https://c.b/pay", "a.b", "/pay", False), ("http://a.b", "a.b", "/", True), ("https://A.b/pay", "a.b", "/pay", False),
    ]
    rows = run(spark, [x[:3] for x in cases], "u string, n string, p string", ok=U.in_scope(F.col("u"), F.col("n"), F.col("p")))
    assert [r.ok for r in rows] == [x[3] for x in cases]
    rows = run(spark, [("https://a.b/docs/",), ("https://a.b",)], "u string", s=U.crawl_scope(F.col("u")))
    assert [tuple(r.s) for r in rows] == [("a.b", "/docs"), ("a.b", "/")]
