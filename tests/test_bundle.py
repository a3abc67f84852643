import io
import datetime

from pyspark.sql import functions as F

from foliant.operators import bundle as B
from foliant.operators import conformance as C
from foliant.operators import crawl as K
from foliant.plans.summaries import glossary, salvaged, summarised
from foliant.progress import Console
from foliant.sources import files as S
from foliant.sources.frontmatter import merged_text, with_frontmatter


def test_listings(spark):
    d = spark.createDataFrame([("t", "a/b-c", "B", "about b"), ("t", "a", "A", None), ("t", "a/d_e/f", None, ""), ("t", None, "x", "y")], "tool string, page_path string, title string, description string")
    got = {r.path: r.text for r in B.listing_files(d).collect()}
    assert got["index.md"] == '---\nokf_version: "0.1"\n---\n\n# t\n\n- [A](./a.md) - \n- [A](./a/) - \n'
    assert got["a/index.md"] == "# A\n\n- [B](./b-c.md) - about b\n- [D E](./d_e/) - \n"
    assert got["a/d_e/index.md"] == "# D E\n\n- [f](./f.md) - \n"


def test_glossary_terms_and_batches(spark):
    d = spark.createDataFrame([("t", 2, "Api"), ("t", 1, " api "), ("t", 3, ""), ("t", 4, None), ("u", 9, "API")], "tool string, seq long, term string")
    assert sorted(map(tuple, B.glossary_terms(d).collect())) == [("t", 1, "api"), ("u", 9, "API")]
    urls = spark.createDataFrame([("t", i, f"https://a.b/d/{i}") for i in range(17)] + [("t", 99, "https://a.b/e")], "tool string, seq long, url string")
    got = B.directory_batches(urls).groupBy("dir", "batch_no").count().collect()
    assert sorted(map(tuple, got)) == [("/", 0, 1), ("/d", 0, 15), ("/d", 1, 2)]


def test_status_rule_and_manifest(spark):
    prior = spark.createDataFrame([("t", "u1", "h1"), ("t", "u2", "old"), ("t", "u3", None), ("t", "u9", "h9")], "tool string, url string, content_hash string")
    cols = "tool string, url string, seq long, page_path string, http_status int, error string, content_hash string"
    run = spark.createDataFrame([("t", "u1", 1, "p1", 200, None, "h1"), ("t", "u2", 2, "p2", 200, None, "new"), ("t", "u3", 3, "p3", 200, None, "x"), ("t", "u4", 4, "p4", 200, None, "x"), ("t", "u5", 5, "p5", 404, None, None), ("t", "u6", 6, "p6", 304, None, None), ("t", "u7", 7, "p7", None, "lost", None)], cols)
    done = K.crawl_status(run, prior)
    assert [r.status for r in done.orderBy("seq").collect()] == ["skipped", "updated", "updated", "fetched", "FAILED", "skipped", "FAILED"]
    full = done.withColumns({c: F.lit(None).cast("string") for c in ("cache_path", "fetched_at", "etag", "last_modified")}).withColumn("nav_path", F.lit(None).cast("array<string>"))
    old = prior.withColumns({"seq": F.lit(0).cast("long"), "page_path": F.lit("p")} | {c: F.lit(None).cast("string") for c in ("cache_path", "fetched_at", "etag", "last_modified", "status", "error")}).withColumn("nav_path", F.lit(None).cast("array<string>"))
    merged = {r.url: r for r in K.merged_manifest(full, old).collect()}
    assert set(merged) == {"u1", "u2", "u3", "u4", "u5", "u7", "u9"}
    assert merged["u5"].error == "HTTP 404" and merged["u7"].status == "errored" and merged["u2"].content_hash == "new"


def test_breadth_first(spark):
    edges = spark.createDataFrame([("a", 0, "c"), ("a", 1, "b"), ("b", 0, "a"), ("b", 1, "e"), ("c", 0, "d"), ("c", 1, "b")], "src string, pos int, dst string")
    rows = K.discover(edges, spark.createDataFrame([("a",)], "url string")).orderBy("seq").collect()
    assert [(r.url, r.depth) for r in rows] == [("a", 0), ("c", 1), ("b", 1), ("d", 2), ("e", 2)]


def test_breadth_first_has_no_cap(spark, monkeypatch):
    """Any range in the module ends after 2, so a cap on levels would show on a short chain."""
    monkeypatch.setattr(K, "range", lambda a, b: iter((1, 2)), raising=False)
    edges = spark.createDataFrame([(f"p{k}", 0, f"p{k + 1}") for k in range(4)], "src string, pos int, dst string")
    rows = K.discover(edges, spark.createDataFrame([("p0",)], "url string")).collect()
    assert {(r.url, r.depth) for r in rows} == {(f"p{k}", k) for k in range(5)}


def test_sitemaps_and_robots(spark):
    x = "<{0} xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>{1}</{0}>"
    loc = lambda tag, u: f"<{tag}><loc> {u} </loc></{tag}>"
    docs = spark.createDataFrame([("r", x.format("sitemapindex", loc("sitemap", "c1") + loc("sitemap", "bad") + loc("sitemap", "gone"))), ("c1", x.format("urlset", loc("url", "u1") + loc("url", "u1"))), ("bad", "<x")], "sitemap_url string, xml string")
    assert [r.url for r in K.sitemap_urls(docs, "r").collect()] == ["u1", "u1"]
    assert K.sitemap_urls(docs, "bad").count() == 0 and K.sitemap_urls(docs, "none").count() == 0
    urls = spark.createDataFrame([("https://a.b/x",), ("https://a.b/no/y",)], "url string")
    assert [r.url for r in K.robots_allowed(urls, "User-agent: *\nDisallow: /no", "bot").collect()] == ["https://a.b/x"]
    assert K.robots_allowed(urls, None, "bot").count() == 2


def test_conformance(spark):
    good = "---\ntype: A\ntitle: x\ndescription: y\n---\nbody"
    rows = [("t", "a.md", good), ("t", "b.md", "no header"), ("t", "c.md", "---\ntype: ''\n---\n"), ("t", "d.md", "---\ntitle: x\n---\n"), ("t", "e.md", "---\ntype: A\n---\n"), ("t", "index.md", "---\nx\n---\n"),
            ("t", "d/index.md", "---\nx\n---\n"), ("t", "log.md", "# L\n"), ("t", "q/log.md", ""), ("t", "glossary.md", "x"), ("t", "f.md", good.replace("\n", "\r\n")), ("t", "g.md", None)]
    d = spark.createDataFrame(rows, "tool string, path string, text string")
    got = sorted((r.path, r.rule) for r in C.findings(d).collect())
    assert got == sorted([("b.md", "E1"), ("c.md", "E2"), ("d.md", "E2"), ("e.md", "W1-title"), ("e.md", "W1-description"), ("d/index.md", "E3"), ("log.md", "WLOG"), ("f.md", "E1"), ("g.md", "E1")])
    assert tuple(C.summary(d).first()) == ("t", 12, 6, 3)
    assert C.exit_code(256) == 255


def test_log_merge(spark):
    day = datetime.date(2025, 1, 2)
    result = spark.createDataFrame([("t", "a/b", "B", "updated", 1, day), ("t", "c", None, "fetched", 2, day), ("t", "x", "X", "skipped", 3, day)], "tool string, page_path string, title string, status string, seq long, day date")
    new = B.log_lines(result)
    assert [r.line for r in new.orderBy("seq").collect()] == ["* **Creation**: [c](./c.md)", "* **Update**: [B](./a/b.md)"]
    log = spark.createDataFrame([("t", 1, day, 1, "* **Update**: [B](./a/b.md)"), ("t", 2, datetime.date(2024, 1, 1), 1, "* old")], "tool string, section int, day date, seq int, line string")
    text = B.log_files(B.merged_log(log, new)).first().text
    assert text == "# Update Log\n\n## 2024-01-01\n\n* old\n\n## 2025-01-02\n\n* **Update**: [B](./a/b.md)\n* **Creation**: [c](./c.md)\n"


def test_tools_map(spark):
    a = spark.createDataFrame([("t", "old"), ("u", "u")], "tool string, entry_url string")
    b = spark.createDataFrame([("t", "new"), ("v", "v")], "tool string, entry_url string")
    assert sorted(map(tuple, B.merged_tools(a, b).collect())) == [("t", "new"), ("u", "u"), ("v", "v")]


def test_frontmatter(spark):
    d = spark.createDataFrame([("---\ntype: A\nkeywords: [x, 2]\nown: 1\n---\nbody",), ("plain",), ("---\n: [\n---\nb",)], "text string")
    rows = with_frontmatter(d).collect()
    assert rows[0].front.keywords == ["x", "2"] and rows[0].front.extra == {"own": "1"} and rows[0].body == "body"
    assert rows[1].front.type is None and rows[1].body == "plain" and rows[2].body == "b"
    out = d.select(merged_text(F.col("text"), F.lit('{"description": "d"}')).alias("t")).collect()
    assert out[0].t == "---\ndescription: d\nkeywords:\n- x\n- 2\nown: 1\ntype: A\n---\n\nbody"


def test_salvage():
    assert salvaged('[{"a": 1}, {"b": "}"}]') == [{"a": 1}, {"b": "}"}]
    assert salvaged('[{"a": {"x": 1}}, {"b": "cut') == [{"a": {"x": 1}}]
    assert salvaged('[{"a": 1},]') == [{"a": 1}]
    assert salvaged('{"a": 1}') == [] and salvaged("no") == [] and salvaged(None) == []


def test_summaries_and_glossary(spark):
    def provider(prompt):
        if "Define" in prompt:
            return "```json\n" + '[{"term": "Api", "definition": "an interface"}, {"term": "x"}, {"ter'
        if "boom" in prompt:
            raise RuntimeError
        return '{"summary": "s", "keywords": ["k"], "candidates": ["Api"]}'

    manifest = spark.createDataFrame([("t", f"https://a.b/{p}", i, p, "h") for i, p in enumerate(["new", "same", "changed", "missing", "boom"])], "tool string, url string, seq long, page_path string, content_hash string")
    known = spark.createDataFrame([("t", "new", None, "h", "text"), ("t", "same", "d", "h", "text"), ("t", "changed", "d", "g", "text"), ("t", "boom", "", "h", "boom")], "tool string, page_path string, description string, content_hash string, md string")
    got = {r.page_path: r.status for r in summarised(manifest, known, provider, 2, 2).collect()}
    assert got == {"new": "summarized", "same": "skipped", "changed": "summarized", "missing": "FAILED", "boom": "FAILED"}
    terms = spark.createDataFrame([("t", 1, "Api"), ("t", 2, "api")], "tool string, seq long, term string")
    assert "**Api**: an interface\n" in glossary(terms, provider).first().text
    assert glossary(terms, lambda p: "[]", filled=["t"]).count() == 0


def test_files_round_trip(spark, tmp_path):
    base = str(tmp_path)
    d = spark.createDataFrame([("t", "a/b.md", "é\nx"), ("t", "c d.md", "y")], "tool string, path string, text string")
    S.export_files(d, base)
    back = S.read_tree(spark, S.bundle_dir("t", base)).orderBy(F.split("path", "/"))
    assert [tuple(r) for r in back.collect()] == [("a/b.md", "é\nx"), ("c d.md", "y")]
    S.export_raw(spark.createDataFrame([("t", "a/b", "<p>")], "tool string, page_path string, html string"), base)
    assert [tuple(r) for r in S.read_raw(spark, "t", base).collect()] == [("t", "a/b", "<p>")]
    m = S.manifest_rows(spark.createDataFrame([("t", '{"u2": {"page_path": "p", "etag": null, "nav_path": ["ä"]}, "u1": {"page_path": "q", "status": "errored", "error": "e"}}'), ("v", "bad")], "tool string, json string"))
    S.write_manifests(m, base)
    assert S.read_manifest(spark, "t", base).orderBy("seq").collect() == m.filter("tool = 't'").orderBy("seq").collect()
    S.wipe("t", base), S.wipe("t", base)
    assert S.read_manifest(spark, "t", base).count() == 0 and S.read_raw(spark, "t", base).count() == 0
    for bad in ("", "..", "a/b"):
        try:
            S.wipe(bad, base)
            raise AssertionError
        except ValueError:
            pass
    try:
        S.export_files(spark.createDataFrame([("t", "../x", "y")], "tool string, path string, text string"), base)
        raise AssertionError
    except ValueError:
        pass


def test_progress(spark, capsys):
    rows = [("t", f"u{k}", k, "FAILED" if k == 3 else "fetched", "why" if k == 3 else None) for k in range(23)]
    result = spark.createDataFrame(rows, "tool string, url string, seq long, status string, error string")
    lines = {r.done: r.line for r in B.progress_lines(result).collect()}
    assert sorted(lines) == [*range(2, 23, 2), 23] and lines[4] == "  [4/23] 3 fetched, 1 FAILED" and lines[23] == "  [23/23] 22 fetched, 1 FAILED"
    Console().stage("Pages", result)
    err = capsys.readouterr().err
    assert err.count("/23]") == 12 and "  FAILED u3: why" in err and err.startswith("Pages: 23 pages\n") and err.endswith("Pages: 23 done — 22 fetched, 1 FAILED\n")
    Console(enabled=False).stage("Pages", result)
    Console().stage("None", result.limit(0))
    assert capsys.readouterr().err == "None…\nNone: 0 done — \n"


class Terminal(io.StringIO):
    def isatty(self):
        return True


def test_the_step_under_way_is_replaced_on_a_terminal():
    for stream, want in ((Terminal(), "\r\x1b[K  reading…\r\x1b[Kdone\n"), (io.StringIO(), "done\n")):
        c = Console(stream)
        c.begin("reading")
        c.banner("done")
        assert stream.getvalue() == want


def test_summary_totals(spark):
    d = spark.createDataFrame([("t", "b", "summarized", ["x", "y"]), ("t", "a", "summarized", ["z"]), ("t", "c", "FAILED", None), ("t", "d", "skipped", None)], "tool string, page_path string, status string, candidates array<string>")
    assert [tuple(r) for r in B.summary_totals(d).collect()] == [("t", 2, 1, ["z", "x", "y"])]


def test_log_is_read_back(spark):
    text = "# Update Log\n\n## 2025-01-03\n\n* **Creation**: [A](./a.md)\n* **Update**: [B](./b.md)\n\n## 2025-01-01\n\n* **Creation**: [B](./b.md)\n"
    log = B.log_rows(spark.createDataFrame([("t", text)], "tool string, text string"))
    assert B.log_files(log).first().text == text


def test_one_url_of_two_tools(spark):
    prior = spark.createDataFrame([("t2", "u", "h")], "tool string, url string, content_hash string")
    cols = "tool string, url string, seq long, page_path string, http_status int, error string, content_hash string"
    run = spark.createDataFrame([("t1", "u", 1, "p", 200, None, "h"), ("t2", "u", 2, "p", 200, None, "h")], cols)
    assert {r.tool: r.status for r in K.crawl_status(run, prior).collect()} == {"t1": "fetched", "t2": "skipped"}


def test_wide_levels_keep_their_order(spark):
    edges = spark.createDataFrame([("root", k, f"n{(k * 37) % 500:03d}") for k in range(500)] + [(f"n{k:03d}", 0, f"m{k:03d}") for k in range(0, 500, 7)], "src string, pos int, dst string").repartition(6)
    rows = K.discover(edges, spark.createDataFrame([("root",)], "url string")).orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(1, len(rows) + 1)) and [r.url for r in rows[1:501]] == [f"n{(k * 37) % 500:03d}" for k in range(500)]
    assert [r.url for r in rows[501:]] == [f"m{(k * 37) % 500:03d}" for k in range(500) if (k * 37) % 500 % 7 == 0]
