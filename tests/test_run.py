import json

import pytest
from pyspark.sql import functions as F

from foliant import cli
from foliant.operators import conformance
from foliant.sources import files
from foliant.sources.fetch import Response, fetch_pages, fetch_with_retry
from foliant import scale
from foliant.streaming import incremental
from foliant.streaming.incremental import PAGES, start

HTML = "<title>{0}</title><main><h1>{0}</h1><p>Text of {0} and <a href='/guide/b'>b</a>.</p></main>"


@pytest.fixture
def pages(spark, tmp_path):
    rows = [(1, "https://docs.acme.example/guide/a", HTML.format("A")), (2, "https://docs.acme.example/guide/b", HTML.format("B")), (3, "https://other.example/x", HTML.format("X"))]
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame(rows, "seq long, url string, html string").write.parquet(path)
    return path


def test_a_whole_run_passes_its_own_rules(spark, pages, tmp_path, capsys):
    base = str(tmp_path / "out")
    args = ["https://docs.acme.example/guide", "--pages", pages, "--base", base, "--run-ts", "2025-01-02T03:04:05+00:00", "--quiet"]
    assert cli.main(args, spark) == 0
    assert "6 files, 0 errors" in capsys.readouterr().out
    tree = files.read_tree(spark, files.bundle_dir("acme", base))
    got = {r.path: r.text for r in tree.collect()}
    assert set(got) == {"guide/a.md", "guide/b.md", "index.md", "guide/index.md", "log.md", "glossary.md"}
    assert "[b](b.md)" in got["guide/a.md"] and "* **Creation**: [A](./guide/a.md)" in got["log.md"]
    assert conformance.summary(tree.withColumn("tool", F.lit("acme"))).first().errors == 0
    assert files.read_manifest(spark, "acme", base).count() == 2
    assert cli.main([*args, "--no-validate"], spark) == 0  # nothing new: all are skipped by their hash
    assert cli.main(["https://docs.acme.example/guide/a", "--show-info"], spark) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"tool_name": "acme", "scope_host": "docs.acme.example", "scope_prefix": "/guide/a"}


def test_a_second_run_keeps_what_the_first_made(spark, pages, tmp_path, capsys):
    """One page changes on another day: listings and log keep all entries, the description stays, other tools' lines too."""
    base = str(tmp_path / "out")
    args = lambda path, day: ["https://docs.acme.example/guide", "--pages", path, "--base", base, "--run-ts", f"2025-01-{day}T03:04:05+00:00", "--quiet"]
    assert cli.main(args(pages, "02"), spark) == 0
    root = tmp_path / "out" / "docs" / "tools"
    note = root / "acme" / "guide" / "b.md"
    note.write_text(note.read_text().replace("title: B\n", "title: B\ndescription: kept words\nkeywords:\n- one\n"))
    (root / "index.md").write_text("# Tools\n\n- [other](./other/) - https://other.example\n- [acme](./acme/) - old\n")
    changed = str(tmp_path / "changed.parquet")
    spark.createDataFrame([(1, "https://docs.acme.example/guide/a", HTML.format("A")), (2, "https://docs.acme.example/guide/b", HTML.format("B new"))], "seq long, url string, html string").write.parquet(changed)
    assert cli.main(args(changed, "05"), spark) == 0
    assert (root / "acme" / "guide" / "index.md").read_text() == "# Guide\n\n- [A](./a.md) - \n- [B new](./b.md) - kept words\n"
    log = (root / "acme" / "log.md").read_text()
    assert log.index("## 2025-01-05") < log.index("* **Update**: [B new](./guide/b.md)") < log.index("## 2025-01-02") < log.index("* **Creation**: [A](./guide/a.md)")
    assert (root / "index.md").read_text() == "# Tools\n\n- [acme](./acme/) - https://docs.acme.example/guide\n- [other](./other/) - https://other.example\n"
    text = note.read_text()
    assert "description: kept words" in text and "- one" in text and "Text of B new" in text
    assert "**" not in (root / "acme" / "glossary.md").read_text()
    note.unlink()
    capsys.readouterr()
    assert cli.main(["https://docs.acme.example/guide", "--base", base, "--convert-only", "--run-ts", "2025-01-06T00:00:00+00:00", "--quiet"], spark) == 0
    assert "Converted: 2 pages" in capsys.readouterr().out and "Text of B new" in note.read_text()
    assert (root / "acme" / "log.md").read_text() == log


def test_a_crawl_with_all_options(spark, tmp_path, capsys, monkeypatch):
    def answer(prompt):
        if prompt.startswith("Define"):
            return '```json\n[{"term": "Queue", "definition": "holds rows"}]\n```'
        return json.dumps({"summary": "about it", "keywords": ["k"], "candidates": ["Queue"]})

    def shown(url):
        if url.endswith("/guide/b"):
            raise RuntimeError("no browser")
        return HTML.format("Rendered " + url[-1])

    def client(url, headers, timeout):
        if url.endswith("robots.txt"):
            return Response(200, "User-agent: *\nDisallow: /guide/secret")
        body = {"guide": "<main><h1>G</h1><a href='/guide/a'>a</a><a href='/guide/b'>b</a><a href='/guide/secret'>s</a><a href='/blog'>x</a></main>"}.get(url.rsplit("/", 1)[-1], "<main>short</main>")
        assert headers["X"] == "y" and headers["Cookie"] == "c=1"
        return Response(304 if headers.get("If-None-Match") else 200, body, "tag", None)

    import sys
    import types

    module = types.ModuleType("foliant_test_hooks")
    module.answer, module.shown = answer, shown
    monkeypatch.setitem(sys.modules, "foliant_test_hooks", module)
    base = str(tmp_path / "out")
    args = ["https://docs.acme.example/guide", "--base", base, "--delay", "0", "--header", "X: y", "--cookie", "c=1", "--safe-mode", "--renderer", "foliant_test_hooks:shown", "--summarize", "--provider", "foliant_test_hooks:answer", "--run-ts", "2025-01-02T03:04:05+00:00"]
    assert cli.main(args, spark, client) == 0
    out = capsys.readouterr()
    root = tmp_path / "out" / "docs" / "tools" / "acme"
    assert "Rendered a" in (root / "guide" / "a.md").read_text() and not (root / "guide" / "b.md").exists() and not (root / "guide" / "secret.md").exists()
    assert "FAILED https://docs.acme.example/guide/b: no browser" in out.err and "Summarized 2 pages (1 failed)." in out.out and "Candidate terms: Queue" in out.out
    assert "description: about it" in (root / "guide" / "a.md").read_text() and "**Queue**: holds rows" in (root / "glossary.md").read_text()
    rows = {r.url.rsplit("/", 1)[-1]: r for r in files.read_manifest(spark, "acme", base).collect()}
    assert rows["b"].status == "errored" and rows["a"].etag is None  # a rendered page has no validators
    assert cli.main(["u", "--render"], spark) == 2 and cli.main(["u", "--summarize"], spark) == 2


def test_headers():
    args = cli.parser().parse_args(["u", "--header", "A: b", "--header", "Cookie: x", "--cookie", "c=1", "--cookie", "d=2"])
    assert cli.headers_of(args) == {"A": "b", "Cookie": "c=1; d=2"}


def test_retries():
    waits, seen = [], []

    def client(outcomes):
        def call(url, headers, timeout):
            seen.append(url)
            x = outcomes.pop(0)
            if isinstance(x, Exception):
                raise x
            return Response(x)

        return call

    assert fetch_with_retry(client([ConnectionError(), 503, 200]), "u", {}, waits.append)[1] == 3
    assert waits == [2.0, 4.0]
    assert fetch_with_retry(client([404]), "u", {}, waits.append)[0].status == 404
    assert fetch_with_retry(client([500] * 4), "u", {}, waits.append)[0].status == 500
    with pytest.raises(TimeoutError):
        fetch_with_retry(client([TimeoutError()] * 4), "u", {}, waits.append)


def test_fetching_rows(spark):
    def client(url, headers, timeout):
        if "lost" in url:
            raise ConnectionError("reset")
        if "same" in url:
            return Response(304 if headers.get("If-None-Match") == "e" else 200)
        return Response(404 if "gone" in url else 200, "<p>", "tag", None)

    urls = spark.createDataFrame([("https://a.b/ok", 1, None, None), ("https://a.b/gone", 2, None, None), ("https://c.d/lost", 3, None, None), ("https://c.d/same", 4, "e", None)], "url string, seq long, etag string, last_modified string")
    got = {r.seq: r for r in fetch_pages(urls, client, delay=0, sleep=lambda s: None).collect()}
    assert (got[1].http_status, got[1].html, got[1].etag, got[1].attempts) == (200, "<p>", "tag", 1)
    assert got[2].error == "HTTP 404" and got[2].html is None and got[3].error == "reset" and got[3].http_status is None and got[4].http_status == 304


def test_stream_of_pages(spark, tmp_path):
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    put = lambda rows: spark.createDataFrame(rows, PAGES).coalesce(1).write.mode("append").parquet(source)
    put([(1, "https://docs.a.example/x", HTML.format("One"), 200, None), (2, "https://docs.a.example/bad", None, 500, None)])
    start(spark, source, out, state, "r1").awaitTermination()
    put([(3, "https://docs.a.example/x", HTML.format("One"), 200, None), (4, "https://docs.a.example/y", HTML.format("Two"), 200, None)])
    start(spark, source, out, state, "r2").awaitTermination()
    rows = spark.read.parquet(f"{out}/concepts").orderBy("page_path").collect()
    assert [(r.page_path, r.title) for r in rows] == [("x", "One"), ("y", "Two")]  # the unchanged page came once


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "FULL_EVERY", 2)
    out = str(tmp_path / "out")
    for n in (0, 1, 1, 2, 3, 3):
        rows = [(1, "https://docs.a.example/x", HTML.format(f"X{n}"), 200, None), (2, f"https://docs.a.example/p{n}", HTML.format(f"P{n}"), 200, None), (2, f"https://docs.a.example/p{n}", HTML.format(f"P{n}"), 200, None)]
        incremental.merge_batch(spark.createDataFrame(rows, PAGES), n, out, f"r{n}")
    assert {(r.page_path, r.title) for r in incremental.read_concepts(spark, out).collect()} == {("x", "X3"), *((f"p{n}", f"P{n}") for n in range(4))}
    assert incremental.read_state(spark, out).count() == 5 and scale.children(spark, f"{out}/full") == ["batch=2"]
    assert scale.exists(spark, out) and not scale.exists(spark, f"{out}/none") and scale.children(spark, f"{out}/none") == []
