"""A tool's run: pages against the state of earlier runs, then concepts, summaries, listings, log, glossary, tools."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.functions import urls as U
from foliant.operators import bundle, conformance
from foliant.operators.crawl import crawl_status, merged_manifest, numbered
from foliant.plans.pages import concepts, page_links, pages_table, parsed_pages
from foliant.plans.summaries import Provider, glossary, summarised
from foliant.scale import cut
from foliant.sources import files
from foliant.sources.fetch import Client, fetch_pages
from foliant.sources.frontmatter import merged_text, with_frontmatter

#: ``renderer(url)`` gives a page's html as a browser shows it.
Renderer = Callable[[str], str]
STATE = ("tool", "url", "seq", "page_path", "html", "content_hash", "http_status", "error", "etag", "last_modified")


@dataclass
class Site:
    """Where a tool's files are, and how its run goes."""

    spark: SparkSession
    tool: str
    entry_url: str
    run_ts: str
    base: str = "."
    concept_type: str = "Reference"
    renderer: Renderer | None = None
    render_all: bool = False
    provider: Provider | None = None
    concurrency: int = 6
    batch_size: int = 15
    #: Counts and frames that a run leaves for its report.
    report: dict = field(default_factory=dict)

    # state of earlier runs

    def prior(self) -> DataFrame:
        return cut(files.read_manifest(self.spark, self.tool, self.base))

    def tree(self) -> DataFrame:
        """``(tool, path, text)`` of the bundle's files as they are now."""
        folder = files.bundle_dir(self.tool, self.base)
        if not os.path.isdir(folder):
            return self.spark.createDataFrame([], "tool string, path string, text string")
        return files.read_tree(self.spark, folder).select(F.lit(self.tool).alias("tool"), "path", "text")

    def concept_files(self) -> DataFrame:
        """``(tool, page_path, title, description, keywords, content_hash, md)`` of the bundle's concepts."""
        own = self.tree().withColumn("page_path", F.regexp_replace("path", r"\.md$", "")).filter(~X.is_reserved(F.col("page_path")))
        rows = with_frontmatter(own).select("tool", "page_path", "front.title", "front.description", "front.keywords", "front.content_hash", F.col("text").alias("md"))
        return cut(rows)

    # one run

    def convert(self, raw: DataFrame) -> DataFrame:
        """Fetched pages (seq, url, html, and http_status, error, etag, last_modified where known) against the
        manifest: new and changed ones become concepts, which keep their description and keywords; the caches and the
        manifest follow. Gives the status of every page."""
        prior = self.prior()
        pages = pages_table(raw).withColumn("tool", F.lit(self.tool))
        extra = {"http_status": "int", "error": "string", "etag": "string", "last_modified": "string"}
        known = [F.col(c).cast(t).alias(c) if c in raw.columns else F.lit(None).cast(t).alias(c) for c, t in extra.items()]
        answers = raw.select(F.col("seq").alias("a_seq"), F.col("url").alias("a_url"), *known)
        pages = pages.join(answers, (F.col("seq") == F.col("a_seq")) & F.col("url").eqNullSafe(F.col("a_url"))).select(*STATE)
        result = cut(crawl_status(pages, prior.select("tool", "url", "content_hash")))
        if self.renderer:
            result = self._rendered(result)
        fresh = result.filter(F.col("status").isin("fetched", "updated"))
        all_pages = prior.select("tool", "url", "page_path").unionByName(result.select("tool", "url", "page_path")).distinct()
        done = self._write(fresh, all_pages)
        labels = done.select("url", "nav_path")
        state = result.join(labels, "url", "left").withColumn("fetched_at", F.lit(self.run_ts))
        state = state.withColumn("cache_path", F.concat(F.lit(f"{files.cache_dir(self.tool, '')}/raw/"), "page_path", F.lit(".html")))
        files.write_manifests(cut(merged_manifest(state, prior)), self.base)
        self.report["result"] = result
        self.report["changed"] = result.select("tool", "url", "seq", "page_path", "status").join(done.select("url", "title"), "url", "left")
        return result

    def reconvert(self) -> DataFrame:
        """The cached pages of the manifest as concepts again; entries without a cached page are passed over."""
        prior = self.prior()
        cached = files.read_raw(self.spark, self.tool, self.base).select("page_path", "html")
        pages = prior.filter(F.col("status").isNull()).select("tool", "url", "seq", "page_path", "content_hash").join(cached, "page_path")
        done = self._write(cut(pages.select("tool", "url", "seq", "page_path", "html", "content_hash")), prior.select("tool", "url", "page_path"), raw=False)
        return done

    def _write(self, pages: DataFrame, manifest: DataFrame, raw: bool = True) -> DataFrame:
        existing = self.concept_files().select("tool", "page_path", "description", "keywords")
        done = cut(concepts(pages.select("seq", "url", "html", "tool", "page_path", "content_hash"), manifest, self.run_ts, existing, self.concept_type))
        if raw:
            files.export_raw(pages, self.base)
        files.export_files(done.select("tool", F.concat("page_path", F.lit(".md")).alias("path"), F.col("md").alias("text")), self.base)
        return done

    def _rendered(self, result: DataFrame) -> DataFrame:
        """New and changed pages with too little text (or all) as the renderer shows them, with the hash of that and
        without validators; a renderer's exception makes the page FAILED."""
        renderer = self.renderer
        parsed = parsed_pages(result.filter(F.col("status").isin("fetched", "updated")).select("seq", "url", "html"))
        thin = parsed if self.render_all else parsed.filter(X.below_threshold(F.col("body")))

        def run(batches):
            for batch in batches:
                out = []
                for url in batch.url:
                    try:
                        out.append((url, renderer(url), None))
                    except Exception as e:  # noqa: BLE001 - a page's failure is its result
                        out.append((url, None, str(e) or type(e).__name__))
                yield pd.DataFrame(out, columns=["r_url", "r_html", "r_error"])

        shown = cut(thin.select("url").distinct().mapInPandas(run, "r_url string, r_html string, r_error string"))
        both = result.join(shown, F.col("url") == F.col("r_url"), "left")
        new = F.col("r_html").isNotNull()
        return cut(
            both.withColumns(
                {
                    "html": F.coalesce("r_html", "html"),
                    "content_hash": F.when(new, X.content_hash(F.col("r_html"))).otherwise(F.col("content_hash")),
                    "etag": F.when(~new, F.col("etag")),
                    "last_modified": F.when(~new, F.col("last_modified")),
                    "status": F.when(F.col("r_error").isNotNull(), "FAILED").otherwise(F.col("status")),
                    "error": F.coalesce("r_error", "error"),
                }
            ).drop("r_url", "r_html", "r_error")
        )

    def summarise(self) -> DataFrame:
        """Descriptions and keywords from the provider for pages without or with an old one; ``summary_totals``."""
        made = cut(summarised(self.prior(), self.concept_files(), self.provider, self.batch_size, self.concurrency))
        update = F.to_json(F.struct(F.col("summary").alias("description"), "keywords", F.col("m_hash").alias("content_hash")))
        hashes = self.prior().select("tool", "page_path", F.col("content_hash").alias("m_hash"))
        new = made.filter("status = 'summarized'").join(hashes, ["tool", "page_path"]).select("tool", "page_path", update.alias("update"))
        out = self.concept_files().join(new, ["tool", "page_path"]).select("tool", F.concat("page_path", F.lit(".md")).alias("path"), merged_text(F.col("md"), F.col("update")).alias("text"))
        files.export_files(cut(out), self.base)
        return bundle.summary_totals(made)

    def synthesise(self, candidates: DataFrame | None = None) -> DataFrame:
        """Glossary, listings over the whole manifest, the tools listing and the log, each merged with what is there.

        ``candidates`` is (tool, seq, term); without any, the keywords of the concepts stand in. Gives the files."""
        known = self.concept_files()
        if candidates is None or not candidates.limit(1).count():
            terms = bundle.keyword_candidates(known)
            candidates = terms.withColumn("seq", F.row_number().over(bundle.Window.partitionBy("tool").orderBy("page_path", "pos")).cast("long")).select("tool", "seq", "term")
        self.report["top"] = bundle.top_candidates(candidates)
        tree = self.tree()
        filled = tree.filter("path = 'glossary.md'").filter(X.glossary_filled(F.col("text"))).limit(1).count() > 0
        made = glossary(candidates, self.provider or (lambda _: "[]"), [self.tool] if filled else [], tools=self.spark.createDataFrame([(self.tool,)], "tool string"))
        pages = self.prior().select("tool", "page_path").distinct().join(known.select("tool", "page_path", "title", "description"), ["tool", "page_path"], "left")
        out = made.unionByName(bundle.listing_files(pages))
        new = self.report.get("changed")
        if new is not None:
            log = bundle.log_rows(tree.filter("path = 'log.md'"))
            lines = bundle.log_lines(new.withColumn("day", F.lit(self.run_ts[:10]).cast("date")))
            out = out.unionByName(bundle.log_files(bundle.merged_log(log, lines)))
        out = cut(out)
        files.export_files(out, self.base)
        self._tools()
        return out

    def _tools(self) -> None:
        """The listing of all bundles: this tool's line is put in its place or at the end."""
        path = os.path.join(self.base, "docs", "tools", "index.md")
        old = self.spark.createDataFrame([], "value string")
        if os.path.exists(path):
            old = self.spark.read.text(path)
        rows = old.select(F.regexp_extract("value", r"^- \[([^\]]+)\]\(\./[^)]*/\) - (.*)$", 1).alias("tool"), F.regexp_extract("value", r"^- \[([^\]]+)\]\(\./[^)]*/\) - (.*)$", 2).alias("entry_url")).filter("tool <> ''")
        update = self.spark.createDataFrame([(self.tool, self.entry_url)], "tool string, entry_url string")
        lines = [r.line for r in bundle.tools_lines(bundle.merged_tools(cut(rows), update)).orderBy("tool").collect()]  # a line a tool
        files.place(path, "\n".join(["# Tools", "", *lines]) + "\n")

    def validate(self) -> tuple[int, int, int]:
        """Files, errors and warnings of the whole bundle."""
        if not os.path.isdir(files.bundle_dir(self.tool, self.base)):
            raise NotADirectoryError(files.bundle_dir(self.tool, self.base))
        found = conformance.summary(self.tree()).first()
        return (found.files, found.errors, found.warnings) if found else (0, 0, 0)


def crawl(spark: SparkSession, entry_url: str, client: Client, prior: DataFrame, headers: dict[str, str] | None = None, delay: float = 1.0, single: bool = False, allowed: Callable[[DataFrame], DataFrame] | None = None, sleep: Callable[[float], None] | None = None) -> DataFrame:
    """``(seq, url, html, http_status, error, etag, last_modified)`` of the pages in scope that links reach from
    ``entry_url``, breadth first: each level is fetched, written, and its links are held against all urls met.

    Known pages go out with the manifest's validators. ``allowed`` filters urls (robots rules).
    """
    scope = spark.range(1).select(U.crawl_scope(F.lit(entry_url)).alias("s")).first().s
    level = spark.createDataFrame([(entry_url,)], "url string")
    met, out, base = level, None, 0
    while True:
        level = allowed(level) if allowed else level
        known = prior.select("url", "etag", "last_modified")
        asked = level.join(known, "url", "left")
        asked = numbered(asked, ["url"], base)
        got = cut(fetch_pages(asked, client, headers, delay, **({"sleep": sleep} if sleep else {})))
        base += got.count()
        out = got if out is None else cut(out.unionByName(got))
        if single or not got.limit(1).count():
            return out
        links = page_links(parsed_pages(pages_table(got)), (F.lit(scope.netloc), F.lit(scope.path_prefix)))
        level = cut(links.select(F.col("normalized").alias("url")).distinct().join(met, "url", "left_anti"))
        if not level.limit(1).count():
            return out
        met = cut(met.unionByName(level))
