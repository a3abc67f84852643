"""Command line: ``python -m foliant.cli URL`` fetches a site, ``--pages PAGES.parquet`` takes stored pages."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from datetime import UTC, datetime
from urllib.parse import urlparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from foliant.functions import urls as U
from foliant.operators import conformance
from foliant.operators.crawl import robots_allowed
from foliant.plans.site import Site, crawl
from foliant.progress import Console
from foliant.scale import ship_package
from foliant.sources import files
from foliant.sources.fetch import http_client


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="foliant")
    p.add_argument("url")
    p.add_argument("--pages", help="Parquet of raw pages (seq, url, html) in place of fetching")
    p.add_argument("--base", default=".")
    p.add_argument("--tool-name")
    p.add_argument("--single-page", action="store_true")
    p.add_argument("--convert-only", action="store_true", help="convert the cached pages again")
    p.add_argument("--fresh", action="store_true")
    p.add_argument("--render", action="store_true", help="render every new page; needs --renderer")
    p.add_argument("--renderer", help="module:function that gives a url's html; used for pages with little text")
    p.add_argument("--safe-mode", action="store_true")
    p.add_argument("--robots", help="file of robots rules for --safe-mode; without it they are fetched")
    p.add_argument("--header", action="append", default=[])
    p.add_argument("--cookie", action="append", default=[])
    p.add_argument("--delay", type=float, default=1.0)
    p.add_argument("--show-info", action="store_true")
    p.add_argument("--summarize", action="store_true", help="needs --provider")
    p.add_argument("--summarize-concurrency", type=int, default=6)
    p.add_argument("--summarize-batch-size", type=int, default=15)
    p.add_argument("--provider", help="module:function that answers a prompt, for summaries and glossaries")
    p.add_argument("--type", default="Reference")
    p.add_argument("--no-validate", action="store_true")
    p.add_argument("--quiet", action="store_true")
    p.add_argument("--run-ts", default=None)
    return p


def headers_of(args: argparse.Namespace) -> dict[str, str]:
    """Headers of ``K:V`` arguments; cookies are joined and stand before a Cookie header."""
    out = {k.strip(): v.strip() for k, _, v in (h.partition(":") for h in args.header)}
    return out | ({"Cookie": "; ".join(args.cookie)} if args.cookie else {})


def info(spark: SparkSession, url: str, tool: str | None = None) -> str:
    row = spark.range(1).select(U.tool_name(F.lit(url)).alias("t"), U.crawl_scope(F.lit(url)).alias("s")).first()
    return json.dumps({"tool_name": tool or row.t, "scope_host": row.s.netloc, "scope_prefix": row.s.path_prefix})


def named(path: str | None):
    """What ``module:function`` names."""
    if not path:
        return None
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def robots_rules(args: argparse.Namespace, client) -> str | None:
    if args.robots:
        with open(args.robots, encoding="utf-8") as f:
            return f.read()
    try:
        found = client(f"{urlparse(args.url).scheme}://{urlparse(args.url).netloc}/robots.txt", headers_of(args), 30)
        return found.text if found.status < 400 else None
    except Exception:  # noqa: BLE001 - rules that can't be read allow all
        return None


def main(argv: list[str] | None = None, spark: SparkSession | None = None, client=None) -> int:
    args = parser().parse_args(argv)
    if args.render and not args.renderer or args.summarize and not args.provider:
        print("--render needs --renderer, --summarize needs --provider", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("foliant").getOrCreate()
    ship_package(spark)
    known = json.loads(info(spark, args.url, args.tool_name))
    if args.show_info:
        print(json.dumps(known))
        return 0
    client = client or http_client
    console = Console(enabled=not args.quiet)
    site = Site(
        spark, known["tool_name"], args.url, args.run_ts or datetime.now(UTC).isoformat(), args.base, args.type, named(args.renderer), args.render, named(args.provider),
        args.summarize_concurrency, args.summarize_batch_size,
    )
    if args.fresh:
        files.wipe(site.tool, args.base)
    if args.convert_only:
        console.begin("converting cached pages")
        print(f"Converted: {site.reconvert().count()} pages")
    else:
        rules = robots_rules(args, client) if args.safe_mode else None
        allowed = (lambda x: robots_allowed(x, rules, "foliant")) if args.safe_mode else None
        console.begin("reading pages")
        if args.pages:
            raw = spark.read.parquet(args.pages)
            own = F.col("url") == args.url if args.single_page else U.in_scope(F.col("url"), F.lit(urlparse(args.url).netloc), F.lit(known["scope_prefix"]))
            raw = raw.filter(own)
            raw = allowed(raw) if allowed else raw
        else:
            raw = crawl(spark, args.url, client, site.prior(), headers_of(args), args.delay, args.single_page, allowed)
        result = site.convert(raw)
        console.stage("Crawled", result)
        for r in result.filter(F.col("status").isin("fetched", "updated")).select("page_path").distinct().orderBy("page_path").toLocalIterator():
            print(f"Written: {files.bundle_dir(site.tool, args.base)}/{r.page_path}.md")
    candidates = None
    if args.summarize:
        console.begin("summarising")
        totals = site.summarise().filter(F.col("tool") == site.tool)
        row = totals.first()
        print(f"Summarized {row.done if row else 0} pages ({row.failed if row else 0} failed).")
        candidates = totals.select("tool", F.posexplode("candidates").alias("seq", "term")).withColumn("seq", F.col("seq").cast("long"))
    console.banner("Synthesizing navigation layer…")
    site.synthesise(candidates)
    top = [r.term for r in site.report["top"].collect()]
    if top:
        print(f"Candidate terms: {', '.join(top)}")
    if args.no_validate:
        return 0
    console.banner("Validating bundle…")
    count, errors, warnings = site.validate()
    print(f"{count} files, {errors} errors, {warnings} warnings")
    return conformance.exit_code(errors)


if __name__ == "__main__":
    sys.exit(main())
