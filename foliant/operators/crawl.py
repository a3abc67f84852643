"""Crawl state: discovery over stored links, status against the manifest, sitemaps, robots rules."""

from __future__ import annotations

import itertools
import urllib.robotparser
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from foliant.scale import cut

SITEMAP = "{http://www.sitemaps.org/schemas/sitemap/0.9}"
#: Answers that are worth another attempt, and how often and how long to wait.
RETRY_STATUSES = [429, 500, 502, 503, 504]
MAX_RETRIES, FIRST_WAIT, BACKOFF = 3, 2.0, 2.0


def crawl_status(fetched: DataFrame, prior: DataFrame) -> DataFrame:
    """``fetched`` (tool, url, http_status, error, content_hash, ...) with ``status`` against ``prior`` (tool, url, content_hash).

    The first that holds: FAILED for an error or an answer of 400 and more; skipped for 304 or an equal hash;
    updated if the manifest had the url, error rows included; fetched. A null hash equals none.
    """
    known = prior.groupBy(F.col("tool").alias("p_tool"), F.col("url").alias("p_url")).agg(F.max("content_hash").alias("p_hash"))
    both = fetched.join(known, F.col("tool").eqNullSafe(F.col("p_tool")) & (F.col("url") == F.col("p_url")), "left")
    failed = F.col("error").isNotNull() | (F.coalesce("http_status", F.lit(0)) >= 400)
    status = (
        F.when(failed, "FAILED")
        .when((F.col("http_status") == 304) | (F.col("content_hash") == F.col("p_hash")), "skipped")
        .when(F.col("p_url").isNotNull(), "updated")
        .otherwise("fetched")
    )
    return both.withColumn("status", status).drop("p_tool", "p_url", "p_hash")


def merged_manifest(result: DataFrame, prior: DataFrame) -> DataFrame:
    """The manifest after a run: failed urls' rows are replaced by error rows, changed ones by new ones, rest stays.

    ``result`` is a crawl_status with tool, page_path, cache_path, fetched_at, etag, last_modified, nav_path.
    """
    new = result.filter(F.col("status") != "skipped")
    ok = F.col("status") != "FAILED"
    row = new.select(
        "tool", "url", "seq", "page_path",
        *(F.when(ok, F.col(c)).alias(c) for c in ("cache_path", "fetched_at", "etag", "last_modified", "content_hash", "nav_path")),
        F.when(~ok, F.lit("errored")).alias("status"),
        F.when(~ok, F.coalesce("error", F.format_string("HTTP %d", "http_status"))).alias("error"),
    )
    return prior.join(row.select("tool", "url"), ["tool", "url"], "left_anti").select(row.columns).unionByName(row)


def discover(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Breadth-first order over a stored link table: ``(url, depth, seq)``.

    ``edges`` is (src, pos, dst), ``entries`` is (url). Each level is an anti join against what has been met, written
    to the shared folder; within a level the order is that of the parent, then of the link. Cycles end by themselves: levels go on
    until one is empty, at whatever depth.
    """
    level = numbered(entries.select("url").distinct().withColumn("depth", F.lit(0)), ["url"], 0)
    seen = level
    for depth in itertools.count(1):
        found = edges.join(level.select(F.col("url").alias("src"), F.col("seq").alias("parent")), "src").groupBy(F.col("dst").alias("url")).agg(F.min(F.struct("parent", "pos")).alias("at"))
        found = found.join(seen.select("url"), "url", "left_anti")
        base = seen.agg(F.max("seq")).first()[0] or 0
        level = numbered(found.select("url", F.lit(depth).alias("depth"), "at.parent", "at.pos"), ["parent", "pos", "url"], base).drop("parent", "pos")
        if not level.limit(1).count():
            break
        seen = cut(seen.unionByName(level))
    return seen


def numbered(rows: DataFrame, order: list[str], base: int) -> DataFrame:
    """``rows`` with ``seq``, their place in the order of the columns, from ``base`` + 1 on. Written once.

    Rows are sorted in ranges, each range counts its own, and the counts of the ranges before it, one number each, are
    added; no task holds them all.
    """
    ranged = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before, sums = {}, 0
    for r in ranged.groupBy("_range").count().orderBy("_range").collect():
        before[r["_range"]], sums = sums, sums + r["count"]
    offset = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("_range")] if before else F.lit(0)
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return cut(ranged.withColumn("seq", (place + offset + F.lit(base)).cast("long")).drop("_range"))


def sitemap_locations(xml: str | None) -> tuple[str, list[str]] | None:
    """``("index" | "urls", locations)`` of a sitemap; null for bad XML."""
    try:
        root = ET.fromstring(xml)
    except (ET.ParseError, TypeError, ValueError):
        return None
    kind = "index" if root.find(f"{SITEMAP}sitemap") is not None else "urls"
    return kind, [(x.text or "").strip() for x in root.iter(f"{SITEMAP}loc")]


@F.pandas_udf(T.StructType([T.StructField("kind", T.StringType()), T.StructField("locations", T.ArrayType(T.StringType()))]))
def _sitemap(xml: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([sitemap_locations(x) or (None, None) for x in xml], columns=["kind", "locations"])


def sitemap_urls(documents: DataFrame, root_url: str) -> DataFrame:
    """``(url, pos)`` from stored sitemap files (sitemap_url, xml): the root's locations, or those of its children.

    One level of index is followed, children that are missing or bad are passed over, locations aren't deduplicated.
    A bad or missing root gives no rows.
    """
    each = cut(documents.withColumn("s", _sitemap("xml")).filter("s.kind is not null").select("sitemap_url", "s.kind", F.posexplode("s.locations").alias("pos", "loc")))
    root = each.filter(F.col("sitemap_url") == root_url)
    own = root.filter("kind = 'urls'").select(F.col("loc").alias("url"), F.lit(0).alias("a"), "pos")
    child = root.filter("kind = 'index'").select(F.col("loc").alias("c"), F.col("pos").alias("a")).join(each.select(F.col("sitemap_url").alias("c"), F.col("loc").alias("url"), "pos"), "c").select("url", "a", "pos")
    rows = own.unionByName(child)
    return rows.select("url", F.struct("a", "pos").alias("o")).select("url", (F.col("o.a") * 1_000_000 + F.col("o.pos")).cast("long").alias("pos"))


def robots_allowed(urls: DataFrame, rules: str | None, agent: str, url: str = "url") -> DataFrame:
    """``urls`` that the rules of a robots.txt allow; unreadable rules (null) allow all."""
    if rules is None:
        return urls

    @F.pandas_udf("boolean")
    def allowed(found: pd.Series) -> pd.Series:
        parser = urllib.robotparser.RobotFileParser()
        parser.parse(rules.splitlines())
        return found.map(lambda u: u is not None and parser.can_fetch(agent, u))

    return urls.filter(allowed(F.col(url)))
