"""Raw pages to concepts: one tree parse a page, links joined with the manifest, frontmatter."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions import text as X
from foliant.functions import urls as U
from foliant.operators import dom
from foliant.operators.render import Renderer
from foliant.scale import bounded_broadcast, cut, one_row_per_id
from foliant.sources.frontmatter import frontmatter_text

#: What stands in a rendered body for its n-th link until the link is known.
OPEN, CLOSE = "", ""
PARSED = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("nav_path", T.ArrayType(T.StringType())),
        T.StructField("hrefs", T.ArrayType(T.StringType())),
        T.StructField("body", T.StringType()),
        T.StructField("body_hrefs", T.ArrayType(T.StringType())),
    ]
)


def parse_page(html: str | None, url: str | None) -> tuple:
    """Title, menu labels, all hrefs, the body as Markdown with link marks, and the body's hrefs."""
    if html is None:
        return None, None, None, None, None
    root = dom.parse(html)
    title, nav, links = dom.title_of(root), dom.nav_path(root, url or ""), dom.hrefs(root)
    content = dom.content_of(root)
    dom.clean_code(root, content)
    found: list[str] = []

    def link(at: int, href: str) -> str:
        found.append(href)
        return f"{OPEN}{len(found) - 1}{CLOSE}"

    return title, nav, links, Renderer(url or "", link)(content).replace("\r\n", "\n"), found


@F.pandas_udf(PARSED)
def _parse(html: pd.Series, url: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_page(h, u) for h, u in zip(html, url, strict=True)], columns=PARSED.names)


_parse_once = _parse.asNondeterministic()  # fields of its struct must not run it again


def pages_table(raw: DataFrame, seq: str = "seq") -> DataFrame:
    """``(seq, url, html, tool, page_path, content_hash)`` of raw pages; other columns are dropped."""
    return raw.select(
        F.col(seq).alias("seq"), "url", "html", U.tool_name(F.col("url")).alias("tool"), U.page_path(F.col("url")).alias("page_path"), X.content_hash(F.col("html")).alias("content_hash")
    )


def parsed_pages(pages: DataFrame) -> DataFrame:
    """``pages`` without html, with the fields of PARSED. One Python call a page, nothing shuffled."""
    return pages.withColumn("p", _parse_once("html", "url")).select(*[c for c in pages.columns if c != "html"], "p.*")


def page_links(parsed: DataFrame, scope: tuple[Column, Column] | None = None) -> DataFrame:
    """``(url, pos, href, resolved, normalized)``: a page's links on the web, in scope, the first of each kept."""
    each = parsed.select("url", F.posexplode("hrefs").alias("pos", "href"))
    each = each.withColumn("resolved", U.resolve(F.col("url"), F.col("href"))).filter(U.is_web(F.col("resolved")))
    each = each.withColumn("normalized", U.normalized(F.col("resolved")))
    if scope is not None:
        each = each.filter(U.in_scope(F.col("normalized"), *scope))
    first = each.groupBy("url", "normalized").agg(F.min(F.struct("pos", "href", "resolved")).alias("f"))
    return first.select("url", "f.pos", "f.href", "f.resolved", "normalized")


def link_targets(parsed: DataFrame, manifest: DataFrame, mode: str = "convert") -> DataFrame:
    """``(tool, url, seq, at, link)``: what stands for each link of each body; a url that came twice has both.

    Fragments and other schemes stay; a link to a page of the manifest becomes its relative file and keeps the
    fragment; others become absolute. ``manifest`` has tool, url, page_path, and for ``mode="crawl_order"`` seq and
    in_prior: then only pages known before, or crawled no later than the linking one, are rewritten.
    """
    if mode not in ("convert", "crawl_order"):
        raise ValueError(f"no mode {mode}")
    each = parsed.select("tool", "url", "page_path", "seq", F.posexplode("body_hrefs").alias("at", "href"))
    each = each.withColumn("resolved", U.resolve(F.col("url"), F.col("href")))
    fixed = F.startswith("href", F.lit("#")) | ~U.is_web(F.col("resolved"))
    each = each.withColumn("key", F.when(~fixed, U.normalized(F.col("resolved"))))
    known = manifest.filter(F.coalesce("page_path", F.lit("")) != "").groupBy(F.col("tool").alias("m_tool"), F.col("url").alias("m_url"))
    if mode == "convert":
        known = known.agg(F.max("page_path").alias("m_path"))
        when = F.lit(True)
    else:
        known = known.agg(F.max("page_path").alias("m_path"), F.min("seq").alias("m_seq"), F.max("in_prior").alias("m_prior"))
        when = F.col("m_prior") | (F.col("m_seq") <= F.col("seq"))
    hit = each.join(known, (F.col("tool") == F.col("m_tool")) & (F.col("key") == F.col("m_url")) & when, "left")
    tail = F.when(U.fragment(F.col("resolved")) != "", F.concat(F.lit("#"), U.fragment(F.col("resolved")))).otherwise("")
    link = F.when(F.col("key").isNull(), F.col("href")).when(F.col("m_path").isNotNull(), F.concat(U.relative_md(F.col("m_path"), F.col("page_path")), tail)).otherwise(F.col("resolved"))
    return hit.select("tool", "url", "seq", "at", link.alias("link"))


def filled(body: Column, links: Column) -> Column:
    """A body with its link marks replaced by the links of a map from place to link."""
    parts = F.split(body, OPEN, -1)
    rest = F.transform(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda p: F.concat(F.coalesce(F.try_element_at(links, F.substring_index(p, CLOSE, 1).cast("int")), F.lit("")), F.regexp_replace(p, f"^[^{CLOSE}]*{CLOSE}", "")),
    )
    return F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))


def concepts(
    pages: DataFrame,
    manifest: DataFrame,
    run_ts: str,
    existing: DataFrame | None = None,
    concept_type: str = "Reference",
    mode: str = "convert",
) -> DataFrame:
    """Converted pages: ``tool, page_path, url, type, title, description, resource, timestamp, content_hash, keywords,
    nav_path, body, md``.

    ``pages`` is a pages_table; a row that comes twice counts once, of several urls on one page path the one with the
    greatest seq wins. Descriptions and
    keywords of ``existing`` (tool, page_path, description, keywords) are kept. Which urls lose their path is found by
    their numbers, before anything is parsed. Parsed pages are written once to the shared folder, since links and
    bodies are both taken from them.
    """
    pages = one_row_per_id(pages.withColumn("_page", F.concat_ws(" ", "seq", "tool", "url")), "_page").drop("_page")
    names = pages.select("tool", "page_path", "seq", "url")
    best = names.groupBy("tool", "page_path").agg(F.max(F.struct("seq", "url")).alias("w")).select(F.col("tool").alias("w_tool"), F.col("page_path").alias("w_path"), "w.seq", "w.url").toDF("w_tool", "w_path", "w_seq", "w_url")
    same = F.col("tool").eqNullSafe(F.col("w_tool")) & F.col("page_path").eqNullSafe(F.col("w_path"))
    wins = F.col("seq").eqNullSafe(F.col("w_seq")) & F.col("url").eqNullSafe(F.col("w_url"))
    losers, _ = bounded_broadcast(names.join(best, same).filter(~wins).select(F.col("seq").alias("x_seq"), F.col("url").alias("x_url")).distinct())
    kept = pages.join(losers, F.col("seq").eqNullSafe(F.col("x_seq")) & F.col("url").eqNullSafe(F.col("x_url")), "left_anti")
    parsed = cut(parsed_pages(kept))
    links = link_targets(parsed, manifest, mode).groupBy(F.col("tool").alias("l_tool"), F.col("url").alias("l_url"), F.col("seq").alias("l_seq")).agg(F.map_from_entries(F.collect_list(F.struct("at", "link"))).alias("links"))
    done = parsed.join(links, (F.col("tool") == F.col("l_tool")) & (F.col("url") == F.col("l_url")) & (F.col("seq") == F.col("l_seq")), "left")
    body = F.when(F.col("links").isNull(), F.regexp_replace("body", f"{OPEN}[0-9]+{CLOSE}", "")).otherwise(filled(F.col("body"), F.col("links")))
    done = done.withColumn("body", body).drop("links", "l_tool", "l_url", "l_seq")
    if existing is not None:
        kept = existing.select(F.col("tool").alias("e_tool"), F.col("page_path").alias("e_path"), "description", "keywords")
        done = done.join(kept, (F.col("tool") == F.col("e_tool")) & (F.col("page_path") == F.col("e_path")), "left").drop("e_tool", "e_path")
    else:
        done = done.withColumn("description", F.lit(None).cast("string")).withColumn("keywords", F.lit(None).cast("array<string>"))
    out = done.select(
        "tool", "page_path", "url", F.lit(concept_type).alias("type"), "title", "description", F.col("url").alias("resource"), F.lit(run_ts).alias("timestamp"), "content_hash", "keywords", "nav_path", "body"
    )
    return out.withColumn("md", F.concat(frontmatter_text("type", "title", "description", "resource", "timestamp", "content_hash", "keywords", "nav_path"), F.lit("\n"), F.col("body"), F.lit("\n")))


def render_candidates(done: DataFrame, threshold: int = X.CONTENT_THRESHOLD) -> DataFrame:
    """Concepts with so little text that the page seems to need a browser."""
    return done.filter(X.below_threshold(F.col("body"), threshold))
