"""Lines repeated across the documents of one site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.lines import normal_line, site
from foliant.scale import bounded_broadcast, cut, one_row_per_id


def _long(line: Column, min_chars: int) -> Column:
    return F.length(F.regexp_replace(line, r"(?U)^\s+|\s+$", "")) >= min_chars


def _word(line: Column) -> Column:
    return F.xxhash64(normal_line(line))


def frequent_lines(df: DataFrame, id_col: str, text: str, url: str, min_chars: int = 24, min_docs: int = 5, min_share: float = 0.05) -> DataFrame:
    """``(site, line)``, line as a 64-bit hash of its normal form, of the lines that return on a site.

    A line returns if at least ``min_docs`` documents of the site and at least ``min_share`` of all its documents,
    empty and null ones included, have it. Each document sends a line once, so counts are sums that Spark combines
    before the shuffle and a site with a third of all rows makes no large group.
    """
    docs = one_row_per_id(df.select(id_col, text, url), id_col).select(site(F.col(url)).alias("site"), F.col(text).alias("text")).filter("site is not null")
    sizes, _ = bounded_broadcast(docs.groupBy("site").agg(F.count(F.lit(1)).alias("docs")))
    lines = F.transform(F.filter(F.split("text", "\n", -1), lambda x: _long(x, min_chars)), _word)
    counts = docs.select("site", F.explode(F.array_distinct(lines)).alias("line")).groupBy("site", "line").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.filter(F.col("n") >= min_docs)  # before the join: most lines are met once
    return counts.join(sizes, "site").filter(F.col("n") >= F.ceil(F.col("docs") * min_share - 1e-9)).select("site", "line")


def _with_frequent(df: DataFrame, id_col: str, text: str, url: str, max_broadcast_lines: int, **limits) -> DataFrame:
    """``df`` with ``_frequent``, the hashes of the lines that return on a row's site; null where there are none.

    A site has at most (lines a document) / min_share of them, whatever its size. All of them are broadcast if they
    are at most ``max_broadcast_lines`` (8 bytes each); beyond that sites meet in an ordinary join, where adaptive
    execution splits a site with a third of all rows.
    """
    found = cut(frequent_lines(df, id_col, text, url, **limits))
    by_site = found.groupBy(F.col("site").alias("_of")).agg(F.collect_set("line").alias("_frequent"))
    if found.count() <= max_broadcast_lines:
        by_site = F.broadcast(by_site)
    return df.withColumn("_site", site(F.col(url))).join(by_site, F.col("_site") == F.col("_of"), "left").drop("_of", "_site")


def repeated_lines(
    df: DataFrame, id_col: str = "concept_id", text: str = "content", url: str = "resource", min_chars: int = 24, min_docs: int = 5, min_share: float = 0.05, max_broadcast_lines: int = 1_000_000
) -> DataFrame:
    """``(id_col, line_no)`` of every line that returns on a large share of its site's documents.

    Lines lie between newlines and count from 1. Rows of one id count once. Null and empty texts have no such lines
    but count as documents of their site; a document without a host belongs to no site and has none. Repeated rows,
    ties and empty tables need no special case.
    """
    docs = _with_frequent(df.select(id_col, text, url), id_col, text, url, max_broadcast_lines, min_chars=min_chars, min_docs=min_docs, min_share=min_share)
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct((i + 1).alias("line_no"), _long(x, min_chars).alias("long"), x.alias("x")))
    hits = F.filter(lines, lambda p: p["long"] & F.array_contains(F.col("_frequent"), _word(p["x"])))
    return docs.filter(F.col("_frequent").isNotNull()).select(id_col, F.explode(F.transform(hits, lambda p: p["line_no"])).alias("line_no")).distinct()


def without_repeated_lines(
    df: DataFrame, id_col: str = "concept_id", text: str = "content", url: str = "resource", min_chars: int = 24, min_docs: int = 5, min_share: float = 0.05, max_broadcast_lines: int = 1_000_000
) -> DataFrame:
    """All rows and columns of ``df``, with the repeated lines taken out of ``text`` in place.

    A text that loses all its lines becomes empty; a null one stays null. Columns named ``_site``, ``_frequent`` or
    ``_of`` in ``df`` are not allowed and raise. Texts stay where they are read, as long as the lines can be broadcast.
    """
    if {"_site", "_frequent", "_of"} & set(df.columns):
        raise ValueError("columns _site, _frequent and _of are taken")
    docs = _with_frequent(df, id_col, text, url, max_broadcast_lines, min_chars=min_chars, min_docs=min_docs, min_share=min_share)
    keep = lambda x: ~(_long(x, min_chars) & F.array_contains(F.col("_frequent"), _word(x)))
    kept = F.concat_ws("\n", F.filter(F.split(text, "\n", -1), keep))
    clean = F.when(F.col("_frequent").isNull() | F.col(text).isNull(), F.col(text)).otherwise(kept)
    return docs.withColumn(text, clean).select(*df.columns)
