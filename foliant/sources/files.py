"""Bundles, caches and manifests as files on a file system that the driver and all executors mount (state on object
stores goes through Parquet: write_bundles)."""

from __future__ import annotations

import json
import os
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.text import unsafe_path

ENTRY = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in ("page_path", "cache_path", "fetched_at", "etag", "last_modified", "content_hash")),
        T.StructField("nav_path", T.ArrayType(T.StringType())),
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def bundle_dir(tool: str, base: str = ".") -> str:
    return os.path.join(base, "docs", "tools", tool)


def cache_dir(tool: str, base: str = ".") -> str:
    return os.path.join(base, ".cache", "tools", tool)


def manifest_path(tool: str, base: str = ".") -> str:
    return os.path.join(cache_dir(tool, base), "manifest.json")


def read_tree(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """``(path, text)``: the files below a folder, path relative to it; in order of path parts when sorted by
    ``split(path, '/')``."""
    root = os.path.abspath(folder)
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    where = F.regexp_replace(F.expr("url_decode(_metadata.file_path)"), "^file:/*", "/")
    return rows.select(F.substring(where, len(root) + 2, 1 << 30).alias("path"), F.col("value").alias("text"))


def manifest_rows(json_files: DataFrame) -> DataFrame:
    """``(tool, url, seq, ...)`` of manifests (tool, json), in the order of their keys; bad JSON gives no rows."""
    parsed = F.from_json("json", T.MapType(T.StringType(), ENTRY))
    rows = json_files.select("tool", F.posexplode(parsed).alias("seq", "url", "e"))
    return rows.select("tool", "url", F.col("seq").cast("long").alias("seq"), "e.*")


def read_manifest(spark: SparkSession, tool: str, base: str = ".") -> DataFrame:
    """A tool's manifest; no rows if it has none."""
    path = manifest_path(tool, base)
    if not os.path.exists(path):
        return manifest_rows(spark.createDataFrame([], "tool string, json string"))
    return manifest_rows(spark.read.text(path, wholetext=True).select(F.lit(tool).alias("tool"), F.col("value").alias("json")))


def manifest_json(manifest: DataFrame) -> DataFrame:
    """``(tool, json)``: each tool's manifest as one JSON object in the order of seq; error rows have three keys."""
    ok = F.struct("page_path", "cache_path", "fetched_at", "etag", "last_modified", "content_hash", "nav_path")
    bad = F.struct("page_path", "status", "error")
    keep = {"ignoreNullFields": "false"}
    value = F.when(F.col("status") == "errored", F.to_json(bad, keep)).otherwise(F.to_json(ok, keep))
    pair = F.concat(F.to_json(F.array("url")).substr(F.lit(2), F.length(F.to_json(F.array("url"))) - 2), F.lit(": "), value)
    rows = manifest.groupBy("tool").agg(F.sort_array(F.collect_list(F.struct("seq", pair.alias("p")))).alias("l"))
    return rows.select("tool", F.concat(F.lit("{"), F.array_join(F.transform("l", lambda x: x["p"]), ", "), F.lit("}")).alias("json"))


def write_manifests(manifest: DataFrame, base: str = ".") -> None:
    """One pretty-printed file a tool, written by the executors under another name and then put in place."""

    def put(rows) -> None:
        for r in rows:
            place(Path(manifest_path(r.tool, base)), json.dumps(json.loads(r.json), indent=2, ensure_ascii=False))

    manifest_json(manifest).foreachPartition(put)


def place(path: str | Path, text: str) -> None:
    """Write a file under another name, then put it in place."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.{os.getpid()}.part")
    part.write_text(text, encoding="utf-8")
    os.replace(part, path)  # a task that runs again puts the same file in place


def export_files(files: DataFrame, base: str = ".") -> None:
    """Write files (tool, path, text) below each tool's bundle; paths with ``..`` are refused before any is written."""
    if files.filter(unsafe_path(F.col("path"))).limit(1).count():
        raise ValueError("a path leaves its bundle")

    def put(rows) -> None:
        for r in rows:
            place(Path(bundle_dir(r.tool, base)) / r.path, r.text or "")

    files.select("tool", "path", "text").foreachPartition(put)


def export_raw(pages: DataFrame, base: str = ".") -> None:
    """Write raw pages (tool, page_path, html) to the cache."""

    def put(rows) -> None:
        for r in rows:
            place(Path(cache_dir(r.tool, base)) / "raw" / f"{r.page_path}.html", r.html or "")

    if pages.filter(unsafe_path(F.col("page_path"))).limit(1).count():
        raise ValueError("a path leaves its cache")
    pages.select("tool", "page_path", "html").foreachPartition(put)


def read_raw(spark: SparkSession, tool: str, base: str = ".") -> DataFrame:
    """``(tool, page_path, html)`` of a tool's cached pages."""
    folder = os.path.join(cache_dir(tool, base), "raw")
    if not os.path.isdir(folder):
        return spark.createDataFrame([], "tool string, page_path string, html string")
    rows = read_tree(spark, folder, "*.html")
    return rows.select(F.lit(tool).alias("tool"), F.regexp_replace("path", r"\.html$", "").alias("page_path"), F.col("text").alias("html"))


def wipe(tool: str, base: str = ".") -> None:
    """Remove one tool's cache and bundle; no error if there are none."""
    if not tool or tool in (".", "..") or "/" in tool:
        raise ValueError(f"no tool name: {tool!r}")
    for folder in (cache_dir(tool, base), bundle_dir(tool, base)):
        shutil.rmtree(folder, ignore_errors=True)


def write_bundles(concepts: DataFrame, folder: str) -> None:
    """Concepts as Parquet, a partition for each tool; only the tools at hand are overwritten."""
    concepts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tool").parquet(folder)
