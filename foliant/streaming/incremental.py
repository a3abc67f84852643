"""Raw pages as a stream: each micro-batch is merged into the concepts and the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.crawl import crawl_status
from foliant.plans.pages import concepts, pages_table
from foliant.scale import children, cut

PAGES = "seq long, url string, html string, http_status int, error string"
STATE = "tool string, url string, page_path string, content_hash string"
#: After so many batches the whole state is written, so that reading it needs no more than these.
FULL_EVERY = 20


def _batches(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(name[6:]) for name in children(spark, folder) if name.startswith("batch="))


def _latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows of each key the one of the last batch."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("w")).select(*keys, *(f"w.{c}" for c in rest if c != "batch"))


def read_state(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """``STATE`` after all batches, or those before a number: the last full state and what came since."""
    here = lambda n: before is None or n < before
    full = [n for n in _batches(spark, f"{folder}/full") if here(n)][-1:]
    parts = [n for n in _batches(spark, f"{folder}/manifest") if here(n) and n > (full[0] if full else -1)]
    paths = [(n, f"{folder}/full/batch={n}") for n in full] + [(n, f"{folder}/manifest/batch={n}") for n in parts]
    out = spark.createDataFrame([], f"{STATE}, batch long")
    for n, path in paths:
        out = out.unionByName(spark.read.schema(STATE).parquet(path).withColumn("batch", F.lit(n).cast("long")))
    return _latest(out, ["tool", "url"])


def read_concepts(spark: SparkSession, folder: str) -> DataFrame:
    """The concepts as they are after all batches: of each page path the last one written."""
    rows = spark.read.parquet(f"{folder}/concepts")
    return _latest(rows, ["tool", "page_path"])


def merge_batch(batch: DataFrame, number: int, folder: str, run_ts: str) -> None:
    """Convert a batch's new and changed pages against the state before it, and write both results under its number.

    A batch that runs again after a loss sees the same state and replaces its own folders, so nothing comes twice.
    """
    spark = batch.sparkSession
    prior = cut(read_state(spark, folder, number))
    pages = pages_table(batch).join(batch.select("seq", "url", "http_status", "error").distinct(), ["seq", "url"])
    fresh = cut(crawl_status(pages, prior).filter(F.col("status").isin("fetched", "updated")).drop("status", "http_status", "error"))
    known = prior.select("tool", "url", "page_path").unionByName(fresh.select("tool", "url", "page_path")).distinct()
    concepts(fresh, known, run_ts).write.mode("overwrite").parquet(f"{folder}/concepts/batch={number}")
    new = fresh.groupBy("tool", "url").agg(F.max_by(F.struct("page_path", "content_hash"), "seq").alias("w")).select("tool", "url", "w.page_path", "w.content_hash")
    new.write.mode("overwrite").parquet(f"{folder}/manifest/batch={number}")
    if number and number % FULL_EVERY == 0:
        read_state(spark, folder, number + 1).write.mode("overwrite").parquet(f"{folder}/full/batch={number}")


def start(spark: SparkSession, source: str, folder: str, checkpoint: str, run_ts: str, available_now: bool = True):
    """Follow Parquet files of raw pages arriving in ``source``."""
    stream = spark.readStream.schema(PAGES).parquet(source)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: merge_batch(batch, n, folder, f"{run_ts}#{n:08d}"))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
