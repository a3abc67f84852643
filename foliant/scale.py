"""Helpers that keep plans safe at any size: bounded broadcasts, lineage cuts, row dedup."""

from __future__ import annotations

import math
import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast once they have been counted.
MAX_BROADCAST_ROWS = 200_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; a local one only where none is set and all runs on one machine.

    What a lineage was cut with is removed once nothing refers to it any more.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "foliant-checkpoints"))
        sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names of what lies in a folder, sorted; none if it isn't there."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = there.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in system.listStatus(there)) if system.exists(there) else []


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that lost executors cost no recomputation of what led to it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """``df`` materialised, and hinted for broadcast only if its counted rows are at most ``max_rows``.

    The second value says whether the bound held; callers have another way for when it didn't.
    """
    small = cut(df)
    if small.count() <= max_rows:
        return F.broadcast(small), True
    return small, False


def one_row_per_id(df: DataFrame, id_col: str, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Drop repeated rows of one id without shuffling the wide columns of the rows that are single.

    Ids are counted alone (8 bytes a row, combined before the shuffle); only rows of repeated ids are shuffled whole.
    Rows whose id is null can't be told apart by it and are all kept. Of rows that share an id the first one met
    stays, so columns should agree among them.
    """
    repeated = (
        df.groupBy(F.col(id_col).alias("_rid")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1 and _rid is not null").select("_rid")
    )
    repeated, small = bounded_broadcast(repeated, max_rows)
    if small:
        single = df.join(repeated, F.col(id_col) == F.col("_rid"), "left_anti")
        again = df.join(repeated, F.col(id_col) == F.col("_rid"), "left_semi").dropDuplicates([id_col])
        return single.unionByName(again)
    return df.filter(F.col(id_col).isNull()).unionByName(df.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col]))


def bucket_count(rows: int, rows_per_bucket: int) -> int:
    """Buckets that keep each near ``rows_per_bucket`` rows."""
    return max(1, math.ceil(rows / rows_per_bucket))


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once a context, so that they need no copy of the repository."""
    sc = spark.sparkContext
    if getattr(sc, "_foliant_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="foliant-")) / "foliant_modules.zip"  # the driver serves it from here
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._foliant_shipped = True
