"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.scale import bounded_broadcast, bucket_count, cut

KINDS = np.array(["added", "changed", "removed"], dtype=object)
_DIFF_SCHEMA = "k1 long, k2 long, at_snapshot int, snapshot_no int, change_kind string"
_WORDS = {"bucket": "int", "k1": "long", "k2": "long", "e": "long", "snap": "int", "at": "long", "has": "boolean", "h1": "long", "h2": "long"}
#: The time of rows without a readable one.
_NEVER = -(1 << 63)
#: Parts of an entity where schedules are too many to be broadcast.
_SALTS = 32
_OUTER = r"(?U)^[\s/]+|[\s/]+$"


def clean_path(path: Column) -> Column:
    """A page path without outer slashes and blanks."""
    return F.regexp_replace(path, _OUTER, "")


def clean_hash(value: Column) -> Column:
    """A content hash in lower case without ``sha256:``; null for empty."""
    bare = F.regexp_replace(F.lower(F.trim(value)), "^sha256:", "")
    return F.when(bare != "", bare)


def _some(column: Column) -> Column:
    # xxhash64 passes over nulls, so (null, "a") and ("a", null) would agree
    return F.coalesce(column.cast("string"), F.lit("\u0000"))


def _compact(df: DataFrame, entity: str, snapshot: str, key: str, value_hash: str, order: str) -> DataFrame:
    page, digest = clean_path(F.col(key)), clean_hash(F.col(value_hash))
    return df.filter(F.col(snapshot).isNotNull()).select(
        F.col(entity).alias("entity"),
        F.col(snapshot).cast("int").alias("snap"),
        page.alias("page"),
        F.xxhash64(_some(F.col(entity)), _some(page)).alias("k1"),
        F.xxhash64(_some(page), F.lit(7), _some(F.col(entity))).alias("k2"),
        F.coalesce(F.expr(f"unix_micros(try_cast(`{order}` as timestamp))"), F.lit(_NEVER)).alias("at"),
        digest.isNotNull().alias("has"),
        F.xxhash64(digest).alias("h1"),
        F.xxhash64(F.lit(7), digest).alias("h2"),
    )


def _winners(col: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Of several rows of a key in a snapshot the last; ties go to the larger hash. In order of key and snapshot."""
    order = np.lexsort((col["h2"], col["h1"], col["has"], col["at"], col["snap"], col["k2"], col["k1"]))
    col = {n: a[order] for n, a in col.items()}
    last = np.ones(len(order), bool)
    last[:-1] = (col["k1"][1:] != col["k1"][:-1]) | (col["k2"][1:] != col["k2"][:-1]) | (col["snap"][1:] != col["snap"][:-1])
    return {n: a[last] for n, a in col.items()}


def _combined(batches: Iterator[pa.RecordBatch], most_rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A task's rows with one for each key and snapshot, in runs of ``most_rows``."""
    held, rows = [], 0

    def out() -> pa.RecordBatch:
        best = _winners({n: np.concatenate([h[n] for h in held]) for n in _WORDS})
        return pa.RecordBatch.from_arrays([pa.array(best[n]) for n in _WORDS], list(_WORDS))

    for batch in batches:
        held.append({n: batch.column(n).to_numpy(zero_copy_only=False) for n in _WORDS})
        rows += batch.num_rows
        if rows >= most_rows:
            yield out()
            held, rows = [], 0
    if rows:
        yield out()


def _differences(table: pa.Table) -> pa.Table:
    """Changes among one bucket's rows, given as flat arrays; every key of the bucket is whole in it."""
    col = _winners({n: table.column(n).to_numpy() for n in ("k1", "k2", "snap", "prev", "next", "at", "has", "h1", "h2")})
    n = len(col["k1"])
    starts = np.ones(n, bool)
    starts[1:] = (col["k1"][1:] != col["k1"][:-1]) | (col["k2"][1:] != col["k2"][:-1])
    key = np.cumsum(starts) - 1
    snaps = np.unique(col["snap"])
    width = len(snaps) + 1
    slot = key * width + np.searchsorted(snaps, col["snap"])  # ascending

    def find(other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank = np.minimum(np.searchsorted(snaps, other), len(snaps) - 1)
        wanted = np.where(snaps[rank] == other, key * width + rank, -1)
        at = np.minimum(np.searchsorted(slot, wanted), n - 1)
        return at, slot[at] == wanted

    before, had = find(col["prev"])
    _, stays = find(col["next"])
    moved = (col["has"] != col["has"][before]) | (col["h1"] != col["h1"][before]) | (col["h2"] != col["h2"][before])
    added = (col["prev"] >= 0) & ~had
    changed = (col["prev"] >= 0) & had & moved
    removed = (col["next"] >= 0) & ~stays
    rows = np.concatenate([np.flatnonzero(m) for m in (added, changed, removed)])
    kind = np.repeat([0, 1, 2], [added.sum(), changed.sum(), removed.sum()])
    return pa.table(
        {
            "k1": col["k1"][rows],
            "k2": col["k2"][rows],
            "at_snapshot": col["snap"][rows].astype(np.int32),
            "snapshot_no": np.where(kind == 2, col["next"][rows], col["snap"][rows]).astype(np.int32),
            "change_kind": pa.array(KINDS[kind], pa.string()),
        }
    )


def snapshot_changes(
    df: DataFrame,
    entity: str = "tool",
    snapshot: str = "snapshot_no",
    key: str = "page_path",
    value_hash: str = "content_hash",
    order: str = "fetched_at",
    rows_per_bucket: int = 250_000,
    max_broadcast_rows: int = 200_000,
    max_broadcast_changes: int = 1_000_000,
) -> DataFrame:
    """Records ``added``, ``removed`` or ``changed`` in each snapshot against the entity's previous one.

    Snapshots are non-negative integers; an entity's previous snapshot is the greatest lower number that it has any
    row of, and its first one gives no rows. Each row shrinks to two 64-bit words for its key and two for its hash.
    Repeated rows of a key in a snapshot are combined in each task, so a key that holds a third of the table costs a
    row a task and snapshot; then keys are spread over hash buckets of about ``rows_per_bucket`` rows, the one exchange
    of the search, which hold all snapshots of a key, and numpy takes the set differences by sorted search. Names are
    read again for the differing keys and their snapshots alone.

    Defined cases: of several rows for one key in a snapshot the last by ``order`` wins, one without a (readable)
    time only if no other has one, and ties go to the larger row hash; null and empty hashes are one value unlike any
    hash; null entities and keys are values of their own; rows without a snapshot belong to none and are left out;
    other columns, whatever their names, play no part; an empty table gives no rows.
    """
    rows = _compact(df, entity, snapshot, key, value_hash, order)
    seen = rows.select("entity", "snap").distinct()
    line = Window.partitionBy("entity").orderBy("snap")
    schedule = seen.select(
        F.xxhash64(_some(F.col("entity"))).alias("entity_word"),
        F.col("snap").alias("s"),
        F.coalesce(F.lag("snap").over(line), F.lit(-1)).alias("prev"),
        F.coalesce(F.lead("snap").over(line), F.lit(-1)).alias("next"),
    )
    schedule, small = bounded_broadcast(schedule, max_broadcast_rows)
    buckets = bucket_count(df.count(), rows_per_bucket)
    words = rows.select(F.pmod("k1", F.lit(buckets)).cast("int").alias("bucket"), "k1", "k2", F.xxhash64(_some(F.col("entity"))).alias("e"), "snap", "at", "has", "h1", "h2")
    words = words.mapInArrow(_combined, ", ".join(f"{n} {t}" for n, t in _WORDS.items()))
    on = (F.col("e") == F.col("entity_word")) & (F.col("snap") == F.col("s"))
    if not small:  # an ordinary join, in which a large entity is _SALTS keys
        words = words.withColumn("salt", F.pmod("k2", F.lit(_SALTS).cast("long")))
        schedule = schedule.withColumn("of", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))))
        on = on & (F.col("salt") == F.col("of"))
    rows_of_keys = words.join(schedule, on).select("bucket", "k1", "k2", "snap", "prev", "next", "at", "has", "h1", "h2")
    changes = cut(rows_of_keys.groupBy("bucket").applyInArrow(_differences, _DIFF_SCHEMA).withColumnRenamed("k1", "c1").withColumnRenamed("k2", "c2"))
    few = changes.count() <= max_broadcast_changes
    found = rows.select("entity", "page", "k1", "k2", "snap").join(F.broadcast(changes) if few else changes, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("snap") == F.col("at_snapshot")))
    # a key may have several rows in a snapshot, and be both changed in it and removed after it
    found = found.groupBy("k1", "k2", "snap", "snapshot_no", "change_kind").agg(F.first("entity").alias("entity"), F.first("page").alias("page"))
    return found.select(F.col("entity").alias(entity), F.col("snapshot_no").alias(snapshot), F.col("page").alias(key), "change_kind")
