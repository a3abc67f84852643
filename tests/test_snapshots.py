import random

import pyarrow as pa
from pyspark.sql import functions as F

from foliant import scale
from foliant.operators import snapshots as S

COLUMNS = "tool string, snapshot_no int, page_path string, fetched_at string, content_hash string, snap string, k1 long"


def brute(rows):
    from datetime import datetime

    best, seen = {}, {}
    for tool, snap, path, at, digest, *_ in rows:
        if snap is None:
            continue
        path = path.strip(" /\t\n") if path is not None else None
        digest = (digest or "").strip().lower().removeprefix("sha256:") or None
        try:
            key = (1, datetime.fromisoformat(at).timestamp())
        except (TypeError, ValueError):
            key = (0, 0)
        seen.setdefault(tool, set()).add(snap)
        own = best.setdefault((tool, snap), {})
        if path not in own or key > own[path][0]:
            own[path] = (key, digest)
    out = set()
    for tool, snaps in seen.items():
        order = sorted(snaps)
        for a, b in zip(order, order[1:], strict=False):
            old, new = best[tool, a], best[tool, b]
            out |= {(tool, b, p, "added") for p in new.keys() - old.keys()} | {(tool, b, p, "removed") for p in old.keys() - new.keys()}
            out |= {(tool, b, p, "changed") for p in new.keys() & old.keys() if new[p][1] != old[p][1]}
    return out


def test_changes_are_those_of_brute_force(spark):
    r, rows, minute = random.Random(2), [], 0
    for snap in range(1, 7):
        for tool in ("a", "b", None):
            if r.random() < 0.2:
                continue
            for p in range(40):
                if r.random() < 0.8:
                    for _ in range(r.choice([1, 1, 1, 2])):
                        minute += 1
                        path = r.choice(["p/{}", "/p/{}/", " p/{} "]).format(p) if p else None
                        at = f"2025-01-{1 + minute // 1440:02d}T{minute // 60 % 24:02d}:{minute % 60:02d}:00{r.choice(['+00:00', '+02:00'])}"
                        rows.append((tool, snap, path, at, r.choice(["h1", "H1", "sha256:h1", "h2", "", None]), "x", 1))
    rows += rows[:50] + [("a", None, "p", None, "h", "x", 1), ("a", 3, "lone", None, "h", "x", 1), ("a", 3, "bad", "no time", "h", "x", 1)]
    d = spark.createDataFrame(rows, COLUMNS)
    want = brute(rows)
    assert len(want) > 100
    for size in (250_000, 20):
        got = S.snapshot_changes(d, rows_per_bucket=size).collect()
        assert len(got) == len(want) and {tuple(x) for x in got} == want
    assert {tuple(x) for x in S.snapshot_changes(d, max_broadcast_rows=0, max_broadcast_changes=0).collect()} == want


def test_a_hot_key_leaves_a_row_a_task(spark):
    rows = [("a", 1 + k % 2, "hot", f"2025-01-01T00:00:{k % 60:02d}Z", f"h{k}", "x", 1) for k in range(3_000)] + [("a", 2, "new", None, "h", "x", 1)]
    d = spark.createDataFrame(rows, COLUMNS).repartition(3)
    assert sorted(tuple(x) for x in S.snapshot_changes(d).collect()) == [("a", 2, "hot", "changed"), ("a", 2, "new", "added")]
    columns = {"bucket": 0, "k1": 1, "k2": 2, "e": 3, "at": 4, "has": True, "h1": 5, "h2": 6}
    batch = pa.RecordBatch.from_pydict({n: [columns.get(n, k % 2) for k in range(900)] for n in S._WORDS})
    assert [b.num_rows for b in S._combined(iter([batch] * 4), most_rows=1_800)] == [2, 2]


def test_one_snapshot_and_none(spark):
    d = spark.createDataFrame([("a", 1, "p", None, "h", "x", 1)], COLUMNS)
    assert S.snapshot_changes(d).count() == 0 and S.snapshot_changes(d.limit(0)).count() == 0


def test_one_row_per_id(spark):
    d = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (None, "n"), (None, "n")], "id long, x string")
    want = sorted(map(str, [(1, "a"), (2, None), (None, "n"), (None, "n")]))
    for most in (200_000, 0):
        assert sorted(str(tuple(r)) for r in scale.one_row_per_id(d, "id", most).collect()) == want
    small, ok = scale.bounded_broadcast(d.select("id").filter(F.col("id") > 0), 2)
    assert not ok and small.count() == 3
