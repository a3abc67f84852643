"""Near-duplicate records: size-banded tiles, hashed bitmap signatures, exact intersection of sorted arrays."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.lines import slices, words_of
from foliant.scale import cut

#: Counters of the frequency sketch for each record, the least and most of them (powers of two), and how many go in one row.
COUNTERS_EACH, LEAST_COUNTERS, MOST_COUNTERS, CHUNK = 64, 1 << 20, 1 << 25, 1 << 17
#: Rows of a sketch that are added at once; more go through a tree.
FAN_IN = 64
#: 64-bit words of the smallest signature, how often it may double, and bits for each element it stands for.
LEVELS, BITS_EACH = 10, 1.5
#: The signatures that go to the tiles stand for one element in so many, by its hash.
SAMPLE = 3
#: Rows of pairs that a tile looks at in one step.
STEP = 1 << 20
#: Ids that may be broadcast once counted: 8 bytes each.
MAX_IDS = 2_000_000


def shingle_sets(texts: list[list[str]], n: int, known: dict[str, int]) -> list[np.ndarray]:
    """For each list of words the set of all runs of ``n`` of them, as ascending 64-bit hashes."""
    if len(known) > 500_000:
        known.clear()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    words = [w for t in texts for w in t]
    for w in set(words) - known.keys():
        known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    m = max(0, len(words) - n + 1)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = (out ^ h[k : m + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    ends = np.cumsum(sizes)
    return [np.unique(out[e - c : e - n + 1]) if c >= n else out[:0] for e, c in zip(ends.tolist(), sizes.tolist(), strict=True)]


def shingles(words: list[str], n: int, known: dict[str, int]) -> np.ndarray:
    return shingle_sets([words], n, known)[0]


def overlap_needed(a: np.ndarray | int, b: np.ndarray | int, threshold: float) -> np.ndarray:
    """The least number of common elements of sets of sizes a and b at Jaccard ``threshold``."""
    return np.ceil(threshold / (1 + threshold) * (np.asarray(a) + b) - 1e-9).astype(np.int64)


def prefix_length(size: int, threshold: float) -> int:
    """How many of a set's rarest elements must hold one that any similar set shares, in its own such part."""
    return size - math.ceil(threshold * size - 1e-9) + 1


def level_of(elements: np.ndarray | int) -> np.ndarray:
    """Signatures have 2^level words of 64 bits: enough bits for the elements they stand for."""
    need = np.maximum(1.0, np.asarray(elements) * BITS_EACH / 64)
    return np.minimum(np.ceil(np.log2(need)).astype(np.int64), LEVELS - 1)


def sampled(elements: np.ndarray) -> np.ndarray:
    """Which elements the tiles' signatures stand for."""
    return (elements >> np.uint64(40)) % np.uint64(SAMPLE) == 0


def signature(elements: np.ndarray, level: int) -> np.ndarray:
    """A set's bitmap of 2^level words: one bit for each element's hash."""
    bits = 64 << level
    flags = np.zeros(bits, bool)
    flags[((elements >> np.uint64(11)) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags).view(np.uint64)


class Signatures:
    """Bitmaps of many records. A larger one is folded in halves to stand beside a smaller one."""

    def __init__(self, level: np.ndarray, flat: np.ndarray) -> None:
        self.level = level
        start = np.concatenate([[0], np.cumsum(1 << level)[:-1]]) if len(level) else level
        self.rows, self.at = [], []
        above = None
        for k in range(LEVELS - 1, -1, -1):
            width = 1 << k
            own = np.flatnonzero(level >= k)
            at = np.full(len(level), -1, np.int32)
            at[own] = np.arange(len(own), dtype=np.int32)
            rows = np.zeros((len(own), width), np.uint64)
            exact = own[level[own] == k]
            rows[at[exact]] = flat[start[exact][:, None] + np.arange(width)]
            if above is not None:
                higher = np.flatnonzero(level > k)
                rows[at[higher]] = above[:, :width] | above[:, width:]
            above = rows
            self.rows.insert(0, rows), self.at.insert(0, at)

    def missing(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits of a's signature that b's lacks, and the reverse: each is at least one element that the other has not."""
        level = np.minimum(self.level[a], self.level[b])
        out = np.zeros((2, len(a)), np.int64)
        for k in np.unique(level):
            own = np.flatnonzero(level == k)
            for c in range(0, len(own), 1 << 16):
                i = own[c : c + (1 << 16)]
                x, y = self.rows[k][self.at[k][a[i]]], self.rows[k][self.at[k][b[i]]]
                both = np.bitwise_count(x & y).sum(axis=1, dtype=np.int64)
                out[0, i] = np.bitwise_count(x).sum(axis=1, dtype=np.int64) - both
                out[1, i] = np.bitwise_count(y).sum(axis=1, dtype=np.int64) - both
        return out[0], out[1]


def coded(counts: np.ndarray) -> np.ndarray:
    """Counts in a byte each: exact under 128, then four steps an octave; in the same order."""
    high = 128 + np.floor(4 * np.log2(np.maximum(counts, 128) / 128))
    return np.where(counts < 128, counts, np.minimum(high, 255)).astype(np.uint8)


#: The least count behind each code.
COUNT_OF = np.array([*range(128), *(math.ceil(128 * 2 ** (k / 4)) for k in range(128))], np.int64)


def tile_pairs(token: np.ndarray, place: np.ndarray, outside: np.ndarray, side: np.ndarray, doc: np.ndarray, size: np.ndarray, bits: Signatures, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of records of a tile that may reach ``threshold``, as places in ``size``.

    Rows are (token, place of the token in its record's order, how many of the tokens before it the signatures don't
    stand for, side, record); size and bits are the records'. Within a token rows are in order of size, so a row's
    partners are the next ones until the size band ends. At the first token that a pair shares, all tokens before it
    are missing in the other record: those outside the sample are counted, those of the sample show in the bit counts,
    and both together bound the overlap from above. ``side`` is 0 for ordinary tokens; in a tile of a split token rows
    of sides 1 and 2 pair only across.
    """
    order = np.lexsort((size[doc], token))
    token, place, outside, side, doc = token[order], place[order], outside[order], side[order], doc[order]
    own = size[doc]
    n = len(token)
    last = np.searchsorted(token, token, side="right")  # first row of the next token
    left, found = np.arange(n), []
    step = 1
    while len(left):
        left = left[left + step < last[left]]
        if len(left):  # beyond the size band no later partner can fit
            left = left[own[left] >= threshold * own[left + step] - 1e-9]
        for k in range(0, len(left), STEP):
            i = left[k : k + STEP]
            j = i + step
            need = overlap_needed(own[i], own[j], threshold)
            ok = np.minimum(own[i] - place[i], own[j] - place[j]) >= need
            ok &= (side[i] == 0) | (side[i] != side[j])
            i, j, need = i[ok], j[ok], need[ok]
            if len(i):
                a, b = doc[i], doc[j]
                lost_a, lost_b = bits.missing(a, b)
                ok = (own[i] - outside[i] - lost_a >= need) & (own[j] - outside[j] - lost_b >= need)
                a, b = a[ok], b[ok]
                found.append(np.unique(np.minimum(a, b) * len(size) + np.maximum(a, b)))
        step += 1
    keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return (keys // len(size), keys % len(size)) if len(keys) else (keys, keys)


def _texts(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    if df.schema[id_col].dataType not in (T.LongType(), T.IntegerType()):
        raise TypeError("ids must be whole numbers")
    text: Column = F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    docs = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    low = F.lower("text")
    return docs.withColumn("h1", F.xxhash64(low)).withColumn("h2", F.xxhash64(F.lit(7), low))


def _representatives(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """``(id, text)`` of one row for each text, ``(id, rep, copies)`` of the records whose text others have too, and
    how many records there are. Ids and hashes are shuffled, no texts."""
    chosen = docs.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("h"), F.max(F.struct("h1", "h2")).alias("other"))
    chosen = cut(chosen.select("id", "h.h1", "h.h2", (F.col("h") != F.col("other")).alias("several")))
    groups = chosen.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    copies = cut(chosen.join(groups, ["h1", "h2"]).select("id", "rep", "copies"))
    special = copies.filter("id <> rep").select("id", F.lit(None).cast("long").alias("k1"), F.lit(None).cast("long").alias("k2"))
    special = special.unionByName(chosen.filter("several").join(copies.filter("id <> rep"), "id", "left_anti").select("id", F.col("h1").alias("k1"), F.col("h2").alias("k2")))
    special = cut(special.withColumn("marked", F.lit(True)))
    marked = docs.join(F.broadcast(special) if special.count() <= MAX_IDS // 4 else special, "id", "left")
    return marked.filter("marked is null or (h1 = k1 and h2 = k2)").select("id", "text"), copies, chosen.count()


def _summaries(reps: DataFrame, n: int, min_words: int, counters: int) -> DataFrame:
    """Of each task its part of the sketch (part, lane, counts), and of each record with words enough (id, size, bits)
    with the signature of its whole set. Written once; both are read from there."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = np.zeros(counters, np.int32), {}
        names = ["part", "lane", "counts", "id", "size", "bits"]
        for batch in batches:
            for part in slices(batch, "text", 1 << 22):
                split = [words_of(t) for t in part.column(1).to_pylist()]
                long = [k for k, w in enumerate(split) if len(w) >= max(min_words, n)]
                if not long:
                    continue
                sets = shingle_sets([split[k] for k in long], n, known)
                at, n_at = np.unique((np.concatenate(sets) & np.uint64(counters - 1)).astype(np.int64), return_counts=True)
                total[at] += n_at.astype(np.int32)
                bits = [signature(x, int(level_of(len(x)))).tobytes() for x in sets]
                none = pa.nulls(len(long), pa.int32())
                yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(long), pa.binary()), part.column(0).take(pa.array(long)), pa.array([len(x) for x in sets], pa.int32()), pa.array(bits, pa.binary())], names)
        parts = coded(total).reshape(-1, min(CHUNK, counters))
        rows = np.flatnonzero(parts.any(axis=1))
        lane = TaskContext.get().partitionId()
        counts = pa.array([pa.compress(parts[k].tobytes(), "zstd", asbytes=True) for k in rows], pa.binary())
        none = pa.nulls(len(rows), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([lane] * len(rows), pa.int32()), counts, pa.nulls(len(rows), pa.int64()), none, pa.nulls(len(rows), pa.binary())], names)

    return cut(reps.mapInArrow(summarise, "part int, lane int, counts binary, id long, size int, bits binary"))


def _sketch(parts: DataFrame, counters: int) -> np.ndarray:
    """How many records' sets fall on each counter, as codes; (part, lane, counts) are added in a tree of FAN_IN."""
    width = min(CHUNK, counters)

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for x in table.column("counts"):
            total += COUNT_OF[np.frombuffer(pa.decompress(x.as_py(), width, "zstd"), np.uint8)]
        return pa.table({"part": table.column("part")[:1], "lane": table.column("lane")[:1], "counts": pa.array([pa.compress(coded(total).tobytes(), "zstd", asbytes=True)], pa.binary())})

    lanes = (parts.agg(F.max("lane")).first()[0] or 0) + 1
    while lanes > 1:
        parts = parts.withColumn("lane", (F.col("lane") / FAN_IN).cast("int")).groupBy("part", "lane").applyInArrow(add, "part int, lane int, counts binary")
        lanes = -(-lanes // FAN_IN)
    out = np.zeros((counters // width, width), np.uint8)
    for r in parts.collect():
        out[r.part] = np.frombuffer(pa.decompress(r.counts, width, "zstd"), np.uint8)
    return out.reshape(-1)


#: The arrays of a tile's row, in their order: those of its tokens, then those of its records.
_TILE = {"token": np.uint32, "place": np.uint16, "outside": np.uint16, "doc": np.uint16, "id": np.int64, "size": np.uint32, "level": np.uint8, "bits": np.uint64}
#: Places are cut off here (a lower place leaves more room, so nothing is lost); two bits below it hold the side.
_MOST_PLACE = (1 << 14) - 1


def _emit(ids: list[int], texts: list[str], sketch: np.ndarray, floor: int, n: int, min_words: int, threshold: float, buckets: int, split: int, known: dict[str, int]) -> pa.RecordBatch | None:
    """One row for each bucket: the rare tokens that a slice's records send there, and those records' signatures."""
    token, place, outside, doc, kept, sizes, bits, levels = [], [], [], [], [], [], [], []
    split_texts = [words_of(t) for t in texts]
    long = [k for k, w in enumerate(split_texts) if len(w) >= max(min_words, n)]
    mask = np.uint64(len(sketch) - 1)
    for key, own in zip([ids[k] for k in long], shingle_sets([split_texts[k] for k in long], n, known), strict=True):
        seen = sketch[(own & mask).astype(np.int64)]
        inside = sampled(own)
        first = np.lexsort((own, seen))[: prefix_length(len(own), threshold)]
        at = np.flatnonzero(seen[first] > 1)  # a token counted once has no partner
        before = np.cumsum(~inside[first]) - ~inside[first]
        token.append(own[first[at]]), place.append(at), outside.append(before[at]), doc.append(np.full(len(at), len(kept)))
        part = own[inside]
        level = int(level_of(len(own) / SAMPLE))
        kept.append(key), sizes.append(len(own)), levels.append(level), bits.append(signature(part, level))
    if not kept:
        return None
    token, place, outside, doc = np.concatenate(token), np.concatenate(place), np.concatenate(outside), np.concatenate(doc)
    side = np.zeros(len(token), np.int64)
    seen = COUNT_OF[sketch[(token & mask).astype(np.int64)]] - floor
    if (seen > split).any():  # spread a common token over a grid of tiles
        hot = np.flatnonzero(seen > split)
        rows = [np.flatnonzero(seen <= split)]
        tokens, sides = [token[rows[0]]], [side[rows[0]]]
        spread = np.array([xxhash.xxh3_64_intdigest(str(k)) >> 1 for k in kept], np.int64)
        grid = -(-seen[hot] // split)
        mine = spread[doc[hot]] % grid
        for h in range(int(grid.max())):
            on = np.flatnonzero(grid > h)
            a, b = np.minimum(mine[on], h), np.maximum(mine[on], h)
            tile = (a * 65536 + b + 1).astype(np.uint64)
            rows.append(hot[on])
            tokens.append((token[hot[on]] ^ tile) * np.uint64(0xC2B2AE3D27D4EB4F))
            sides.append(np.where(a == b, 0, np.where(mine[on] == a, 1, 2)))
        rows = np.concatenate(rows)
        token, side, place, outside, doc = np.concatenate(tokens), np.concatenate(sides), place[rows], outside[rows], doc[rows]
    token = token * np.uint64(0x9E3779B97F4A7C15)
    to = ((token >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    place = (np.minimum(place, _MOST_PLACE) << 2 | side).astype(np.uint16)
    outside = np.minimum(outside, 65535).astype(np.uint16)
    name = (token >> np.uint64(32)).astype(np.uint32)  # tokens of a bucket that agree here only make candidates
    ids_, sizes_, levels_ = np.array(kept, np.int64), np.array(sizes, np.uint32), np.array(levels, np.uint8)
    to = to[order]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1]) if len(to) else np.zeros(0, np.int64)
    bucket, data = [], []
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(to)], strict=False):
        rows = order[start:end]
        docs, local = np.unique(doc[rows], return_inverse=True)
        values = (name[rows], place[rows], outside[rows], local.astype(np.uint16), ids_[docs], sizes_[docs], levels_[docs], np.concatenate([bits[k] for k in docs.tolist()]))
        bucket.append(int(to[start]))
        data.append(struct.pack("<II", len(rows), len(docs)) + b"".join(v.tobytes() for v in values))
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(data, pa.binary())], ["bucket", "data"])


def _bucket_pairs(table: pa.Table, threshold: float) -> pa.Table:
    parts: dict[str, list[np.ndarray]] = {k: [] for k in _TILE}
    known = 0
    for value in table.column("data"):
        data = value.as_buffer()
        rows, docs = struct.unpack_from("<II", data)
        at = 8
        for k, kind in _TILE.items():
            count = rows if k in ("token", "place", "outside", "doc") else docs if k != "bits" else (len(data) - at) // 8
            x = np.frombuffer(data, kind, count, at)
            at += x.nbytes
            parts[k].append(x.astype(np.int64) + known if k == "doc" else x)
        known += docs
    x = {k: np.concatenate(v) for k, v in parts.items()}
    size = x["size"].astype(np.int64)
    a, b = tile_pairs(x["token"], (x["place"] >> 2).astype(np.int64), x["outside"].astype(np.int64), x["place"] & 3, x["doc"], size, Signatures(x["level"].astype(np.int64), x["bits"]), threshold)
    a, b = x["id"][a], x["id"][b]
    ok = a != b  # repeated rows of one id
    return pa.table({"a": np.minimum(a, b)[ok], "b": np.maximum(a, b)[ok]})


def _bounded(batch: pa.RecordBatch, threshold: float) -> np.ndarray:
    """Which rows (size_a, bits_a, size_b, bits_b) may reach the threshold by the bits of their whole sets."""
    sizes = [batch.column(k).to_numpy().astype(np.int64) for k in ("size_a", "size_b")]
    levels = np.concatenate([level_of(s) for s in sizes])
    flat = np.frombuffer(b"".join(x for k in ("bits_a", "bits_b") for x in batch.column(k).to_pylist()), np.uint64)
    n = batch.num_rows
    lost = Signatures(levels, flat).missing(np.arange(n), np.arange(n, 2 * n))
    need = overlap_needed(*sizes, threshold)
    return (sizes[0] - lost[0] >= need) & (sizes[1] - lost[1] >= need)


def common_elements(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two ascending arrays without repeats share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def similar_pairs(
    df: DataFrame,
    id_col: str = "concept_id",
    columns: tuple[str, ...] = ("title", "content"),
    n: int = 5,
    threshold: float = 0.8,
    min_words: int = 50,
    docs_per_bucket: int = 20_000,
    split: int = 8_192,
    least_buckets: int = 12,
    expand: int = 64,
) -> DataFrame:
    """``(id_a, id_b)``, the smaller first: records whose sets of all runs of ``n`` words have a Jaccard similarity of
    ``threshold`` or more.

    A tile holds the records that share one of their rarest elements, in order of size, so that the size band bounds
    it; similar records always share such an element. Every record goes there with its size, the element's place in
    its order and a bitmap of a third of its elements, at most once to a bucket of tiles. Bit counts bound the overlap
    from above; pairs that are left meet the bitmaps of their whole sets, and pairs left then their sets, which are
    intersected as sorted arrays. An element that more than ``split`` records have is spread over a grid of tiles, so
    no hot group lands in one task. Nothing is capped or sampled away, and no similar pair is lost.

    Defined cases: the columns are joined by a blank, null as empty; records under ``min_words`` or ``n`` words have no
    partners; repeated rows of an id count once, rows without id not at all, of several texts of an id the one with
    the least hash. Of records with the same text (without case) one stands for all in the search. Up to ``expand`` of
    them take all its links and pair with one another; more are a class: each is paired with its representative, the
    one of the least id, which has the links.
    """
    docs = _texts(df, id_col, list(columns))
    reps, copies, total = _representatives(docs)
    buckets = max(least_buckets, math.ceil(total / docs_per_bucket))
    counters = min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << math.ceil(math.log2(max(1, total * COUNTERS_EACH)))))
    made = _summaries(reps, n, min_words, counters)
    whole = made.filter("id is not null").select("id", "size", "bits").dropDuplicates(["id"])
    codes = _sketch(made.filter("part is not null").select("part", "lane", "counts"), counters)
    floor = int(COUNT_OF[np.partition(codes, len(codes) // 2)[len(codes) // 2]])  # what chance puts on a counter
    sketch = df.sparkSession.sparkContext.broadcast(codes)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for part in slices(batch, "text", 6_000_000):  # under 2^16 records of 50 words
                out = _emit(part.column(0).to_pylist(), part.column(1).to_pylist(), sketch.value, floor, n, min_words, threshold, buckets, split, known)
                if out is not None:
                    yield out

    tiles = reps.mapInArrow(emit, "bucket int, data binary")
    pairs = tiles.groupBy("bucket").applyInArrow(lambda t: _bucket_pairs(t, threshold), "a long, b long").distinct()

    def beside(these: DataFrame, values: DataFrame) -> DataFrame:
        names = [c for c in values.columns if c != "id"]
        out = these
        for side in ("a", "b"):
            out = out.join(values.select(F.col("id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in names)), side)
        return out.select("a", "b", *(f"{c}_{side}" for side in ("a", "b") for c in names))

    def kept(make) -> object:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    ok = pa.array(np.flatnonzero(make(batch)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(ok), batch.column(1).take(ok)], ["a", "b"])

        return run

    near = cut(beside(pairs, whole).mapInArrow(kept(lambda x: _bounded(x, threshold)), "a long, b long"))
    wanted = cut(near.select(F.explode(F.array("a", "b")).alias("id")).distinct())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                made = shingle_sets([words_of(t) for t in part.column(1).to_pylist()], n, known)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in made], pa.binary())], ["id", "elements"])

    full = reps.join(F.broadcast(wanted) if wanted.count() <= MAX_IDS else wanted, "id", "left_semi").mapInArrow(sets, "id long, elements binary")

    def verified(batch: pa.RecordBatch) -> np.ndarray:
        ok = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            ok.append(common_elements(a, b) >= overlap_needed(len(a), len(b), threshold))
        return np.array(ok)

    found = beside(near, full).mapInArrow(kept(verified), "a long, b long").distinct()
    # copies: those of small groups take part in all links, those of large ones are members of their representative
    copies = copies.join(whole.select(F.col("id").alias("rep")), "rep", "left_semi")
    small = copies.filter(F.col("copies") <= expand).select("rep", "id")
    for side in ("a", "b"):
        found = found.join(small.select(F.col("rep").alias(side), F.col("id").alias("own")), side, "left").withColumn(side, F.coalesce("own", side)).drop("own")
    within = small.withColumnRenamed("id", "a").join(small.withColumnRenamed("id", "b"), "rep").filter("a < b").select("a", "b")
    members = copies.filter((F.col("copies") > expand) & (F.col("id") != F.col("rep"))).select(F.col("rep").alias("a"), F.col("id").alias("b"))
    found = found.select("a", "b").unionByName(within).unionByName(members)
    return found.select(F.least("a", "b").alias(f"{id_col}_a"), F.greatest("a", "b").alias(f"{id_col}_b"))


def components(edges: DataFrame) -> DataFrame:
    """``(a, label)``: the least record of the connected component of each record of ``edges`` (a, b), which has both directions.

    Each round every record takes the least of its label, its label's label and those around it, and the record that
    its label names takes the same (FastSV), so whole trees are hooked and chains shrink by a factor a round. Labels
    only fall and stand still only where they agree along every edge, so the loop needs no bound. Labels are written
    to the shared folder each round.
    """
    labels = cut(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")))
    moved = True
    while moved:
        grand = labels.join(labels.select(F.col("a").alias("label"), F.col("label").alias("grand")), "label")
        near = edges.join(grand.select(F.col("a").alias("b"), F.col("grand").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        around = cut(grand.join(near, "a").select("a", "label", F.least("grand", "near").alias("least")))
        hooks = around.groupBy(F.col("label").alias("a")).agg(F.min("least").alias("hook"))
        new = cut(around.join(hooks, "a", "left").select("a", F.least("label", "least", "hook").alias("label"), F.col("label").alias("old")))
        moved = new.filter("label <> old").limit(1).count() > 0
        labels = new.select("a", "label")
    return labels


def similar_groups(df: DataFrame, id_col: str = "concept_id", **options) -> DataFrame:
    """``(id_col, group_id, links)``: the class of each record (its least id) and its number of links.

    Classes are the connected components of similar_pairs. A record without partners is its own class with no links.
    """
    pairs = similar_pairs(df, id_col, **options)
    both = pairs.toDF("a", "b")
    edges = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    links = edges.groupBy("a").agg(F.count(F.lit(1)).alias("links"))
    known = components(edges).join(links, "a")
    ids = df.select(F.col(id_col).cast("long").alias("id")).filter("id is not null").distinct()
    out = ids.join(known, F.col("id") == F.col("a"), "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("label", "id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
