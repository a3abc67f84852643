"""Evaluation passages inside a corpus: CGK embedding of word windows, bit-sampling LSH, exact verification."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.lines import slices, words_of

#: Symbol that a walk emits beyond its document's end.
PAD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _mix(signature: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    x = (signature ^ symbol) * _MIX
    return x ^ (x >> np.uint64(29))


class Words:
    """64-bit random words of distinct words, kept for up to ``keep`` of them."""

    def __init__(self, seed: int, keep: int = 500_000) -> None:
        self.seed, self.keep, self.known = seed, keep, {}

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.known) > self.keep:
            self.known = {}
        known = self.known
        for w in set(words) - known.keys():
            known[w] = xxhash.xxh64_intdigest(w, self.seed)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def walk(symbols: np.ndarray, start: np.ndarray, until: np.ndarray, step: int, steps: list[int], tables: list[np.ndarray] | None = None, bits: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the windows that begin at ``start`` and go on by ``step`` (1 forwards, -1 backwards).

    At each step the walk emits the word under its pointer (PAD from ``until`` on) and moves on if that word's bit of
    the step is set, so two windows that differ by an edit fall into step again. The words emitted at the sampled
    ``steps`` make the signature. A walk of fewer steps than words never leaves its window, so windows that an edit
    made longer or shorter need no walk of their own. ``tables`` has for each sampled step which partial signatures
    (their first ``bits`` bits) can still become an item's; others leave at once. Returns the windows left, as places
    in ``start``, and their signatures.
    """
    left, at, signature = np.arange(len(start)), start.copy(), np.zeros(len(start), np.uint64)
    one, last, k = np.uint64(1), len(symbols) - 1, 0
    for j in range(steps[-1] + 1):
        inside = at < until if step > 0 else at > until
        under = np.where(inside, symbols[np.clip(at, 0, last)], PAD)
        if j == steps[k]:
            signature = _mix(signature, under)
            if tables is not None:
                place = (signature >> np.uint64(64 - bits)).astype(np.int64)
                keep = (tables[k][place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                left, at, until, signature, under = left[keep], at[keep], until[keep], signature[keep], under[keep]
            k += 1
        at = at + step * ((under >> np.uint64(j % 64)) & one).astype(np.int64)
    return left, signature


def edits_to_prefix(item: list, words: list, most: int) -> int:
    """The least word edits between ``item`` and any beginning of ``words``; ``most`` + 1 if there are more."""
    row = list(range(len(words) + 1))
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        if min(new) > most:
            return most + 1
        row = new
    return min(*row, most + 1)


def edited(rng: np.random.Generator, words: list, edits: int) -> list:
    """The words after so many random substitutions, insertions and deletions."""
    out = list(words)
    for _ in range(edits):
        kind, at, new = int(rng.integers(3)), int(rng.integers(max(1, len(out)))), int(rng.integers(1, 1 << 62))
        if kind == 0:
            out.insert(at, new)
        elif kind == 1 and len(out) > 1:
            del out[at]
        else:
            out[at] = new
    return out


class Index:
    """The item windows of one block of items, by length, in as many tables as the target recall takes.

    A table has a random walk, forwards or backwards in turn, and a sample of its steps. How many there are is
    measured: windows of the block are edited ``edits`` times at random, and tables are added until the target share
    of them meets its origin in one. ``trials`` windows drawn at random serve for that count; all are indexed.
    """

    def __init__(self, items: list[tuple[object, str]], window: int, edits: int, samples: int, recall: float, seed: int, trials: int = 2_000, most_tables: int = 96) -> None:
        self.edits, self.seed = edits, seed
        self.items = [item for item, _ in items]
        self.words = [words_of(passage) for _, passage in items]
        symbols_of = Words(seed)
        symbols = symbols_of([w for words in self.words for w in words])
        rng = np.random.default_rng(seed)
        begin = np.concatenate([[0], np.cumsum([len(w) for w in self.words])]).astype(np.int64)
        by_length: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, words in enumerate(self.words):
            n = min(window, len(words))
            if n:
                by_length[n] += [(k, i) for i in range(len(words) - n + 1)]
        #: (n, owner and place of each window, tables); a table is (walk, step, sampled steps, bits, partial tables, signatures, their windows)
        self.parts = []
        for n, windows in sorted(by_length.items()):
            where = np.array(windows, np.int64).reshape(-1, 2)
            start = begin[where[:, 0]] + where[:, 1]
            bits = int(np.clip(np.ceil(np.log2(16 * len(where))), 16, 24))
            chosen = rng.integers(len(where), size=trials)
            trial = [edited(rng, symbols[start[k] : start[k] + n].tolist(), edits) for k in chosen] if edits else []
            trial_at = np.concatenate([[0], np.cumsum([len(t) for t in trial])]).astype(np.int64)
            trial_symbols = np.array([x for t in trial for x in t] or [0], np.uint64)
            met = np.zeros(len(trial), bool)
            tables = []
            while not tables or (edits and met.mean() < recall):
                r = len(tables)
                if r >= most_tables:
                    raise ValueError(f"{edits} edits in {n} words: {met.mean():.3f} found by {r} tables, not {recall}")
                step, steps = (-1 if r % 2 else 1), sorted(rng.choice(n, min(samples, n), replace=False).tolist())
                if not edits:
                    steps = sorted({0, *steps[1:]})  # equal windows agree at every step; step 0 lets others leave early
                far = start if step > 0 else start + n - 1
                turned = self.turned(symbols, r)
                partial = [walk(turned, far, far + step * n, step, steps[: k + 1])[1] for k in range(len(steps))]
                order = np.argsort(partial[-1], kind="stable").astype(np.int32)
                masks = []
                for x in partial:
                    flags = np.zeros(1 << bits, bool)
                    flags[(x >> np.uint64(64 - bits)).astype(np.int64)] = True
                    masks.append(np.packbits(flags, bitorder="little"))
                tables.append((r, step, steps, bits, masks, partial[-1][order], order))
                if edits:
                    ends = trial_at[1:] - 1
                    own = trial_at[:-1] if step > 0 else ends
                    stop = trial_at[1:] if step > 0 else trial_at[:-1] - 1
                    met |= walk(self.turned(trial_symbols, r), own, stop, step, steps)[1] == partial[-1][chosen]
            self.parts.append((n, where, tables))

    @staticmethod
    def turned(symbols: np.ndarray, table: int) -> np.ndarray:
        """The words' random bits for one table's walk."""
        return _mix(symbols, np.uint64(table * 2 + 1))

    def find(self, words: list[str], symbols: np.ndarray, first: np.ndarray, stop: np.ndarray) -> set[tuple[int, int]]:
        """``(document, item)`` by their numbers, for documents whose words lie at ``first`` .. ``stop``."""
        found: set[tuple[int, int]] = set()
        size = stop - first
        document = np.repeat(np.arange(len(first)), size)
        place = np.arange(len(document))
        turned: dict[int, np.ndarray] = {}
        for n, where, tables in self.parts:
            for r, step, steps, bits, masks, signatures, order in tables:
                if r not in turned:
                    turned[r] = self.turned(symbols, r)
                room = stop[document] - place if step > 0 else place - first[document] + 1
                start = place[room >= n - self.edits]
                until = stop[document[start]] if step > 0 else first[document[start]] - 1
                left, signature = walk(turned[r], start, until, step, steps, masks, bits)
                lo, hi = np.searchsorted(signatures, signature, "left"), np.searchsorted(signatures, signature, "right")
                for k in np.flatnonzero(hi > lo).tolist():
                    at = int(start[left[k]])
                    doc = int(document[at])
                    for w in order[lo[k] : hi[k]].tolist():
                        owner, i = where[w].tolist()
                        if (doc, owner) not in found and self.near(self.words[owner][i : i + n], words, at, step, int(first[doc]), int(stop[doc])):
                            found.add((doc, owner))
        return found

    def near(self, item: list[str], words: list[str], at: int, step: int, first: int, stop: int) -> bool:
        """Whether the words from ``at`` on, in the walk's direction, are the item's up to the edits allowed."""
        reach = len(item) + self.edits
        own = words[at : min(stop, at + reach)] if step > 0 else words[max(first, at - reach + 1) : at + 1]
        if not self.edits:
            return own == item
        there = set(own)
        if sum(w not in there for w in item) > self.edits:
            return False  # each word that is missing is an edit
        return edits_to_prefix(item[::step], own[::step], self.edits) <= self.edits


def leaked_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    passage: str = "passage",
    window: int | None = 13,
    edits: int = 0,
    samples: int = 5,
    recall: float = 0.99,
    seed: int = 20,
    block_chars: int = 4_000_000,
) -> DataFrame:
    """``(doc_id, item_id)`` of every document with ``window`` words in a row of an item's passage, or all of it if
    it has fewer, up to ``edits`` word edits (substitutions, insertions, deletions). ``window`` None takes windows of
    each item's own size, so that only whole passages count.

    Words are runs of letters or digits in lower case. Each window of a document is embedded by random walks that
    turn edits into differing places, hashed by a sample of those places, looked up among the items' windows, and
    verified by its edit distance. With ``edits`` = 0 one table finds all; else as many as it takes until the target
    ``recall`` is measured on edited windows; a target out of reach raises. The
    documents are read in place: nothing of them is shuffled. Items are sent out in blocks of about ``block_chars``
    characters, one pass over the documents for each, so what a worker holds is bounded however many items there are.

    Defined cases: null and empty texts and passages, and passages without a word, give no rows; items that share a
    stretch are all reported; repeated rows give one row; no items give no rows.
    """
    spark = docs.sparkSession
    items = items.select(F.col(item_id).alias("i"), F.col(passage).cast("string").alias("p")).filter("p is not null").distinct()
    chars = items.agg(F.sum(F.length("p"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars))
    schema = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField(item_id, items.schema["i"].dataType)])
    item_type = pa.int64() if isinstance(items.schema["i"].dataType, T.LongType) else pa.int32() if isinstance(items.schema["i"].dataType, T.IntegerType) else pa.string()
    source = docs.select(F.col(doc_id), F.col(text).cast("string").alias("_text")).filter(F.col("_text").isNotNull())
    out = None
    for b in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b) if blocks > 1 else items
        index = spark.sparkContext.broadcast(Index([(r.i, r.p) for r in own.collect()], window or 1 << 30, edits, samples, recall, seed))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            symbols = Words(seed)
            for batch in batches:
                for part in slices(batch, "_text"):
                    split = [words_of(t) for t in part.column(1).to_pylist()]
                    stop = np.cumsum([len(w) for w in split])
                    words = [w for s in split for w in s]
                    pairs = index.value.find(words, symbols(words), stop - [len(w) for w in split], stop)
                    if pairs:
                        rows, hit = zip(*sorted(pairs, key=lambda x: x[0]), strict=True)
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array([index.value.items[k] for k in hit], item_type)], [doc_id, item_id])

        one = source.mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return out.distinct()
