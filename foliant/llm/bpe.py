"""Encoding of texts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import heapq
import importlib
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.lines import slices

#: Bytes up to which a word is merged by scans of its rank array; longer ones use a heap over the same ranks.
SHORT = 64
#: The split pattern of the byte_bpe vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The same pattern for the faster engine, in whose classes a letter is a word character that is no decimal digit.
#: Texts with other numbers, other blanks or the stand-in for "_" go the way of PATTERN.
PLAIN = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d]+| ?\d+| ?[^\s\w]+|\s+(?!\S)|\s+")
STAND_IN = "\ue000"
CONTROL = re.compile(r"[\x1c-\x1f]")
UNLIKE = frozenset(map(chr, (0xE000, *(c for c in range(0x80, 0x20000) if unicodedata.category(chr(c)) in ("Nl", "No")))))


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed vocabulary files lie; a parameter of every query, never copied."""
    folder = os.environ.get("FOLIANT_TOKENIZERS", "/opt/tokenizers")
    if os.path.exists(os.path.join(folder, name)):
        return os.path.join(folder, name)
    return importlib.import_module("public_tokenizers").path(name)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Merger:
    """Merges the bytes of one word, lowest rank first, leftmost of equals first."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.none = len(ranks) + 1_000_000

    def encode(self, word: bytes) -> list[int]:
        if (known := self.ranks.get(word)) is not None:
            return [known]
        return self._short(word) if len(word) <= SHORT else self._long(word)

    def _short(self, word: bytes) -> list[int]:
        """Part boundaries and the rank of each adjacent pair, held side by side and scanned for the least."""
        get, none = self.ranks.get, self.none
        bounds = list(range(len(word) + 1))
        pair = [get(word[i : i + 2], none) for i in range(len(word) - 1)]
        while pair:
            least = min(pair)
            if least == none:
                break
            i = pair.index(least)
            del bounds[i + 1], pair[i]
            if i < len(pair):
                pair[i] = get(word[bounds[i] : bounds[i + 2]], none)
            if i:
                pair[i - 1] = get(word[bounds[i - 1] : bounds[i + 1]], none)
        return [self.ranks[word[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _long(self, word: bytes) -> list[int]:
        """The same merges for long words: a linked list of parts and a heap of (rank, start), n log n."""
        get, n = self.ranks.get, len(word)
        end, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            alive[j], end[i] = False, stop
            if stop < n:
                prev[stop] = i
                if (r := get(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := prev[i]) >= 0 and (r := get(word[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return [self.ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Encodes texts; what a word merges to is kept for up to ``keep`` distinct words of the task."""

    def __init__(self, path: str, keep: int = 400_000) -> None:
        self.merger = Merger(load_ranks(path))
        self.exact = regex.compile(PATTERN).findall
        self.keep = keep
        self._empty()

    def _empty(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.begin: list[int] = []

    def split(self, text: str) -> list[str]:
        """The words of ``text``, with STAND_IN for "_" where the text has none of its own."""
        if CONTROL.search(text) or not (text.isascii() or UNLIKE.isdisjoint(text)):
            return [w.replace("_", STAND_IN) if STAND_IN not in w else "_" + w for w in self.exact(text)]
        return PLAIN.findall(text.replace("_", STAND_IN))

    def _learn(self, words: set[str]) -> None:
        if len(self.place) + len(words) > self.keep:
            self._empty()  # memory stays bounded; the caller asks for all its words at once
        for w in words:
            if w in self.place:
                continue
            plain = w[1:] if STAND_IN in w and w[0] == "_" else w.replace(STAND_IN, "_")
            out = self.merger.encode(plain.encode("utf-8", "surrogatepass"))
            if self.used + len(out) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(out)), np.int32)])
            self.ids[self.used : self.used + len(out)] = out
            self.place[w] = len(self.begin)
            self.begin.append(self.used)
            self.used += len(out)

    def column(self, texts: list[str | None]) -> pa.Array:
        """A list array of the ids of each text: [] for an empty one, null for null."""
        parts = [self.split(t) if t else [] for t in texts]
        words = [w for p in parts for w in p]
        if new := set(words) - self.place.keys():
            self._learn(set(words) if len(self.place) + len(new) > self.keep else new)
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        begin = np.array([*self.begin, self.used], np.int64)
        size = (begin[1:] - begin[:-1])[at] if len(at) else np.zeros(0, np.int64)
        stops = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[np.repeat(begin[at] - stops[:-1], size) + np.arange(stops[-1])] if len(at) else np.zeros(0, np.int32)
        counts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        offsets = pa.array(stops[counts].astype(np.int32), mask=np.array([*[t is None for t in texts], False]))
        return pa.ListArray.from_arrays(offsets, pa.array(flat))


def encode_ids(df: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, keep: int = 400_000) -> DataFrame:
    """``(id_col, ids)``: every text's token ids, without special tokens (their names are ordinary text).

    One pass, no shuffle. An empty text gives an empty list, a null one null; repeated rows are encoded again; words
    of any length merge exactly. ``path`` names a rank file ("base64 rank" a line).
    """
    path = path or vocabulary_path()
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            for part in slices(batch, batch.schema.names[1]):
                encoder = encoder or Encoder(path, keep)
                yield pa.RecordBatch.from_arrays([part.column(0), encoder.column(part.column(1).to_pylist())], [id_col, "ids"])

    return df.select(id_col, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)
