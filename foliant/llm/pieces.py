"""Splitting long texts at natural boundaries."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.lines import per_slice

#: Boundaries, best first; each match ends where a piece may end.
LEVELS = [
    re.compile(r"\n[^\S\n]*\r?\n(?!\s*\n)"),
    re.compile(r"\n"),
    re.compile(r"[.!?…](?:[\"'”’)\]]*)\s|[。！？]"),
    re.compile(r"\s(?!\s)"),
]


def boundaries(text: str, reach: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending places where ``text`` may be cut and the level of each (0 paragraph .. 3 word, 4 none natural).

    The first stands for the text's start: the first piece carries no overlap, so it may reach ``overlap`` farther, as
    if it began there; cuts up to that place would be useless and are left out. Stretches longer than ``reach``
    without any boundary get one at each multiple of ``reach`` from their start.
    """
    n = len(text)
    best = np.full(n + 1, 9, np.int8)
    for level in range(len(LEVELS) - 1, -1, -1):
        at = np.fromiter((m.end() for m in LEVELS[level].finditer(text)), np.int64)
        best[at] = level
    best[: overlap + 1] = 9
    best[overlap], best[n] = 0, 0
    at = np.flatnonzero(best < 9)
    gaps = np.diff(at)
    if len(gaps) and gaps.max() > reach:
        for k in np.flatnonzero(gaps > reach):
            best[np.arange(at[k] + reach, at[k + 1], reach)] = 4
        at = np.flatnonzero(best < 9)
    return at, best[at]


def successors(at: np.ndarray, level: np.ndarray, reach: int, doc_end: np.ndarray) -> np.ndarray:
    """For each boundary, as an index into ``at``, the cut that follows a cut there.

    The next cut is at most ``reach`` on. Of the boundaries in the farther half of that stretch the best level wins,
    and of those the farthest; if the half has none, the farthest boundary. A document's end follows itself.
    ``doc_end`` has the index of the end of each boundary's document.
    """
    last = np.minimum(np.searchsorted(at, at + reach, side="right") - 1, doc_end)
    half = np.searchsorted(at, at + reach // 2, side="left")
    nxt = last.copy()
    taken = last >= doc_end
    for k in range(5):
        # the farthest boundary of this level at or before `last`
        of = np.flatnonzero(level == k)
        if not len(of):
            continue
        j = np.searchsorted(of, last, side="right") - 1
        cand = of[np.maximum(j, 0)]
        ok = (j >= 0) & (cand >= half) & ~taken
        nxt[ok] = cand[ok]
        taken |= ok
    return nxt


def reached(nxt: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Marks what is met from ``starts`` by following ``nxt``: pointer doubling, so log2(longest chain) rounds."""
    mark = np.zeros(len(nxt), bool)
    mark[starts] = True
    jump = nxt
    while True:
        known = np.flatnonzero(mark)
        mark[jump[known]] = True
        squared = jump[jump]
        if np.array_equal(squared, jump):
            return mark
        jump = squared


def cuts(texts: list[str], limit: int, overlap: int) -> list[list[tuple[int, int]]]:
    """``(start, end)`` of the pieces of each text, all texts cut in parallel."""
    reach, far = limit - overlap, 0
    at_all, level_all, end_of, starts, offset, known = [], [], [], [], [], 0
    for text in texts:
        at, level = boundaries(text, reach, overlap)
        at_all.append(at + far)
        level_all.append(level)
        starts.append(known)
        known += len(at)
        end_of.append(np.full(len(at), known - 1))
        offset.append(far)
        far += len(text) + 2 * limit
    at, level, ends = np.concatenate(at_all), np.concatenate(level_all), np.concatenate(end_of)
    mark = reached(successors(at, level, reach, ends), np.array(starts))
    out = []
    for k, text in enumerate(texts):
        a, b = starts[k], ends[starts[k]] + 1
        stops = (at[a:b][mark[a:b]] - offset[k])[1:].tolist()
        out.append([(max(0, s - overlap), e) for s, e in zip([0, *stops[:-1]], stops, strict=True)])
    return out


def text_pieces(df: DataFrame, id_col: str = "concept_id", text: str = "content", limit: int = 4000, overlap: int = 200, only_long: bool = False) -> DataFrame:
    """``(id_col, piece_no, start, piece)``: each text in pieces of at most ``limit`` characters (code points).

    Each piece but the first starts with the last ``overlap`` characters of the one before. Cuts lie after a
    paragraph, else a line, a sentence, a word, and inside a run without any of these only when it exceeds the reach.
    Every boundary is joined to its farthest legal successor by binary search, and squaring the successor table gives
    all cuts of all texts of a batch in a logarithmic number of rounds.

    Defined cases: a text within the limit is one piece, also an empty one; a null text gives one null piece with
    number 1 and start 0; repeated rows give their pieces again; ``only_long`` leaves out texts within the limit.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be under half the limit")
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("piece_no", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("piece", T.StringType())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        long = [k for k, t in enumerate(texts) if t is not None and len(t) > limit]
        spans = dict(zip(long, cuts([texts[k] for k in long], limit, overlap), strict=True)) if long else {}
        row, no, start, piece = [], [], [], []
        for k, t in enumerate(texts):
            for i, (s, e) in enumerate(spans.get(k) or [(0, len(t or ""))], 1):
                row.append(k), no.append(i), start.append(s), piece.append(t and t[s:e] if t else t)
        ids = batch.column(0).take(pa.array(row, pa.int64()))
        return pa.RecordBatch.from_arrays([ids, pa.array(no, pa.int32()), pa.array(start, pa.int32()), pa.array(piece, pa.string())], [id_col, "piece_no", "start", "piece"])

    source = df.select(id_col, F.col(text).cast("string").alias(text if text != id_col else "_text"))
    if only_long:
        source = source.filter(F.length(F.col(source.columns[1])) > limit)
    return source.mapInArrow(per_slice(work, source.columns[1]), schema)


def oversized(df: DataFrame, id_col: str = "concept_id", text: str = "content", limit: int = 4000, overlap: int = 200) -> DataFrame:
    """``(id_col,)`` of the texts that were cut, each once."""
    return text_pieces(df, id_col, text, limit, overlap, only_long=True).filter("piece_no = 2").select(id_col).distinct()
