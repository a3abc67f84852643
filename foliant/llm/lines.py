"""Shared pieces of the text operators: sites, lines, words, Arrow plumbing."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")


def site(url: Column) -> Column:
    """The host of a url in lower case without user, port and leading ``www.``; null if it has none."""
    host = F.lower(F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(host != "", host)


def normal_line(line: Column) -> Column:
    """A line without letter case and outer white space, inner white space as one blank, any run of digits as 0."""
    flat = F.trim(F.regexp_replace(F.lower(line), r"(?U)\s+", " "))
    return F.regexp_replace(flat, r"(?U)\d+", "0")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose text stays under ``most_bytes`` where rows allow."""
    sizes = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    ends = np.cumsum(sizes)
    start, n = 0, batch.num_rows
    while start < n:
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield batch.slice(start, end - start)
        start = end


def per_slice(work: Callable[[pa.RecordBatch], pa.RecordBatch], column: str) -> Callable:
    """``work`` over bounded slices, for mapInArrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                out = work(part)
                if out.num_rows:
                    yield out

    return run
