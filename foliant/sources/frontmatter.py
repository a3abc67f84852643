"""YAML frontmatter: rendering in a fixed order, reading, merging."""

from __future__ import annotations

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.text import body_of, frontmatter_of

FIELDS = ["type", "title", "description", "resource", "timestamp", "content_hash", "keywords", "nav_path"]
OPTIONAL = {"description", "keywords", "nav_path"}
READ = T.StructType([*(T.StructField(f, T.ArrayType(T.StringType()) if f in ("keywords", "nav_path") else T.StringType()) for f in FIELDS), T.StructField("extra", T.MapType(T.StringType(), T.StringType()))])


def block(values: dict, sort_keys: bool = False) -> str:
    """A mapping between two ``---`` lines."""
    return f"---\n{yaml.safe_dump(values, sort_keys=sort_keys, allow_unicode=True)}---\n"


@F.pandas_udf(T.StringType())
def _render(rows: pd.DataFrame) -> pd.Series:
    out = []
    for row in rows.to_dict("records"):
        values = {}
        for k, v in row.items():
            v = list(v) if v is not None and not isinstance(v, str) and hasattr(v, "__len__") else v
            if k not in OPTIONAL or v:
                values[k] = v
        out.append(block(values))
    return pd.Series(out, dtype=object)


def frontmatter_text(*columns: str) -> Column:
    """The frontmatter of the named columns in their order; empty optional ones are left out."""
    return _render(F.struct(*columns))


def read_mapping(text: str | None) -> dict:
    """The mapping of a frontmatter; empty for none, for broken YAML and for other kinds of values."""
    try:
        found = yaml.safe_load(text) if text else None
    except yaml.YAMLError:
        return {}
    return found if isinstance(found, dict) else {}


@F.pandas_udf(READ)
def _read(text: pd.Series) -> pd.DataFrame:
    rows = []
    for t in text:
        found = read_mapping(t)
        row = {}
        for f in FIELDS:
            v = found.pop(f, None)
            if f in ("keywords", "nav_path"):
                row[f] = [str(x) for x in v] if isinstance(v, list) else None
            else:
                row[f] = None if v is None else str(v)
        row["extra"] = {str(k): str(v) for k, v in found.items()}
        rows.append(row)
    return pd.DataFrame(rows, columns=READ.names)


def with_frontmatter(files: DataFrame, text: str = "text") -> DataFrame:
    """``files`` with a struct ``front`` and the ``body`` after it; a file without frontmatter has null fields."""
    return files.withColumn("front", _read(frontmatter_of(F.col(text)))).withColumn("body", body_of(F.col(text)))


@F.pandas_udf(T.StringType())
def _merge(text: pd.Series, updates: pd.Series) -> pd.Series:
    import json

    out = []
    for t, u in zip(text, updates, strict=True):
        at = t.find("---\n", 4) if isinstance(t, str) and t.startswith("---\n") else -1
        found, body = (read_mapping(t[4:at]), t[at + 4 :]) if at >= 0 else ({}, t or "")
        found.update(json.loads(u) if u else {})
        out.append(block(found, sort_keys=True) + "\n" + body.lstrip("\n"))
    return pd.Series(out, dtype=object)


def merged_text(text: Column, updates: Column) -> Column:
    """A file's text with its frontmatter updated by a JSON mapping; keys it doesn't know are kept, all get sorted."""
    return _merge(text, updates)
