"""Rule findings over a bundle's files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import RESERVED


def findings(files: DataFrame) -> DataFrame:
    """``(tool, path, rule, severity)`` over files (tool, path, text).

    E1: a page whose first line isn't ``---``. E2: no or an empty ``type:``. W1: no ``title:`` or ``description:``.
    E3: an ``index.md`` below the root with frontmatter. WLOG: a log with text but no dated section. Generated files,
    by name at any depth, are held to E3 and WLOG only; E1 ends a file's rules, E2 its W1. Lines end in a newline
    alone, so a file with CRLF fails E1. Null texts count as empty.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "\n", -1)
    name = F.element_at(F.split("path", "/", -1), -1)
    reserved = name.isin([f"{r}.md" for r in RESERVED])
    opened = F.get(lines, F.lit(0)) == "---"
    # the header runs from line 2 to the next "---" line, or on to the end
    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    again = F.slice(rest, 2, F.greatest(F.size(rest) - 1, F.lit(0)))
    end = F.array_position(again, "---").cast("int")
    header = F.when(end > 0, F.slice(rest, 1, end)).otherwise(rest)
    kind = F.get(F.filter(header, lambda x: F.startswith(x, F.lit("type:"))), F.lit(0))
    value = F.regexp_replace(F.regexp_replace(kind, "^type:", ""), "[\"'\\s]", "")
    no_type = F.coalesce(value, F.lit("")) == ""
    has = lambda key: F.exists(header, lambda x: F.startswith(x, F.lit(key)))
    page, good = ~reserved, ~reserved & opened & ~no_type
    rule = lambda when, rule, severity: F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity")))
    found = F.array_compact(
        F.array(
            rule((name == "index.md") & opened & (F.col("path") != "index.md"), "E3", "error"),
            rule((name == "log.md") & (text != "") & ~F.exists(lines, lambda x: F.rlike(x, F.lit("^## [0-9]{4}-[0-9]{2}-[0-9]{2}"))), "WLOG", "warning"),
            rule(page & ~opened, "E1", "error"),
            rule(page & opened & no_type, "E2", "error"),
            rule(good & ~has("title:"), "W1-title", "warning"),
            rule(good & ~has("description:"), "W1-description", "warning"),
        )
    )
    return files.select("tool", "path", F.explode(found).alias("f")).select("tool", "path", "f.rule", "f.severity")


def summary(files: DataFrame) -> DataFrame:
    """``(tool, files, errors, warnings)`` of each tool's files; a bundle passes with no errors."""
    scanned = files.groupBy("tool").agg(F.count(F.lit(1)).alias("files"))
    found = findings(files).groupBy("tool").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return scanned.join(found, "tool", "left").select("tool", "files", F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("warnings", F.lit(0)).alias("warnings"))


def exit_code(errors: int) -> int:
    return min(errors, 255)
