"""Text scalars of bundles as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters under which a converted page is held to need a browser.
CONTENT_THRESHOLD = 200
#: Names that every directory keeps for generated files.
RESERVED = ["index", "glossary", "log"]
#: Characters of a page that a summary provider sees.
SUMMARY_CHARS = 6000


def stripped(text: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def below_threshold(text: Column, threshold: int = CONTENT_THRESHOLD) -> Column:
    return F.length(stripped(text)) < threshold


def content_hash(html: Column) -> Column:
    return F.sha2(html, 256)


def base_name(page: Column) -> Column:
    return F.element_at(F.split(page, "/", -1), -1)


def is_reserved(page: Column) -> Column:
    """The page's file name is one of the generated ones, at any depth."""
    return base_name(page).isin(RESERVED)


def unsafe_path(page: Column) -> Column:
    """The path has a ``..`` segment and must not be written to disk."""
    return F.array_contains(F.split(page, "/", -1), "..")


def title_case(text: Column) -> Column:
    """Each run of letters with its first one upper and the others lower: ``3d api.v2`` gives ``3D Api.V2``."""
    chars = F.regexp_extract_all(text, F.lit(r"(?s)."), 0)
    state = F.aggregate(
        chars,
        F.struct(F.lit("").alias("out"), F.lit(False).alias("within")),
        lambda acc, c: F.struct(
            F.concat(acc["out"], F.when(acc["within"], F.lower(c)).otherwise(F.upper(c))).alias("out"), F.coalesce(F.rlike(c, F.lit(r"^\p{L}$")), F.lit(False)).alias("within")
        ),
    )
    return state["out"]


def directory_title(directory: Column, tool: Column) -> Column:
    """The heading of a directory's listing: the tool at the root, else its last segment in title case."""
    return F.when(directory == "", tool).otherwise(title_case(F.translate(base_name(directory), "-_", "  ")))


def without_fences(reply: Column) -> Column:
    """A provider's reply without the code fence around it."""
    return F.regexp_replace(F.regexp_replace(stripped(reply), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")


def glossary_filled(text: Column) -> Column:
    """Some line of a glossary file begins an entry."""
    return F.exists(F.split(text, "\n", -1), lambda x: F.startswith(x, F.lit("**")))


def has_frontmatter(text: Column) -> Column:
    return F.startswith(text, F.lit("---\n")) & (F.instr(F.substring(text, 5, 2147483647), "---\n") > 0)


def frontmatter_of(text: Column) -> Column:
    """The YAML between the opening ``---`` and the next ``---`` line end; null where there is none."""
    rest = F.substring(text, 5, 2147483647)
    end = F.instr(rest, "---\n")
    return F.when(has_frontmatter(text), F.substring(rest, F.lit(1), end - 1))


def body_of(text: Column) -> Column:
    """What follows the frontmatter; the whole text where there is none."""
    rest = F.substring(text, 5, 2147483647)
    end = F.instr(rest, "---\n")
    return F.when(has_frontmatter(text), F.substring(rest, end + 4, F.lit(2147483647))).otherwise(text)


def milestone_step(total: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(total / 10)).cast("int")
