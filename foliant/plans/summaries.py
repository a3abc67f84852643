"""Summaries and glossaries behind a pluggable provider."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators.bundle import directory_batches, glossary_terms

#: ``provider(prompt)`` gives a model's reply as text.
Provider = Callable[[str], str]
SUMMARY = "tool string, page_path string, status string, summary string, keywords array<string>, candidates array<string>"


def salvaged(text: str | None) -> list:
    """The objects of a JSON array that may be cut off or have stray commas; [] for anything else.

    Strict JSON is taken as it is if it is a list. Otherwise each whole object at the top level is kept; braces in
    strings count for nothing.
    """
    try:
        found = json.loads(text or "")
        return found if isinstance(found, list) else []
    except json.JSONDecodeError:
        pass
    out, decoder, at = [], json.JSONDecoder(), 0
    while (at := (text or "").find("{", at)) >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
        except json.JSONDecodeError:
            at = _past(text, at)
            continue
        out.append(value)
        at = end
    return out


def _past(text: str, at: int) -> int:
    """Where a broken object that opens at ``at`` ends; the text's end if it never does."""
    depth, quoted, k = 0, False, at
    while k < len(text):
        c = text[k]
        if quoted:
            if c == "\\":
                k += 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return k + 1
        k += 1
    return len(text)


def summary_prompt(url: str, content: str) -> str:
    return f"Summarise this documentation page as JSON with summary, keywords and candidates.\nURL: {url}\n\n{content[: X.SUMMARY_CHARS]}"


def summarised(manifest: DataFrame, concepts: DataFrame, provider: Provider, batch_size: int = 15, concurrency: int = 6) -> DataFrame:
    """``SUMMARY`` for each page of the manifest (tool, url, seq, page_path, content_hash).

    A page without a concept is FAILED; one with a description whose hash is the manifest's is skipped; others go to
    the provider in batches of a directory, ``concurrency`` partitions at a time, and a reply that isn't a JSON object
    or an exception makes FAILED.
    """
    rows = manifest.filter(F.coalesce("page_path", F.lit("")) != "").select("tool", "url", "seq", "page_path", F.col("content_hash").alias("m_hash"))
    known = concepts.select(F.col("tool").alias("c_tool"), F.col("page_path").alias("c_path"), "description", F.col("content_hash").alias("c_hash"), "md")
    rows = rows.join(known, (F.col("tool") == F.col("c_tool")) & (F.col("page_path") == F.col("c_path")), "left").drop("c_tool", "c_path")
    done = F.when(F.col("md").isNull(), "FAILED").when((F.coalesce("description", F.lit("")) != "") & (F.col("c_hash") == F.col("m_hash")), "skipped")
    rows = rows.withColumn("known", done)
    batches = directory_batches(rows.filter("known is null"), batch_size).select("tool", "url", "dir", "batch_no")
    open_rows = rows.filter("known is null").join(batches, ["tool", "url"]).select("tool", "url", "page_path", "dir", "batch_no", F.substring("md", 1, X.SUMMARY_CHARS).alias("md"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.itertuples():
                try:
                    found = json.loads(provider(summary_prompt(r.url, r.md)))
                    lists = [[str(x) for x in found.get(k) or []] for k in ("keywords", "candidates")]
                    out.append((r.tool, r.page_path, "summarized", str(found.get("summary") or ""), *lists))
                except Exception:  # noqa: BLE001 - a page's failure is its status
                    out.append((r.tool, r.page_path, "FAILED", None, None, None))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SUMMARY.split(", ")])

    made = open_rows.repartition(concurrency, "tool", "dir", "batch_no").mapInPandas(run, SUMMARY)
    rest = rows.filter("known is not null").select("tool", "page_path", F.col("known").alias("status"), *(F.lit(None).cast(t).alias(n) for n, t in (("summary", "string"), ("keywords", "array<string>"), ("candidates", "array<string>"))))
    return made.unionByName(rest)


def glossary(candidates: DataFrame, provider: Provider, filled: list[str] | None = None, per_call: int = 500, tools: DataFrame | None = None) -> DataFrame:
    """``(tool, path, text)`` of each tool's glossary: terms without repeats, defined by the provider.

    ``filled`` names tools whose glossary has entries: where the provider gives none, they keep their file (no row).
    ``tools`` (tool) adds tools that have no terms; the provider is asked for them too. Replies may be fenced or cut
    off. A provider's exception counts as no entries. A tool's terms go out in groups of about ``per_call``, so calls
    run beside each other and none grows with the bundle; of two definitions of a term the lesser one counts.
    """
    terms = glossary_terms(candidates).select("tool", "seq", "term")
    sizes = terms.groupBy("tool").agg(F.ceil(F.count(F.lit(1)) / per_call).alias("_groups"))
    terms = terms.join(sizes, "tool").withColumn("_group", F.pmod(F.xxhash64("term"), F.col("_groups"))).drop("_groups")
    if tools is not None:
        none = tools.select("tool").distinct().join(sizes, "tool", "left_anti")
        terms = terms.unionByName(none.select("tool", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("_group")))

    def define(part: pd.DataFrame) -> pd.DataFrame:
        tool = part.tool.iloc[0]
        words = part[part.term.notna()].sort_values("seq").term.tolist()
        rows = [(tool, None, None)]
        for k in range(0, max(1, len(words)), per_call):
            try:
                reply = provider("Define these terms as a JSON array of term and definition:\n" + "\n".join(words[k : k + per_call]))
            except Exception:  # noqa: BLE001
                continue
            text = reply.strip()
            text = text.split("\n", 1)[-1] if text.startswith("```") else text
            rows += [(tool, str(e["term"]), str(e["definition"])) for e in salvaged(text.removesuffix("```").strip()) if isinstance(e, dict) and e.get("term") and e.get("definition")]
        return pd.DataFrame(rows, columns=["tool", "term", "definition"])

    made = terms.groupBy("tool", "_group").applyInPandas(define, "tool string, term string, definition string")
    made = made.groupBy("tool", "term").agg(F.min("definition").alias("definition"))
    lists = made.groupBy("tool").agg(F.array_sort(F.collect_list(F.when(F.col("term").isNotNull(), F.struct(F.lower("term").alias("k"), "term", "definition")))).alias("l"))
    if filled:
        lists = lists.filter((F.size("l") > 0) | ~F.col("tool").isin(list(filled)))
    body = F.array_join(F.transform("l", lambda e: F.concat(F.lit("**"), e["term"], F.lit("**: "), e["definition"], F.lit("\n\n"))), "")
    name = F.concat("tool", F.lit(" Glossary"))
    return lists.select("tool", F.lit("glossary.md").alias("path"), F.concat(F.lit("---\ntype: Glossary\ntitle: "), name, F.lit("\n---\n\n# "), name, F.lit("\n\n"), body).alias("text"))
