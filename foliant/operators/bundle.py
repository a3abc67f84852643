"""Generated files of a bundle: listings, the bundles listing, change log, glossary, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions import text as X
from foliant.functions import urls as U


def directory_tree(pages: DataFrame) -> DataFrame:
    """``(tool, dir, child, kind)``: the pages and subdirectories of every directory, each once.

    ``pages`` has tool and page_path; rows without a path are passed over. A page that is also a directory stands
    there as both. The root is the empty directory.
    """
    rows = pages.filter(F.coalesce("page_path", F.lit("")) != "").select("tool", F.split("page_path", "/", -1).alias("p"))
    n = F.size("p")
    steps = rows.select("tool", "p", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    each = steps.select("tool", F.array_join(F.slice("p", 1, F.col("i")), "/").alias("dir"), F.get("p", F.col("i")).alias("child"), F.when(F.col("i") == F.size("p") - 1, "page").otherwise("dir").alias("kind"))
    return each.distinct()


def listing_lines(pages: DataFrame) -> DataFrame:
    """``(tool, dir, line_no, line)``: the lines of every directory's ``index.md``, pages before subdirectories.

    ``pages`` has tool, page_path, title, description (of several rows of a path the greatest title and description
    count); a missing title is the file's name. A tool without any page still has a root through ``tools`` rows.
    """
    tree = directory_tree(pages)
    known = pages.groupBy(F.col("tool").alias("k_tool"), F.col("page_path").alias("k_path")).agg(F.max("title").alias("title"), F.max("description").alias("description"))
    full = F.when(F.col("dir") == "", F.col("child")).otherwise(F.concat_ws("/", "dir", "child"))
    items = tree.join(known, (F.col("tool") == F.col("k_tool")) & (full == F.col("k_path")) & (F.col("kind") == "page"), "left")
    title = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("child"))
    page = F.concat(F.lit("- ["), title, F.lit("](./"), F.col("child"), F.lit(".md) - "), F.coalesce("description", F.lit("")))
    sub = F.concat(F.lit("- ["), X.directory_title(F.col("child"), F.lit("")), F.lit("](./"), F.col("child"), F.lit("/) - "))
    lines = items.select("tool", "dir", F.when(F.col("kind") == "page", 0).otherwise(1).alias("o"), "child", F.when(F.col("kind") == "page", page).otherwise(sub).alias("line"))
    heads = tree.select("tool", "dir").distinct()
    head = heads.select("tool", "dir", F.lit(-1).alias("o"), F.lit("").alias("child"), F.concat(F.lit("# "), X.directory_title(F.col("dir"), F.col("tool"))).alias("line"))
    every = head.unionByName(lines)
    number = F.row_number().over(Window.partitionBy("tool", "dir").orderBy("o", "child"))
    return every.select("tool", "dir", number.alias("line_no"), "line")


def listing_files(pages: DataFrame) -> DataFrame:
    """``(tool, path, text)`` of the listings; the bundle's root carries the format's version in its frontmatter."""
    rows = listing_lines(pages).groupBy("tool", "dir").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    lines = F.transform("l", lambda x: x["line"])
    text = F.concat(F.get(lines, F.lit(0)), F.lit("\n\n"), F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "\n"), F.lit("\n"))
    front = F.when(F.col("dir") == "", '---\nokf_version: "0.1"\n---\n\n').otherwise("")
    path = F.when(F.col("dir") == "", "index.md").otherwise(F.concat("dir", F.lit("/index.md")))
    return rows.select("tool", path.alias("path"), F.concat(front, text).alias("text"))


def merged_tools(current: DataFrame, update: DataFrame) -> DataFrame:
    """The bundles listing (tool, entry_url) with ``update`` laid over it; a tool stands once."""
    new = update.groupBy("tool").agg(F.max("entry_url").alias("entry_url"))
    return current.select("tool", "entry_url").join(new, "tool", "left_anti").unionByName(new.select("tool", "entry_url"))


def tools_lines(tools: DataFrame) -> DataFrame:
    return tools.select("tool", F.concat(F.lit("- ["), F.col("tool"), F.lit("](./"), F.col("tool"), F.lit("/) - "), F.coalesce("entry_url", F.lit(""))).alias("line"))


def log_lines(result: DataFrame) -> DataFrame:
    """``(tool, day, seq, line)`` of a run: creations before updates, each in the order of the crawl.

    ``result`` has tool, page_path, title, status, seq, day.
    """
    kind = F.when(F.col("status") == "fetched", "Creation").when(F.col("status") == "updated", "Update")
    label = F.concat(F.lit("["), F.coalesce(F.when(F.col("title") != "", F.col("title")), X.base_name(F.col("page_path"))), F.lit("](./"), F.col("page_path"), F.lit(".md)"))
    rows = result.filter(kind.isNotNull()).withColumn("kind", kind)
    number = F.row_number().over(Window.partitionBy("tool", "day").orderBy("kind", "seq"))
    return rows.select("tool", "day", number.alias("seq"), F.concat(F.lit("* **"), F.col("kind"), F.lit("**: "), label).alias("line"))


def merged_log(log: DataFrame, new: DataFrame) -> DataFrame:
    """A log (tool, section, day, seq, line) with a run's lines (tool, day, seq, line) laid in.

    Lines go at the end of their day's section unless it has them; a day without one gets a new section before all
    others, whatever its date. New lines aren't held against each other.
    """
    here = log.select(F.col("tool").alias("h_tool"), F.col("day").alias("h_day"), F.trim("line").alias("h_line"))
    fresh = new.join(here, (F.col("tool") == F.col("h_tool")) & (F.col("day") == F.col("h_day")) & (F.trim("line") == F.col("h_line")), "left_anti")
    ends = log.groupBy("tool", "day").agg(F.max("section").alias("section"), F.max("seq").alias("last"))
    tops = log.groupBy("tool").agg(F.max("section").alias("top"))
    placed = fresh.join(ends, ["tool", "day"], "left").join(tops, "tool", "left")
    rows = placed.select("tool", F.coalesce("section", F.coalesce("top", F.lit(0)) + 1).alias("section"), "day", (F.coalesce("last", F.lit(0)) + F.col("seq")).alias("seq"), "line")
    return log.select("tool", "section", "day", "seq", "line").unionByName(rows)


def log_files(log: DataFrame) -> DataFrame:
    """``(tool, path, text)`` of a log, newest section first."""
    sections = log.groupBy("tool", "section", "day").agg(F.sort_array(F.collect_list(F.struct("seq", "line"))).alias("l"))
    text = F.concat(F.lit("## "), F.date_format("day", "yyyy-MM-dd"), F.lit("\n\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    whole = sections.groupBy("tool").agg(F.sort_array(F.collect_list(F.struct((-F.col("section")).alias("o"), text.alias("t")))).alias("s"))
    return whole.select("tool", F.lit("log.md").alias("path"), F.concat(F.lit("# Update Log\n\n"), F.array_join(F.transform("s", lambda x: x["t"]), "\n\n"), F.lit("\n")).alias("text"))


def glossary_terms(candidates: DataFrame) -> DataFrame:
    """``(tool, seq, term)``: candidate terms (tool, seq, term) trimmed, without empty ones, the first spelling of each.

    Case is no difference; ties of seq go to the lesser spelling. A frequent term is combined before the shuffle.
    """
    term = X.stripped(F.col("term"))
    rows = candidates.select("tool", "seq", term.alias("term")).filter("term <> ''")
    return rows.groupBy("tool", F.lower("term").alias("k")).agg(F.min(F.struct("seq", "term")).alias("f")).select("tool", "f.seq", "f.term")


def keyword_candidates(concepts: DataFrame) -> DataFrame:
    """``(tool, page_path, pos, term)``: the keywords of concepts that aren't generated files, not deduplicated."""
    each = concepts.filter(~X.is_reserved(F.col("page_path"))).select("tool", "page_path", F.posexplode("keywords").alias("pos", "term"))
    return each.withColumn("term", X.stripped(F.col("term"))).filter("term <> ''")


def top_candidates(candidates: DataFrame, most: int = 20) -> DataFrame:
    """The first ``most`` distinct terms in code-point order."""
    return candidates.select("term").distinct().orderBy("term").limit(most)


def directory_batches(pages: DataFrame, size: int = 15) -> DataFrame:
    """``(tool, dir, batch_no, pos, seq, url)``: urls of one directory in batches of at most ``size``, by seq."""
    rows = pages.select("tool", "seq", "url", U.parent_directory(F.col("url")).alias("dir"))
    at = F.row_number().over(Window.partitionBy("tool", "dir").orderBy("seq", "url")) - 1
    return rows.withColumn("n", at).select("tool", "dir", F.floor(F.col("n") / size).alias("batch_no"), (F.col("n") % size).alias("pos"), "seq", "url")


def path_collisions(pages: DataFrame) -> DataFrame:
    """``(tool, page_path, urls)``: page paths that more than one url falls on."""
    urls = pages.select("tool", "page_path", "url").distinct()
    return urls.groupBy("tool", "page_path").agg(F.count(F.lit(1)).alias("urls")).filter("urls > 1")


def latest_page(pages: DataFrame) -> DataFrame:
    """The row of each page path with the greatest seq, then url; other rows were overwritten."""
    best = pages.groupBy("tool", "page_path").agg(F.max(F.struct(*["seq", "url", *[c for c in pages.columns if c not in ("tool", "page_path", "seq", "url")]])).alias("w"))
    return best.select("tool", "page_path", "w.*")


def status_tally(result: DataFrame) -> DataFrame:
    return result.groupBy("status").agg(F.count(F.lit(1)).alias("pages"), F.min("seq").alias("first_seq"))


def progress_milestones(result: DataFrame, by: tuple[str, ...] = ("tool",)) -> DataFrame:
    """``(tool, done, total)``: after how many pages of a tool a progress line is due, every tenth at most."""
    sizes = result.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    step = X.milestone_step(F.col("total"))
    return sizes.select(*by, F.explode(F.sequence(step, F.col("total").cast("int"), step)).alias("done"), "total").select(*by, F.col("done").cast("long").alias("done"), "total")


def progress_lines(result: DataFrame) -> DataFrame:
    """``(tool, done, total, line)``: a tool's progress at each milestone and at its end, with its statuses so far.

    Pages are numbered by seq; counts are taken between milestones and then summed up over the few milestones.
    """
    last = result.groupBy("tool").agg(F.count(F.lit(1)).alias("done")).select("tool", "done", F.col("done").alias("total"))
    due = progress_milestones(result).unionByName(last).distinct()
    at = F.row_number().over(Window.partitionBy("tool").orderBy("seq", "url"))
    sizes = last.select("tool", "total")
    step = X.milestone_step(F.col("total"))
    placed = result.select("tool", "status", at.alias("at")).join(sizes, "tool").select("tool", "status", F.least(F.ceil(F.col("at") / step) * step, F.col("total")).alias("done"))
    counts = placed.groupBy("tool", "status", "done").agg(F.count(F.lit(1)).alias("n"))
    names = counts.groupBy("tool", "status").agg(F.min("done").alias("first"))
    grid = due.join(names, "tool").join(counts, ["tool", "status", "done"], "left")
    grid = grid.withColumn("so_far", F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("tool", "status").orderBy("done")))
    lines = grid.filter("so_far > 0").groupBy("tool", "done", "total").agg(F.sort_array(F.collect_list(F.struct("first", "status", "so_far"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: F.concat(x["so_far"].cast("string"), F.lit(" "), x["status"])), ", ")
    return lines.select("tool", "done", "total", F.format_string("  [%d/%d] %s", "done", "total", text).alias("line"))


def summary_totals(summaries: DataFrame) -> DataFrame:
    """``(tool, done, failed, candidates)``: pages summarised and failed, and all candidate terms by page path."""
    done = F.count(F.when(F.col("status") == "summarized", 1))
    failed = F.count(F.when(F.col("status") == "FAILED", 1))
    terms = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("candidates").isNotNull(), F.struct("page_path", "candidates")))), lambda x: x["candidates"]))
    return summaries.groupBy("tool").agg(done.alias("done"), failed.alias("failed"), terms.alias("candidates"))


def log_rows(files: DataFrame) -> DataFrame:
    """``(tool, section, day, seq, line)`` of log files (tool, text): the oldest section is number 1. Sections whose heading is no date are not read."""
    parts = files.select("tool", F.split("text", r"(?m)^## ", -1).alias("p"))
    each = parts.select("tool", F.size("p").alias("n"), F.posexplode("p").alias("at", "x")).filter("at > 0")
    rows = each.select("tool", (F.col("n") - F.col("at")).alias("section"), F.expr("try_cast(substring(x, 1, 10) as date)").alias("day"), F.posexplode(F.filter(F.split("x", "\n", -1), lambda y: F.startswith(y, F.lit("* ")))).alias("seq", "line"))
    return rows.filter("day is not null").select("tool", "section", "day", (F.col("seq") + 1).alias("seq"), "line")
