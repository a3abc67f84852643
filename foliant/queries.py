"""Queries on the core operators, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions import text as X
from foliant.functions import urls as U
from foliant.operators import bundle, conformance, crawl
from foliant.operators.snapshots import clean_hash, snapshot_changes
from foliant.plans.pages import concepts, link_targets, pages_table, parsed_pages
from foliant.plans.summaries import summarised
from foliant.sources import files
from foliant.sources.frontmatter import with_frontmatter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL where there is one."""

    def put(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return put


@query(
    "p1_found",
    """
with r as (
  select tool, snapshot_no, regexp_replace(page_path, '^[\\s/]+|[\\s/]+$', '', 'g') as page_path,
         nullif(regexp_replace(lower(trim(content_hash)), '^sha256:', ''), '') as h,
         try_cast(fetched_at as timestamptz) as fetched
  from manifest),
w as (
  select tool, snapshot_no, page_path, h from r
  qualify row_number() over (partition by tool, snapshot_no, page_path order by fetched desc nulls last, h desc nulls last) = 1),
s as (
  select tool, snapshot_no, lag(snapshot_no) over o as prev, lead(snapshot_no) over o as next
  from (select distinct tool, snapshot_no from r) window o as (partition by tool order by snapshot_no))
select c.tool, c.snapshot_no, c.page_path, case when p.tool is null then 'added' else 'changed' end as change_kind
from w c join s using (tool, snapshot_no)
left join w p on p.tool = c.tool and p.snapshot_no = s.prev and p.page_path = c.page_path
where s.prev is not null and (p.tool is null or p.h is distinct from c.h)
union all
select p.tool, s.next, p.page_path, 'removed'
from w p join s using (tool, snapshot_no)
left join w c on c.tool = p.tool and c.snapshot_no = s.next and c.page_path = p.page_path
where s.next is not null and c.tool is null
""",
)
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot_changes(table(spark, folder, "manifest"))


# Queries on the reference's own operators

_URI = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_LABELS = "('www', 'docs', 'api', 'developer', 'developers', 'help', 'support')"


def _rx(url: str, group: int) -> str:
    return f"regexp_extract({url}, '{_URI}', {group})"


def _path(url: str) -> str:
    return f"regexp_replace({_rx(url, 3)}, ';[^/]*$', '')"


def _own_path(url: str) -> str:
    return f"coalesce(nullif(trim({_path(url)}, '/'), ''), '_root')"


def _tool(url: str) -> str:
    parts = f"string_split({_rx(url, 2)}, '.')"
    k = f"coalesce(list_position(list_transform({parts}, lambda x: x not in {_LABELS}), true), 0)"
    return f"{parts}[1 + least(greatest(len({parts}) - 2, 0), case when {k} = 0 then len({parts}) else {k} - 1 end)]"


def _parent(url: str) -> str:
    parts = f"list_filter(string_split({_path(url)}, '/'), lambda x: x <> '' and x <> '.')"
    up = f"array_to_string({parts}[1:greatest(len({parts}) - 1, 0)], '/')"
    return f"case when starts_with({_path(url)}, '/') then '/' || {up} when {up} = '' then '.' else {up} end"


_URLS = "(select distinct url from manifest union select distinct resource from concepts)"


def _urls(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "manifest").select("url").union(table(spark, folder, "concepts").select("resource")).distinct()


@query("url_parts", f"select url, lower({_rx('url', 1)}) as scheme, {_rx('url', 2)} as netloc, {_path('url')} as path, {_rx('url', 4)} as query, {_rx('url', 5)} as fragment from {_URLS}")
def url_parts(spark: SparkSession, folder: str) -> DataFrame:
    return _urls(spark, folder).select("url", U.url_parts(F.col("url")).alias("p")).select("url", "p.*")


@query("tool_name", f"select url, {_tool('url')} as tool from {_URLS}")
def tool_name(spark: SparkSession, folder: str) -> DataFrame:
    return _urls(spark, folder).select("url", U.tool_name(F.col("url")).alias("tool"))


@query("page_path", f"select url, {_own_path('url')} as page_path, {_parent('url')} as parent from {_URLS}")
def page_path(spark: SparkSession, folder: str) -> DataFrame:
    return _urls(spark, folder).select("url", U.page_path(F.col("url")).alias("page_path"), U.parent_directory(F.col("url")).alias("parent"))


_SCOPES = f"(select tool, {_rx('entry_url', 2)} as netloc, coalesce(nullif(rtrim({_path('entry_url')}, '/'), ''), '/') as prefix from tools_map)"


@query("crawl_scope", f"select * from {_SCOPES}")
def crawl_scope(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "tools_map").select("tool", U.netloc(F.col("entry_url")).alias("netloc"), U.scope_prefix(F.col("entry_url")).alias("prefix"))


@query(
    "scope_filter",
    f"select m.tool, m.url from (select distinct tool, url from manifest) m join {_SCOPES} s using (tool) "
    f"where {_rx('m.url', 2)} = s.netloc and (s.prefix = '/' or coalesce(nullif({_path('m.url')}, ''), '/') = s.prefix or starts_with({_path('m.url')}, s.prefix || '/'))",
)
def scope_filter(spark: SparkSession, folder: str) -> DataFrame:
    urls = table(spark, folder, "manifest").select("tool", "url").distinct()
    return urls.join(crawl_scope(spark, folder), "tool").filter(U.in_scope(F.col("url"), F.col("netloc"), F.col("prefix"))).select("tool", "url")


@query("content_hashes", "select concept_id, sha256(content) as content_hash from (select distinct concept_id, content from concepts)")
def content_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "concepts").select("concept_id", X.content_hash(F.col("content")).alias("content_hash")).distinct()


#: The derived links: each page of a tool to the next one by url, written from the root, with a query and a fragment.
_LINKS = f"(select tool, url, lead(url) over (partition by tool order by url) as next from (select distinct tool, url from manifest))"


@query(
    "links_resolved",
    f"select url, href, {_rx('url', 1)} || '://' || {_rx('url', 2)} || href as resolved, regexp_replace({_rx('url', 1)} || '://' || {_rx('url', 2)} || href, '[?#].*$', '') as normalized "
    f"from (select url, {_rx('next', 3)} || '?ref=nav#top' as href from {_LINKS} where next is not null)",
)
def links_resolved(spark: SparkSession, folder: str) -> DataFrame:
    out = _links(spark, folder).withColumn("resolved", U.resolve(F.col("url"), F.col("href")))
    return out.select("url", "href", "resolved", U.normalized(F.col("resolved")).alias("normalized"))


def _links(spark: SparkSession, folder: str) -> DataFrame:
    urls = table(spark, folder, "manifest").select("tool", "url").distinct()
    nxt = F.lead("url").over(Window.partitionBy("tool").orderBy("url"))
    return urls.withColumn("next", nxt).filter("next is not null").select("tool", "url", F.concat(U.raw_path(F.col("next")), F.lit("?ref=nav#top")).alias("href"))


_REL = """(select u, t, r, list_filter(string_split(u, '/'), lambda x, i: i < len(string_split(u, '/'))) as c, string_split(t || '.md', '/') as f, m.url is not null as hit
  from (select tool, {own} as u, {to} as t, {scheme} || '://' || {host} || {raw} as r from {links} where next is not null) l
  left join (select distinct tool, url from manifest) m on m.tool = l.tool and m.url = l.r)""".format(
    own=_own_path("url"), to=_own_path("next"), links=_LINKS, scheme=_rx("url", 1), host=_rx("url", 2), raw=_rx("next", 3)
)


@query(
    "link_rewrite",
    f"select distinct u as page_path, t as target, case when hit then repeat('../', cast(len(c) - k as integer)) || array_to_string(f[k + 1:], '/') || '#top' else r || '?ref=nav#top' end as link from (select u, t, r, c, f, hit, "
    f"coalesce(list_max(list_filter(range(1, least(len(c), len(f) - 1) + 1), lambda n: c[1:n] = f[1:n])), 0) as k from {_REL})",
)
def link_rewrite(spark: SparkSession, folder: str) -> DataFrame:
    pages = _links(spark, folder).select(F.monotonically_increasing_id().alias("seq"), "tool", "url", U.page_path(F.col("url")).alias("page_path"), F.array("href").alias("body_hrefs"))
    known = table(spark, folder, "manifest").select("tool", "url", U.page_path(F.col("url")).alias("page_path"))
    made = link_targets(pages, known).filter("at = 0").join(pages.select("tool", "url", "page_path", F.col("body_hrefs")[0].alias("href")), ["tool", "url"])
    return made.select("page_path", U.page_path(U.resolve(F.col("url"), F.col("href"))).alias("target"), "link").distinct()


_PAGES = f"(select tool, {_own_path('url')} as page_path, url, max(seq) as seq from manifest group by tool, url)"


def _manifest_pages(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "manifest").groupBy("tool", "url").agg(F.max("seq").alias("seq"))
    return m.select("tool", U.page_path(F.col("url")).alias("page_path"), "url", "seq")


@query("path_collisions", f"select tool, page_path, count(distinct url) as urls from {_PAGES} group by all having count(distinct url) > 1")
def path_collisions(spark: SparkSession, folder: str) -> DataFrame:
    return bundle.path_collisions(_manifest_pages(spark, folder))


@query("latest_page", f"select tool, page_path, seq, url from {_PAGES} qualify row_number() over (partition by tool, page_path order by seq desc, url desc) = 1")
def latest_page(spark: SparkSession, folder: str) -> DataFrame:
    return bundle.latest_page(_manifest_pages(spark, folder))


@query(
    "directory_batches",
    f"select tool, dir, cast(floor(n / 15) as bigint) as batch_no, cast(n % 15 as bigint) as pos, seq, url from (select tool, {_parent('url')} as dir, seq, url, row_number() over (partition by tool, {_parent('url')} order by seq, url) - 1 as n from {_PAGES})",
)
def directory_batches(spark: SparkSession, folder: str) -> DataFrame:
    out = bundle.directory_batches(_manifest_pages(spark, folder))
    return out.withColumn("pos", F.col("pos").cast("long"))


_CONCEPTS = "(select distinct coalesce(tool, '') as tool, page_path, title, description from concepts where page_path <> '')"
_TREE = "(select distinct tool, array_to_string(p[1:i], '/') as dir, p[i + 1] as child, case when i = len(p) - 1 then 'page' else 'dir' end as kind from (select tool, p, unnest(range(0, len(p))) as i from (select tool, string_split(page_path, '/') as p from {c})))".format(
    c=_CONCEPTS
)


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "concepts").filter("page_path <> ''")
    return c.select(F.coalesce("tool", F.lit("")).alias("tool"), "page_path", "title", "description").distinct()


@query("dir_tree", f"select * from {_TREE}")
def dir_tree(spark: SparkSession, folder: str) -> DataFrame:
    return bundle.directory_tree(_listed(spark, folder))


#: str.title() over letters: the documents' segments are ASCII words.
_TITLED = "array_to_string(list_transform(regexp_extract_all(translate({x}, '-_', '  '), '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1]) || lower(w[2:])), '')"


@query(
    "listing_lines",
    f"""
with t as (select * from {_TREE}),
k as (select tool, page_path, max(title) as title, max(description) as description from {_CONCEPTS} group by all),
l as (
  select t.tool, t.dir, case when kind = 'page' then 0 else 1 end as o, child,
    case when kind = 'page' then '- [' || coalesce(nullif(k.title, ''), child) || '](./' || child || '.md) - ' || coalesce(k.description, '')
         else '- [' || {_TITLED.format(x='child')} || '](./' || child || '/) - ' end as line
  from t left join k on kind = 'page' and k.tool = t.tool and k.page_path = case when t.dir = '' then child else t.dir || '/' || child end
  union all
  select distinct tool, dir, -1, '', '# ' || case when dir = '' then tool else {_TITLED.format(x="string_split(dir, '/')[-1]")} end from t)
select tool, dir, cast(row_number() over (partition by tool, dir order by o, child) as integer) as line_no, line from l
""",
)
def listing_lines(spark: SparkSession, folder: str) -> DataFrame:
    return bundle.listing_lines(_listed(spark, folder))


_HASH = "nullif(regexp_replace(lower(trim(content_hash)), '^sha256:', ''), '')"
#: Each delivered snapshot of a tool as a run of its own, named tool#snapshot, against the one delivered before it.
_RUNS = f"(select tool, snapshot_no, url, max(seq) as seq, max(page_path) as page_path, max({_HASH}) as h, max(error) as error from manifest group by tool, snapshot_no, url)"
_ORDER = "(select tool, snapshot_no, lag(snapshot_no) over (partition by tool order by snapshot_no) as prev, lead(snapshot_no) over (partition by tool order by snapshot_no) as next from (select distinct tool, snapshot_no from manifest))"
_STATUS = f"""(select n.tool || '#' || n.snapshot_no as tool, n.url, n.seq, n.page_path, case when n.error is not null then 'FAILED' when n.h = p.h then 'skipped' when p.url is not null then 'updated' else 'fetched' end as status
  from {_RUNS} n join {_ORDER} o using (tool, snapshot_no) left join {_RUNS} p on p.tool = n.tool and p.snapshot_no = o.prev and p.url = n.url)"""


def _order(m: DataFrame) -> DataFrame:
    line = Window.partitionBy("tool").orderBy("snapshot_no")  # a row for each snapshot of a tool
    return m.select("tool", "snapshot_no").distinct().select("tool", "snapshot_no", F.lead("snapshot_no").over(line).alias("next"))


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "manifest")
    runs = m.groupBy("tool", "snapshot_no", "url").agg(F.max("seq").alias("seq"), F.max("page_path").alias("page_path"), F.max(clean_hash(F.col("content_hash"))).alias("content_hash"), F.max("error").alias("error"))
    return runs.join(_order(m), ["tool", "snapshot_no"])


def _status(spark: SparkSession, folder: str) -> DataFrame:
    runs = _runs(spark, folder)
    name = lambda c: F.concat("tool", F.lit("#"), F.col(c).cast("string"))
    prior = runs.filter("next is not null").withColumn("tool", name("next"))
    return crawl.crawl_status(runs.withColumn("tool", name("snapshot_no")).withColumn("http_status", F.lit(None).cast("int")), prior)


@query("crawl_status", f"select tool, url, seq, status from {_STATUS}")
def crawl_status(spark: SparkSession, folder: str) -> DataFrame:
    return _status(spark, folder).select("tool", "url", "seq", "status")


@query("status_tally", f"select status, count(*) as pages, min(seq) as first_seq from {_STATUS} group by status")
def status_tally(spark: SparkSession, folder: str) -> DataFrame:
    return bundle.status_tally(_status(spark, folder))


@query(
    "log_lines",
    f"""select tool, cast(row_number() over (partition by tool order by status = 'updated', seq) as integer) as seq,
    '* **' || case when status = 'fetched' then 'Creation' else 'Update' end || '**: [' || string_split(page_path, '/')[-1] || '](./' || page_path || '.md)' as line
    from {_STATUS} where status in ('fetched', 'updated')""",
)
def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = _status(spark, folder).withColumn("title", F.lit(None).cast("string")).withColumn("day", F.lit("2025-01-01").cast("date"))
    return bundle.log_lines(rows).select("tool", "seq", "line")


@query("progress_milestones", f"select tool, cast(unnest(range(s, n + 1, s)) as bigint) as done, n as total from (select tool, count(*) as n, greatest(1, cast(floor(count(*) / 10) as bigint)) as s from {_STATUS} group by tool)")
def progress_milestones(spark: SparkSession, folder: str) -> DataFrame:
    return bundle.progress_milestones(_status(spark, folder))


@query("tools_map", "select tool, '- [' || tool || '](./' || tool || '/) - ' || entry_url as line from (select tool, entry_url from tools_map union all select tool, max(url) from manifest where tool not in (select tool from tools_map) group by tool)")
def tools_map(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "manifest").groupBy("tool").agg(F.max("url").alias("entry_url"))
    return bundle.tools_lines(bundle.merged_tools(found, table(spark, folder, "tools_map")))


_TRIM = "regexp_replace(term, '^[\\s\\x{00a0}]+|[\\s\\x{00a0}]+$', '', 'g')"


@query("glossary_terms", f"select tool, seq, t as term from (select tool, seq, {_TRIM} as t from terms) where t <> '' qualify row_number() over (partition by tool, lower(t) order by seq, t) = 1")
def glossary_terms(spark: SparkSession, folder: str) -> DataFrame:
    return bundle.glossary_terms(table(spark, folder, "terms"))


@query("top_candidates", f"select distinct {_TRIM} as term from terms where {_TRIM} <> '' order by term limit 20")
def top_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return bundle.top_candidates(bundle.glossary_terms(table(spark, folder, "terms")).unionByName(table(spark, folder, "terms").select("tool", "seq", F.trim("term").alias("term")).filter("term <> ''")))


@query("bfs_depth", f"select tool || ':' || dir as url, cast(case when dir = '' then 0 else len(string_split(dir, '/')) end as integer) as depth from (select distinct tool, dir from {_TREE})")
def bfs_depth(spark: SparkSession, folder: str) -> DataFrame:
    dirs = bundle.directory_tree(_listed(spark, folder)).filter("kind = 'dir'")
    name = lambda d: F.concat("tool", F.lit(":"), d)
    edges = dirs.select(name(F.col("dir")).alias("src"), F.lit(0).alias("pos"), name(F.when(F.col("dir") == "", F.col("child")).otherwise(F.concat_ws("/", "dir", "child"))).alias("dst")).distinct()
    roots = _listed(spark, folder).select(name(F.lit("")).alias("url")).distinct()
    return crawl.discover(edges, roots).select("url", "depth")


#: Concept files with what the concepts have of a header: those without title or description break rules.
#: Beside them files that break the other rules: pages without a header, listings with one, logs without a date.
_FILES = """(select tool, page_path || '.md' as path, '---' || chr(10) || 'type: ' || coalesce(concept_type, '') || chr(10) || coalesce('title: ' || replace(title, chr(10), ' ') || chr(10), '')
  || coalesce('description: ' || replace(description, chr(10), ' ') || chr(10), '') || '---' || chr(10) as text from {c}
  union all select distinct tool, page_path || '-plain.md', coalesce(title, '') from {c} where description is null
  union all select distinct tool, page_path || '/index.md', case when length(page_path) % 2 = 0 then '---' || chr(10) || 'a: b' || chr(10) || '---' || chr(10) else '# A' || chr(10) end from {c}
  union all select distinct tool, 'log.md', '# Update Log' || chr(10) || case when length(tool) % 2 = 0 then '' else '## 2025-01-01' || chr(10) end from {c})""".format(
    c="(select distinct coalesce(tool, '') as tool, page_path, concept_type, title, description from concepts)"
)
_HAS = "len(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '{}:'))) > 0"
_TYPE = "nullif(trim(regexp_extract(text, 'type:([^\\n]*)', 1)), '')"
_OPENED = "(text = '---' or starts_with(text, '---' || chr(10)))"
_OWN_FILE = "string_split(path, '/')[-1] not in ('index.md', 'glossary.md', 'log.md')"
_FINDINGS = f"""(select tool, path, unnest(list_filter([case when string_split(path, '/')[-1] = 'index.md' and path <> 'index.md' and {_OPENED} then 'E3' end,
  case when string_split(path, '/')[-1] = 'log.md' and text <> '' and not regexp_matches(text, '(^|\\n)## [0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then 'WLOG' end,
  case when {_OWN_FILE} and not {_OPENED} then 'E1' end,
  case when {_OWN_FILE} and {_OPENED} and {_TYPE} is null then 'E2' end,
  case when {_OWN_FILE} and {_OPENED} and {_TYPE} is not null and not {_HAS.format('title')} then 'W1-title' end,
  case when {_OWN_FILE} and {_OPENED} and {_TYPE} is not null and not {_HAS.format('description')} then 'W1-description' end], lambda x: x is not null)) as rule
  from {_FILES})"""


def _files(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "concepts").select(F.coalesce("tool", F.lit("")).alias("tool"), "page_path", "concept_type", "title", "description").distinct()
    line = lambda k: F.coalesce(F.concat(F.lit(f"{k}: "), F.translate(k, "\n", " "), F.lit("\n")), F.lit(""))
    text = F.concat(F.lit("---\ntype: "), F.coalesce("concept_type", F.lit("")), F.lit("\n"), line("title"), line("description"), F.lit("---\n"))
    own = c.select("tool", F.concat("page_path", F.lit(".md")).alias("path"), text.alias("text"))
    plain = c.filter("description is null").select("tool", F.concat("page_path", F.lit("-plain.md")), F.coalesce("title", F.lit(""))).distinct()
    listing = c.select("tool", F.concat("page_path", F.lit("/index.md")), F.when(F.length("page_path") % 2 == 0, "---\na: b\n---\n").otherwise("# A\n")).distinct()
    log = c.select("tool", F.lit("log.md"), F.when(F.length("tool") % 2 == 0, "# Update Log\n").otherwise("# Update Log\n## 2025-01-01\n")).distinct()
    return own.union(plain).union(listing).union(log)


@query("conformance_findings", f"select tool, path, rule, case when starts_with(rule, 'E') then 'error' else 'warning' end as severity from {_FINDINGS}")
def conformance_findings(spark: SparkSession, folder: str) -> DataFrame:
    return conformance.findings(_files(spark, folder))


@query(
    "conformance_summary",
    f"""select f.tool, f.files, coalesce(r.errors, 0) as errors, coalesce(r.warnings, 0) as warnings from (select tool, count(*) as files from {_FILES} group by tool) f
    left join (select tool, cast(sum(cast(starts_with(rule, 'E') as integer)) as bigint) as errors, cast(sum(cast(starts_with(rule, 'W') as integer)) as bigint) as warnings from {_FINDINGS} group by tool) r using (tool)""",
)
def conformance_summary(spark: SparkSession, folder: str) -> DataFrame:
    return conformance.summary(_files(spark, folder))


@query("keyword_candidates", "select tool, page_path, cast(p - 1 as integer) as pos, keywords[p] as term from (select tool, page_path, keywords, unnest(range(1, len(keywords) + 1)) as p from concepts where string_split(page_path, '/')[-1] not in ('index', 'glossary', 'log')) where trim(keywords[p]) <> ''")
def keyword_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return bundle.keyword_candidates(table(spark, folder, "concepts"))


def raw_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Concepts as the pages they could come from: a menu, the title, a paragraph or heading for each line, links."""
    c = table(spark, folder, "concepts").select("concept_id", "resource", "title", "content").filter("resource is not null").dropDuplicates(["concept_id"])
    lines = F.transform(F.split(F.coalesce("content", F.lit("")), "\n", -1), lambda x: F.when(F.startswith(x, F.lit("## ")), F.concat(F.lit("<h2>"), F.substring(x, 4, 1 << 30), F.lit("</h2>"))).otherwise(F.concat(F.lit("<p>"), x, F.lit("</p>"))))
    head = F.concat(F.lit("<html><head><title>"), F.coalesce("title", F.lit("")), F.lit("</title></head><body><nav><h3>Docs</h3><a href='"), "resource", F.lit("'>"), F.coalesce("title", F.lit("")), F.lit("</a></nav><main><h1>"), F.coalesce("title", F.lit("")), F.lit("</h1><pre class='language-bash'>run</pre><a href='../'>up</a>"))
    return c.select(F.col("concept_id").alias("seq"), F.col("resource").alias("url"), F.concat(head, F.array_join(lines, ""), F.lit("</main><footer>end</footer></body></html>")).alias("html"))


@query("parsed_concepts")
def parsed_concepts(spark: SparkSession, folder: str) -> DataFrame:
    pages = pages_table(raw_pages(spark, folder))
    return concepts(pages, pages, "2025-01-01T00:00:00+00:00")


@query("page_links")
def page_links(spark: SparkSession, folder: str) -> DataFrame:
    from foliant.plans.pages import page_links as links

    return links(parsed_pages(pages_table(raw_pages(spark, folder))))


@query("render_candidates")
def render_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return parsed_pages(pages_table(raw_pages(spark, folder))).filter(X.below_threshold(F.col("body"))).select("tool", "page_path", "url")


@query("frontmatter_read")
def frontmatter_read(spark: SparkSession, folder: str) -> DataFrame:
    return with_frontmatter(_files(spark, folder)).select("tool", "path", "front.type", "front.title", "front.description")


_LATEST_ROW = """(select tool || '#' || snapshot_no as tool, url, seq, page_path, cache_path, fetched_at, etag, last_modified, content_hash, array_to_string(nav_path, '/') as nav_path, status, error from manifest
  qualify row_number() over (partition by tool, snapshot_no, url order by seq desc, entry_id desc) = 1)"""
_SENT = "case when status is distinct from 'errored' then {0} end as {0}"


@query(
    "manifest_json",
    f"""select tool, url, row_number() over (partition by tool order by seq, url) - 1 as seq, page_path, {', '.join(_SENT.format(c) for c in ('cache_path', 'fetched_at', 'etag', 'last_modified', 'content_hash', 'nav_path'))},
    case when status = 'errored' then status end as status, case when status = 'errored' then error end as error from {_LATEST_ROW}""",
)
def manifest_json(spark: SparkSession, folder: str) -> DataFrame:
    """Every snapshot of every tool as one JSON file, read again."""
    m = table(spark, folder, "manifest").withColumn("tool", F.concat("tool", F.lit("#"), F.col("snapshot_no").cast("string")))
    columns = [c for c in m.columns if c not in ("tool", "url", "snapshot_no")]
    one = m.groupBy("tool", "url").agg(F.max(F.struct("seq", "entry_id", *[c for c in columns if c not in ("seq", "entry_id")])).alias("w")).select("tool", "url", "w.*")
    place = F.row_number().over(Window.partitionBy("tool").orderBy("seq", "url"))  # a file's order
    rows = files.manifest_rows(files.manifest_json(one.withColumn("seq", place)))
    return rows.withColumn("nav_path", F.array_join("nav_path", "/"))


@query("robots_allowed", f"select url from {_URLS} where not starts_with({_path('url')}, '/docs/')")
def robots_allowed(spark: SparkSession, folder: str) -> DataFrame:
    return crawl.robots_allowed(_urls(spark, folder), "User-agent: *\nDisallow: /docs/\nAllow: /", "foliant")


_LATEST_RUN = f"(select r.* from {_RUNS} r join {_ORDER} o using (tool, snapshot_no) where o.next is null)"
_PROMPT = "Summarise this documentation page as JSON with summary, keywords and candidates.\nURL: "


@query(
    "summaries",
    f"""select tool, page_path, status, case when status = 'summarized' then cast({len(_PROMPT) + 2} + length(url) + least(6000, length(md)) as varchar) || ' characters' end as summary
    from (select m.tool, m.page_path, m.url, md, case when md is null then 'FAILED' when coalesce(description, '') <> '' and c_hash = m.h then 'skipped' else 'summarized' end as status
      from {_LATEST_RUN} m left join (select tool, page_path, max(description) as description, max({_HASH}) as c_hash, max(content) as md from concepts where tool is not null group by all) c using (tool, page_path)
      where coalesce(m.page_path, '') <> '')""",
)
def summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Of each tool's latest snapshot, with a provider that answers from the prompt alone, so that runs agree."""
    m = _runs(spark, folder).filter("next is null")
    c = table(spark, folder, "concepts").filter("tool is not null").groupBy("tool", "page_path").agg(F.max("description").alias("description"), F.max(clean_hash(F.col("content_hash"))).alias("content_hash"), F.max("content").alias("md"))
    return summarised(m, c, lambda prompt: '{"summary": "%d characters", "keywords": [], "candidates": []}' % len(prompt)).select("tool", "page_path", "status", "summary")


@query(
    "nav_labels",
    "select concept_id, array_to_string(list_filter(list_transform(nav_path, lambda x: trim(x)), lambda x: x <> ''), '/') as labels from (select distinct concept_id, nav_path from concepts where nav_path is not null)",
)
def nav_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Menus nested as each concept's labels say, beside a menu of other pages, and the labels read off them again."""
    c = table(spark, folder, "concepts").filter("nav_path is not null").select("concept_id", "nav_path").distinct()
    label = lambda x: F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    opened = F.array_join(F.transform("nav_path", lambda x: F.concat(F.lit("<h3>"), label(x), F.lit("</h3><div>"))), "")
    html = F.concat(F.lit("<nav><h4>Others</h4><p><a href='/other'>o</a></p></nav><nav>"), opened, F.lit("<p><a href='/own/'>this page</a></p>"), F.repeat(F.lit("</div>"), F.size("nav_path")), F.lit("</nav><main>x</main>"))
    pages = c.select("concept_id", F.lit("https://docs.example/own").alias("url"), html.alias("html"))
    return parsed_pages(pages).select("concept_id", F.array_join("nav_path", "/").alias("labels"))


_LINE = "'* **' || case when status = 'fetched' then 'Creation' else 'Update' end || '**: [' || string_split(page_path, '/')[-1] || '](./' || page_path || '.md)'"
_TWO_RUNS = f"""(select split_part(tool, '#', 1) as tool, cast(split_part(tool, '#', 2) as integer) as no, status, seq, {_LINE} as line from {_STATUS} where status in ('fetched', 'updated'))"""


def _two_runs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Log lines of each tool's last run but one and of its last; every second tool's lie on one day."""
    own = _status(spark, folder).filter(F.col("status").isin("fetched", "updated")).withColumn("run", F.split("tool", "#"))
    own = own.select(F.col("run")[0].alias("tool"), F.col("run")[1].cast("int").alias("snapshot_no"), "url", "seq", "page_path", "status", F.lit(None).cast("string").alias("title"))
    line = Window.partitionBy("tool").orderBy(F.desc("snapshot_no"))
    m = table(spark, folder, "manifest")
    back = m.select("tool", "snapshot_no").distinct().select("tool", "snapshot_no", F.row_number().over(line).alias("back"))
    rows = own.join(back, ["tool", "snapshot_no"])
    day = F.when((F.col("back") == 1) & (F.length("tool") % 2 == 0), "2025-01-02").otherwise("2025-01-01").cast("date")
    rows = rows.withColumn("day", day)
    return bundle.log_lines(rows.filter("back = 2")), bundle.log_lines(rows.filter("back = 1"))


@query(
    "log_after_run",
    f"""with o as (select tool, snapshot_no as no, row_number() over (partition by tool order by snapshot_no desc) as back from (select distinct tool, snapshot_no from manifest)),
r as (select t.tool, back, line, case when back = 1 and length(t.tool) % 2 = 0 then 2 else 1 end as day, row_number() over (partition by t.tool, back order by status = 'updated', t.seq) as seq from {_TWO_RUNS} t join o using (tool, no) where back <= 2),
old as (select tool, 1 as section, 1 as day, seq, line from r where back = 2),
fresh as (select n.* from r n left join old on old.tool = n.tool and old.day = n.day and trim(old.line) = trim(n.line) where n.back = 1 and old.line is null),
new as (select f.tool, case when e.last is not null then 1 when t.tool is not null then 2 else 1 end as section, f.day, coalesce(e.last, 0) + f.seq as seq, f.line from fresh f
  left join (select tool, day, max(seq) as last from old group by all) e on e.tool = f.tool and e.day = f.day left join (select distinct tool from old) t on t.tool = f.tool)
select tool, cast(section as integer) as section, cast(date '2024-12-31' + cast(day as integer) as varchar) as day, cast(seq as integer) as seq, line from (select * from old union all select * from new)""",
)
def log_after_run(spark: SparkSession, folder: str) -> DataFrame:
    old, new = _two_runs(spark, folder)
    return bundle.merged_log(old.withColumn("section", F.lit(1)), new).withColumn("day", F.col("day").cast("string"))


@query(
    "listing_after_run",
    f"""with m as (select tool, page_path from {_RUNS} where page_path <> ''), k as (select tool, page_path, max(title) as title, max(description) as description from {_CONCEPTS} group by all),
t as (select distinct tool, array_to_string(p[1:i], '/') as dir, p[i + 1] as child, case when i = len(p) - 1 then 'page' else 'dir' end as kind from (select tool, p, unnest(range(0, len(p))) as i from (select tool, string_split(page_path, '/') as p from m)))
select t.tool, t.dir, child, '- [' || coalesce(nullif(k.title, ''), child) || '](./' || child || '.md) - ' || coalesce(k.description, '') as line from t
left join k on k.tool = t.tool and k.page_path = case when t.dir = '' then child else t.dir || '/' || child end where kind = 'page'""",
)
def listing_after_run(spark: SparkSession, folder: str) -> DataFrame:
    """Page lines of the listings over all that any run has left in the manifests, with the titles of the concepts."""
    m = _runs(spark, folder).filter("page_path <> ''").select("tool", "page_path").distinct()
    pages = m.join(_listed(spark, folder), ["tool", "page_path"], "left")
    lines = bundle.listing_lines(pages).filter("line like '%.md) - %'")
    return lines.select("tool", "dir", F.regexp_extract("line", r"\]\(\./([^)]*)\.md\) - ", 1).alias("child"), "line")


@query(
    "progress_lines",
    f"""with s as (select tool, status, row_number() over (partition by tool order by seq, url) as pos from {_STATUS}),
n as (select tool, count(*) as total, greatest(1, cast(floor(count(*) / 10) as bigint)) as step from s group by tool),
d as (select distinct tool, done, total from (select tool, unnest(range(step, total + 1, step)) as done, total from n union all select tool, total, total from n)),
c as (select d.tool, done, total, status, count(*) as k, min(s.pos) as first_pos from d join s on s.tool = d.tool and s.pos <= d.done group by all)
select tool, done, total, '  [' || done || '/' || total || '] ' || string_agg(k || ' ' || status, ', ' order by status) as line from c group by tool, done, total""",
)
def progress_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = bundle.progress_lines(_status(spark, folder))
    parts = F.split(F.regexp_extract("line", r"\] (.*)$", 1), ", ")
    by_name = F.array_join(F.array_sort(parts, lambda a, b: F.when(F.substring_index(a, " ", -1) < F.substring_index(b, " ", -1), -1).otherwise(1)), ", ")
    return lines.select("tool", "done", "total", F.concat(F.regexp_extract("line", r"^(  \[\d+/\d+\] )", 1), by_name).alias("line"))
