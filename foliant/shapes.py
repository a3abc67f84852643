"""Queries that put pages, sitemaps, answers and files of known shape through the operators, so that SQL can say what must come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions import text as X
from foliant.functions.registry import register
from foliant.operators import bundle, crawl
from foliant.plans.pages import CLOSE, OPEN, filled, link_targets, page_links, parsed_pages
from foliant.plans.summaries import glossary, summarised
from foliant.queries import _STATUS, _TRIM, _own_path, _runs, _status, query, table
from foliant.sources.fetch import Response, fetch_pages
from foliant.sources.frontmatter import merged_text

_WORDS = "trim(regexp_replace(coalesce({}, ''), '[^A-Za-z0-9]+', ' ', 'g'))"
_IDS = f"(select distinct concept_id as id, {_WORDS.format('title')} as words from concepts)"
_URL = "https://docs.example/guide/page"


def _ids(spark: SparkSession, folder: str) -> DataFrame:
    words = F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), "[^A-Za-z0-9]+", " "))
    return table(spark, folder, "concepts").select(F.col("concept_id").alias("id"), words.alias("words")).distinct()


def _parsed(rows: DataFrame, html: Column) -> DataFrame:
    """``id, title, body`` of pages, with the body's links as they were written."""
    pages = rows.select("id", F.lit(_URL).alias("url"), html.alias("html"))
    body = F.regexp_replace("body", f"{OPEN}[0-9]+{CLOSE}", "")
    return parsed_pages(pages).select("id", "title", body.alias("body"))


def _by(column: str, of: int, values: list) -> Column:
    out = F.when(F.col(column) % of == 0, values[0])
    for k in range(1, of):
        out = out.when(F.col(column) % of == k, values[k])
    return out


@query("page_shapes", f"select id, case when id % 3 = 0 then words when id % 3 = 1 then 'Tab ' || id else '' end as title, 'Body of ' || id as body from {_IDS}")
def page_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """Content under each kind of element among chrome; the title from a heading, from the head, from nowhere."""
    head = _by("id", 3, [F.concat(F.lit("<title>no</title><nav><h1>"), "words", F.lit("</h1></nav>")), F.concat(F.lit("<title>Tab "), "id", F.lit("</title>")), F.lit("")])
    text = F.concat(F.lit("<p>Body of "), F.col("id").cast("string"), F.lit("</p>"))
    wrap = lambda a, b: F.concat(F.lit(a), text, F.lit(b))
    chrome = "<header>x</header><div class='breadcrumb'>y</div><aside class='sidebar'>z</aside>"
    kinds = [wrap("<article>no</article><main>", "<div class='toc'>no</div></main>"), wrap("<div id='content'>no</div><article>", "<button class='x-copy-button'>no</button></article>"), wrap("<div class='documentation'>", "<nav>no</nav></div>"), wrap("<div>", "</div>")]
    return _parsed(_ids(spark, folder), F.concat(F.lit("<html><head>"), head, F.lit("</head><body>" + chrome), _by("id", 4, kinds), F.lit("<footer>end</footer></body></html>")))


@query("code_blocks", f"select id, '```' || case id % 5 when 0 then 'sql' when 1 then 'go' when 2 then 'rust' else '' end || chr(10) || 'run ' || id || '  <x>' || chr(10) || '```' as body from {_IDS}")
def code_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Languages from classes and attributes, gutters and buttons in the code, names that say nothing."""
    opened = _by("id", 5, [F.lit("<pre><code class='a language-sql'>"), F.lit("<pre data-lang='go'><code>"), F.lit("<pre class='highlight-rust'><code class='language-none'>"), F.lit("<pre class='lang-plaintext'><code>"), F.lit("<pre><code>")])
    html = F.concat(F.lit("<main>"), opened, F.lit("<span class='line-numbers-rows'>1 2</span><b>run</b> "), F.col("id").cast("string"), F.lit("  &lt;x&gt;</code><button>Copy</button></pre></main>"))
    return _parsed(_ids(spark, folder), html).select("id", "body")


_PANELS = "range(1, cast(id % 3 as integer) + 2)"


@query("tabs_expanded", f"select id, array_to_string(list_transform({_PANELS}, lambda k: '**' || case when k = 1 then 'First' else 'Tab ' || k end || '**' || chr(10) || chr(10) || '```' || chr(10) || 'step ' || k || chr(10) || '```'), chr(10) || chr(10)) as body from {_IDS}")
def tabs_expanded(spark: SparkSession, folder: str) -> DataFrame:
    """Tab sets of both kinds with one label for one to three panels."""
    panels = F.sequence(F.lit(1), (F.col("id") % 3 + 1).cast("int"))
    each = lambda a, b: F.array_join(F.transform(panels, lambda k: F.concat(F.lit(f"{a}<pre>step "), k.cast("string"), F.lit(f"</pre>{b}"))), "")
    sets = F.concat(F.lit("<div class='tabbed-set'><div class='tabbed-labels'><label>First</label></div><div class='tabbed-content'>"), each("<div class='tabbed-block'>", "</div>"), F.lit("</div></div>"))
    aria = F.concat(F.lit("<div><div role='tablist'><button role='tab'>First</button></div>"), each("<div role='tabpanel'>", "</div>"), F.lit("</div>"))
    return _parsed(_ids(spark, folder), F.concat(F.lit("<main>"), _by("id", 2, [sets, aria]), F.lit("</main>"))).select("id", "body")


@query("images_absolute", f"select id, '![i](' || case id % 4 when 0 then 'https://docs.example/img/' || id when 1 then 'https://docs.example/guide/' || id when 2 then 'https://cdn.example/' || id else 'data:image/png;' || id end || ')' as body from {_IDS}")
def images_absolute(spark: SparkSession, folder: str) -> DataFrame:
    start = _by("id", 4, [F.lit("/img/"), F.lit(""), F.lit("//cdn.example/"), F.lit("data:image/png;")])
    return _parsed(_ids(spark, folder), F.concat(F.lit("<main><img alt='i' src='"), start, F.col("id").cast("string"), F.lit("'></main>"))).select("id", "body")


@query("rendered_parts", f"select id, '## ' || trim(words || ' x') || chr(10) || chr(10) || '- a **b**' || chr(10) || '  - *c*' || chr(10) || chr(10) || '1. d' || chr(10) || '2. `e_e`' || chr(10) || chr(10) || '> q' || chr(10) || chr(10) || '| h | i |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || id || ' | |' as body from {_IDS}")
def rendered_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Headings, nested lists, numbers, code, quotes and a table with a short row."""
    html = F.concat(F.lit("<main><h2>"), "words", F.lit(" x</h2><ul><li>a <b>b</b><ul><li><em>c</em></li></ul></li></ul><ol><li>d</li><li><code>e_e</code></li></ol><blockquote><p>q</p></blockquote><table><tr><th>h</th><th>i</th></tr><tr><td>"), F.col("id").cast("string"), F.lit("</td></tr></table></main>"))
    out = _parsed(_ids(spark, folder), html)
    return out.select("id", F.regexp_replace("body", r" +\|$", " |").alias("body")).withColumn("body", F.regexp_replace("body", r"\|  \|$", "| |"))


@query(
    "links_kept_first",
    f"""select 'https://docs.example/guide/p' || id as url, unnest([0, 1, 4]) as pos, unnest(['https://docs.example/guide/' || id, 'https://docs.example/x/' || id, 'https://docs.example/' || id]) as normalized from {_IDS}""",
)
def links_kept_first(spark: SparkSession, folder: str) -> DataFrame:
    """A page's links on the web and in scope, each target by its first link; nothing else of the page is needed."""
    n = F.col("id").cast("string")
    hrefs = [F.concat(n, F.lit("#a")), F.concat(F.lit("/x/"), n), F.lit("mailto:a@b"), F.lit("#top"), F.concat(F.lit("../"), n, F.lit("?q=1")), F.concat(F.lit("https://docs.example/x/"), n, F.lit("#z")), F.lit("https://other.example/"), F.concat(F.lit("/x/"), n)]
    html = F.concat(F.lit("<nav>"), *[F.concat(F.lit("<a href='"), h, F.lit("'>l</a>")) for h in hrefs], F.lit("</nav>"))
    url = F.concat(F.lit("https://docs.example/guide/p"), n)
    found = page_links(parsed_pages(_ids(spark, folder).select(url.alias("url"), html.alias("html"))), (F.lit("docs.example"), F.lit("/")))
    return found.filter(F.col("normalized") != F.col("url")).select("url", "pos", "normalized")


_CHAIN = f"(select tool, url, page_path, seq, seq % 3 = 0 as in_prior, lead(url) over w as next, lead(seq) over w as next_seq, lead(seq) over w % 3 = 0 as next_prior from (select tool, url, {_own_path('url')} as page_path, max(seq) as seq from manifest where strpos(url, '?') = 0 and strpos(url, '#') = 0 group by tool, url) window w as (partition by tool order by url))"


@query("crawl_order_links", f"select tool, url, case when next_prior or next_seq <= seq then 'file' else next end as link from {_CHAIN} where next is not null")
def crawl_order_links(spark: SparkSession, folder: str) -> DataFrame:
    """Each page links to the next one by url: only pages known before or crawled no later become files."""
    from foliant.functions import urls as U

    m = table(spark, folder, "manifest").filter("instr(url, '?') = 0 and instr(url, '#') = 0").groupBy("tool", "url").agg(F.max("seq").alias("seq"))
    m = m.select("tool", "url", "seq", U.page_path(F.col("url")).alias("page_path"), (F.col("seq") % 3 == 0).alias("in_prior"))
    nxt = F.lead("url").over(Window.partitionBy("tool").orderBy("url"))
    pages = m.withColumn("next", nxt).filter("next is not null").withColumn("body_hrefs", F.array("next"))
    links = link_targets(pages, m, "crawl_order")
    return links.select("tool", "url", F.when(F.col("link").like("%.md"), "file").otherwise(F.col("link")).alias("link"))


@query("bodies_filled", f"select id, 'a' || id || ' b' || (id + 1) || ' c' as body from {_IDS}")
def bodies_filled(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("id").cast("string")
    links = F.create_map(F.lit(0), n, F.lit(1), (F.col("id") + 1).cast("string"))
    return _ids(spark, folder).select("id", filled(F.lit(f"a{OPEN}0{CLOSE} b{OPEN}1{CLOSE} c{OPEN}2{CLOSE}"), links).alias("body"))


@query(
    "manifest_after_run",
    f"""with n as (select * from {_STATUS}), last as (select tool as of, max(snapshot_no) as last from manifest group by tool),
k as (select n.*, split_part(n.tool, '#', 1) as name, cast(split_part(n.tool, '#', 2) as integer) as no from n)
select k.name as tool, url, case when k.status = 'FAILED' then 'errored' end as status, k.seq from k join last on last.of = k.name and last.last = k.no where k.status <> 'skipped'
union all select k.name, k.url, 'before', k.seq from k join last on last.of = k.name join (select tool as t, snapshot_no as s, lead(snapshot_no) over (partition by tool order by snapshot_no) as nx from (select distinct tool, snapshot_no from manifest)) o
  on o.t = k.name and o.s = k.no and o.nx = last.last left join k new on new.name = k.name and new.no = last.last and new.url = k.url and new.status <> 'skipped' where new.url is null""",
)
def manifest_after_run(spark: SparkSession, folder: str) -> DataFrame:
    """Each tool's last run laid over the manifest of the one before it."""
    runs = _runs(spark, folder)
    last = table(spark, folder, "manifest").groupBy("tool").agg(F.max("snapshot_no").alias("last"))
    name, no = F.split("tool", "#")[0], F.split("tool", "#")[1].cast("int")
    done = _status(spark, folder).select(name.alias("tool"), no.alias("no"), "url", "seq", "page_path", "content_hash", "error", "http_status", "status").join(last, "tool").filter("no = last")
    none = {c: F.lit(None).cast("string") for c in ("cache_path", "fetched_at", "etag", "last_modified")}
    prior = runs.join(last, "tool").filter("next = last").select("tool", "url", "seq", "page_path", "content_hash").withColumns(none | {"nav_path": F.lit(None).cast("array<string>"), "status": F.lit("before"), "error": F.lit(None).cast("string")})
    merged = crawl.merged_manifest(done.withColumns(none | {"nav_path": F.lit(None).cast("array<string>")}), prior)
    return merged.select("tool", "url", "status", "seq")


@query(
    "sitemap_urls",
    "select url, cast((dense_rank() over (order by tool) - 1) * 1000000 + row_number() over (partition by tool order by url) - 1 as bigint) as pos from (select distinct tool, url from manifest)",
)
def sitemap_urls(spark: SparkSession, folder: str) -> DataFrame:
    """An index of a sitemap for each tool, one of them missing and one that isn't XML."""
    esc = F.replace("url", F.lit("&"), F.lit("&amp;"))
    space = "xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'"
    urls = table(spark, folder, "manifest").select("tool", "url").distinct()
    own = urls.groupBy("tool").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("url", esc.alias("x")))), lambda u: F.concat(F.lit("<url><loc> "), u["x"], F.lit("</loc></url>"))), "").alias("x"))
    site = lambda t: F.concat(F.lit("https://s/"), t)
    maps = own.select(site(F.col("tool")).alias("sitemap_url"), F.concat(F.lit(f"<urlset {space}>"), "x", F.lit("</urlset>")).alias("xml"))
    names = urls.select("tool").distinct().agg(F.array_sort(F.collect_list("tool")).alias("t"))
    listed = F.array_join(F.transform(F.concat("t", F.array(F.lit("missing"), F.lit("bad"))), lambda t: F.concat(F.lit("<sitemap><loc>"), site(t), F.lit("</loc></sitemap>"))), "")
    index = names.select(F.lit("https://s").alias("sitemap_url"), F.concat(F.lit(f"<sitemapindex {space}>"), listed, F.lit("</sitemapindex>")).alias("xml"))
    bad = spark.createDataFrame([("https://s/bad", "<no")], "sitemap_url string, xml string")
    return crawl.sitemap_urls(maps.unionByName(index).unionByName(bad), "https://s")


@query(
    "fetched_pages",
    """select url, case length(url) % 5 when 0 then 404 when 1 then null when 2 then 304 else 200 end as http_status, case length(url) % 5 when 0 then 'HTTP 404' when 1 then 'lost' end as error,
    case length(url) % 5 when 1 then 4 when 3 then 2 else 1 end as attempts from (select distinct url from manifest where url is not null)""",
)
def fetched_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Answers by the length of the url: gone, lost each time, unchanged by its validator, busy once, found."""
    tried: set[str] = set()

    def client(url: str, headers: dict[str, str], timeout: int) -> Response:
        kind = len(url) % 5
        if kind == 1:
            raise ConnectionError("lost")
        if kind == 3 and url not in tried:
            tried.add(url)
            return Response(503)
        return Response(404 if kind == 0 else 304 if kind == 2 and headers.get("If-None-Match") == "e" else 200, "<p>x</p>")

    urls = table(spark, folder, "manifest").filter("url is not null").groupBy("url").agg(F.max("seq").alias("seq")).withColumns({"etag": F.lit("e"), "last_modified": F.lit(None).cast("string")})
    return fetch_pages(urls, client, delay=0, sleep=lambda _: None).select("url", "http_status", "error", "attempts")


_TERMS = f"(select tool, t as term from (select tool, seq, {_TRIM} as t from terms) where t <> '' qualify row_number() over (partition by tool, lower(t) order by seq, t) = 1)"


@query(
    "glossaries",
    f"""select tool, 'glossary.md' as path, '---' || chr(10) || 'type: Glossary' || chr(10) || 'title: ' || tool || ' Glossary' || chr(10) || '---' || chr(10) || chr(10) || '# ' || tool || ' Glossary' || chr(10) || chr(10) ||
    string_agg(case when length(term) % 4 > 0 then '**' || term || '**: ' || length(term) || ' letters' || chr(10) || chr(10) else '' end, '' order by lower(term), term) as text from {_TERMS} group by tool""",
)
def glossaries(spark: SparkSession, folder: str) -> DataFrame:
    """A provider whose fenced reply is cut off and has entries without a definition."""
    import json

    def provider(prompt: str) -> str:
        terms = [t for t in prompt.split("\n")[1:] if t]
        entries = [{"term": t, "definition": f"{len(t)} letters" if len(t) % 4 else ""} for t in terms]
        return "```json\n" + json.dumps([*entries, {"term": "cut", "definition": "off"}])[:-12]

    return glossary(table(spark, folder, "terms"), provider, per_call=50)


@query(
    "summary_totals",
    """select tool, count(*) filter (where status = 'summarized') as done, count(*) filter (where status = 'FAILED') as failed, coalesce(string_agg(case when status = 'summarized' then 'x,' || page_path end, ',' order by page_path), '') as candidates from (
    select tool, 'p/' || concept_id as page_path, case when content is null or concept_id % 7 = 0 then 'FAILED' when concept_id % 5 = 0 then 'skipped' else 'summarized' end as status
    from (select concept_id, max(tool) as tool, max(content) as content from concepts where tool is not null group by concept_id)) group by tool""",
)
def summary_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Statuses and candidates over all batches, with a provider that fails now and then."""
    import json

    c = table(spark, folder, "concepts").filter("tool is not null").groupBy("concept_id").agg(F.max("tool").alias("tool"), F.max("content").alias("md"))
    path = F.concat(F.lit("p/"), F.col("concept_id").cast("string"))
    known = (F.col("concept_id") % 5 == 0) & (F.col("concept_id") % 7 != 0)
    m = c.select("tool", F.concat(F.lit("https://d.example/"), path).alias("url"), F.col("concept_id").alias("seq"), path.alias("page_path"), F.lit("h").alias("content_hash"))
    own = c.select("tool", path.alias("page_path"), F.when(known, "d").alias("description"), F.lit("h").alias("content_hash"), "md")

    def provider(prompt: str) -> str:
        n = int(prompt.split("URL: https://d.example/p/", 1)[1].split("\n", 1)[0])
        return "no JSON" if n % 7 == 0 else json.dumps({"summary": "s", "keywords": [], "candidates": ["x", f"p/{n}"]})

    return bundle.summary_totals(summarised(m, own, provider)).withColumn("candidates", F.array_join("candidates", ","))


_TEXT = "(select distinct concept_id as id, coalesce(content, '') as t, case concept_id % 3 when 0 then '---' || chr(10) || 'a: b' || chr(10) || '---' || chr(10) || 'rest' when 1 then '---' || chr(10) || 'open' else 'plain' end as f from concepts)"


@query(
    "text_scalars",
    f"""select id, length(regexp_replace(t, '^[\\s\\x{{00a0}}]+|[\\s\\x{{00a0}}]+$', '', 'g')) < 200 as short, len(list_filter(string_split(t, chr(10)), lambda x: starts_with(x, '**'))) > 0 as entries,
    case id % 3 when 0 then 'a: b' || chr(10) end as front, case id % 3 when 0 then 'rest' else f end as body, 'r' || id as reply from {_TEXT}""",
)
def text_scalars(spark: SparkSession, folder: str) -> DataFrame:
    """The render threshold, filled glossaries, frontmatter and body, replies without their fence."""
    c = table(spark, folder, "concepts").select(F.col("concept_id").alias("id"), F.coalesce("content", F.lit("")).alias("t")).distinct()
    file = _by("id", 3, [F.lit("---\na: b\n---\nrest"), F.lit("---\nopen"), F.lit("plain")])
    reply = F.concat(_by("id", 2, [F.lit("```json\n"), F.lit(" ")]), F.lit("r"), F.col("id").cast("string"), _by("id", 2, [F.lit("\n``` "), F.lit("")]))
    return c.withColumn("f", file).select("id", X.below_threshold(F.col("t")).alias("short"), X.glossary_filled(F.col("t")).alias("entries"), X.frontmatter_of(F.col("f")).alias("front"), X.body_of(F.col("f")).alias("body"), X.without_fences(reply).alias("reply"))


@query("merged_headers", f"select id, '---' || chr(10) || 'a: n' || id || chr(10) || 'b: x' || id || chr(10) || '---' || chr(10) || chr(10) || 'text ' || id as text from {_IDS}")
def merged_headers(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("id").cast("string")
    text = F.concat(F.lit("---\nb: x"), n, F.lit("\na: old\n---\n\ntext "), n)
    return _ids(spark, folder).select("id", merged_text(text, F.concat(F.lit('{"a": "n'), n, F.lit('"}'))).alias("text"))


@query("sql_functions", f"select url, {_own_path('url')} as page_path, regexp_replace(url, '[?#].*$', '') as plain, sha256(url) as hash, 'T' as title from (select distinct url from manifest where url like 'http%')")
def sql_functions(spark: SparkSession, folder: str) -> DataFrame:
    """The functions for SQL on all urls of the manifests, in one statement."""
    register(spark)
    table(spark, folder, "manifest").createOrReplaceTempView("foliant_urls")
    return spark.sql(
        """select url, foliant_page_path(url) as page_path, foliant_normal_url(url) as plain, foliant_page_hash(url) as hash,
        foliant_parse_page('<title>T</title>', url).title as title from (select distinct url from foliant_urls where url like 'http%')"""
    )
