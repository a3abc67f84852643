"""Queries on the text operators, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.boilerplate import chrome_rows, main_text
from foliant.llm.bpe import encode_ids
from foliant.llm.garbled import garbled, repaired_texts
from foliant.llm.leaks import leaked_items
from foliant.llm.markup import clean_texts, markup_kinds
from foliant.llm.pieces import oversized, text_pieces
from foliant.llm.residue import residue, without_residue
from foliant.llm.repeated import repeated_lines, without_repeated_lines
from foliant.llm.similar import similar_groups, similar_pairs
from foliant.scale import one_row_per_id

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


@query("p3_found", "select distinct concept_id from concepts where length(content) > 4000")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return oversized(table(spark, folder, "concepts"))


@query("p3_pieces")
def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return text_pieces(one_row_per_id(table(spark, folder, "concepts"), "concept_id"))


@query("p3_rebuilt", "select distinct concept_id, sha256(content) as content, true as within_limit, true as overlap_kept from concepts where content is not null")
def p3_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces put together again without their overlap: each text's hash, whether all pieces are within the limit
    and each begins with the end of the one before."""
    pieces = F.array_sort(F.collect_list(F.struct("piece_no", "piece")))  # of one text
    rows = p3_pieces(spark, folder).filter("piece is not null").groupBy("concept_id").agg(pieces.alias("p"))
    first, rest = F.col("p")[0]["piece"], F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0)))
    whole = F.concat(first, F.array_join(F.transform(rest, lambda x: F.substring(x["piece"], 201, 4000)), ""))
    kept = F.forall(rest, lambda x: F.substring(x["piece"], 1, 200) == F.right(F.element_at("p", x["piece_no"] - 1)["piece"], F.lit(200)))
    return rows.select("concept_id", F.sha2(whole, 256).alias("content"), F.forall("p", lambda x: F.length(x["piece"]) <= 4000).alias("within_limit"), kept.alias("overlap_kept"))


_REPEATED = r"""
with c as (select distinct concept_id, content,
    nullif(regexp_replace(lower(regexp_extract(trim(resource), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', ''), '') as site
  from concepts),
l as (select concept_id, site, unnest(string_split(content, chr(10))) as x, unnest(range(1, len(string_split(content, chr(10))) + 1)) as line_no from c where site is not null),
n as (select concept_id, site, line_no, regexp_replace(trim(regexp_replace(lower(x), '[\s\x{00a0}]+', ' ', 'g')), '[0-9]+', '0', 'g') as line
  from l where length(regexp_replace(x, '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g')) >= 24),
f as (select site, line from n group by site, line
  having count(distinct concept_id) >= 5 and count(distinct concept_id) >= 0.05 * (select count(*) from c d where d.site = n.site))
"""


@query("p5_found", _REPEATED + "select distinct concept_id, cast(line_no as integer) as line_no from n join f using (site, line)")
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_lines(table(spark, folder, "concepts"))


@query(
    "p5_clean",
    _REPEATED
    + """, r as (select distinct concept_id, line_no from n join f using (site, line)),
a as (select concept_id, unnest(string_split(content, chr(10))) as x, unnest(range(1, len(string_split(content, chr(10))) + 1)) as line_no from c),
k as (select a.concept_id, string_agg(x, chr(10) order by a.line_no) as kept from a anti join r using (concept_id, line_no) group by a.concept_id)
select c.concept_id, case when c.content is null then null else coalesce(k.kept, '') end as content from c left join k using (concept_id)""",
)
def p5_clean(spark: SparkSession, folder: str) -> DataFrame:
    return without_repeated_lines(one_row_per_id(table(spark, folder, "concepts"), "concept_id")).select("concept_id", "content")


@query("p8_ids")
def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_ids(table(spark, folder, "documents"))


_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


@query(
    "p9_found",
    f"""
with i as (select item_id, {_WORDS.format('passage')} as w from eval_items where passage is not null),
g as (select distinct item_id, n, array_to_string(w[k:k + n - 1], ' ') as g from (select item_id, w, least(13, len(w)) as n, unnest(range(1, len(w) - least(13, len(w)) + 2)) as k from i where len(w) > 0)),
s as (select doc_id, w, n from (select doc_id, {_WORDS.format('text')} as w from documents where text is not null), (select distinct n from g)),
d as (select doc_id, n, array_to_string(w[k:k + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from s where len(w) >= n))
select distinct doc_id, item_id from d join g using (n, g)
""",
)
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


@query("p9_edited")
def p9_edited(spark: SparkSession, folder: str) -> DataFrame:
    """As p9_found, with up to two words of the 13 changed, added or left out."""
    return leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"), edits=2)


@query("p10_found")
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return garbled(table(spark, folder, "documents"))


@query("p10_texts")
def p10_texts(spark: SparkSession, folder: str) -> DataFrame:
    return repaired_texts(table(spark, folder, "documents"))


@query("p7_found")
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return markup_kinds(table(spark, folder, "concepts"))


@query("p7_clean")
def p7_clean(spark: SparkSession, folder: str) -> DataFrame:
    return clean_texts(table(spark, folder, "concepts"))


@query("p2_found")
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return chrome_rows(table(spark, folder, "concepts"))


@query("p2_main")
def p2_main(spark: SparkSession, folder: str) -> DataFrame:
    return main_text(one_row_per_id(table(spark, folder, "concepts"), "concept_id")).select("concept_id", "content")


def _sources(spark: SparkSession, folder: str) -> list:
    return [
        ("concept", table(spark, folder, "concepts"), "concept_id", "content", "resource"),
        ("manifest", table(spark, folder, "manifest"), "entry_id", "error", "url"),
    ]


@query("p4_found")
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue(_sources(spark, folder)).select("origin", "record_id")


@query("p4_kept")
def p4_kept(spark: SparkSession, folder: str) -> DataFrame:
    return without_residue(_sources(spark, folder))


_ALIKE = f"""
with recursive d as (select concept_id, {_WORDS.format("coalesce(any_value(title), '') || ' ' || coalesce(any_value(content), '')")} as w from concepts group by concept_id),
s as (select distinct concept_id, hash(w[k], w[k + 1], w[k + 2]) as h from (select concept_id, w, unnest(range(1, len(w) - 1)) as k from d where len(w) >= 50)),
n as (select concept_id, count(*) as n from s group by concept_id),
p as (select a.concept_id as a, b.concept_id as b, count(*) as c from s a join s b on a.h = b.h and a.concept_id < b.concept_id group by all),
l as (select p.a, p.b from p join n x on x.concept_id = p.a join n y on y.concept_id = p.b where p.c >= 0.6 * (x.n + y.n - p.c))
"""


@query("p6_found", _ALIKE + "select a as concept_id_a, b as concept_id_b from l")
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return similar_pairs(table(spark, folder, "concepts"), n=3, threshold=0.6)


@query(
    "p6_groups",
    _ALIKE
    + """, e as (select a, b from l union all select b, a from l),
r as (select concept_id as a, concept_id as b from d union select r.a, e.b from r join e on e.a = r.b),
g as (select a, min(b) as group_id from r group by a)
select g.a as concept_id, group_id, coalesce(k.links, 0) as links from g left join (select a, count(*) as links from e group by a) k using (a)""",
)
def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    return similar_groups(table(spark, folder, "concepts"), n=3, threshold=0.6)
