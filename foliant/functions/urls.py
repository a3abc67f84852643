"""URL algebra as native columns: parts, bundle name, page path, scope, resolution, relative links.

Every function takes and gives columns; a null url gives null, and no url raises.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Leading host labels that name no tool.
COMMON_LABELS = ["www", "docs", "api", "developer", "developers", "help", "support"]
ROOT_PATH = "_root"
#: RFC 3986, appendix B.
_URI = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _URI, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def netloc(url: Column) -> Column:
    """Host with port and user, in its own case."""
    return _part(url, 2)


def raw_path(url: Column) -> Column:
    """The path with the parameters of its last segment."""
    return _part(url, 3)


def path(url: Column) -> Column:
    """The path without the ``;parameters`` of its last segment."""
    return F.regexp_replace(raw_path(url), r";[^/]*$", "")


def query(url: Column) -> Column:
    return _part(url, 4)


def fragment(url: Column) -> Column:
    return _part(url, 5)


def url_parts(url: Column) -> Column:
    return F.struct(scheme(url).alias("scheme"), netloc(url).alias("netloc"), path(url).alias("path"), query(url).alias("query"), fragment(url).alias("fragment"))


def tool_name(url: Column) -> Column:
    """The first host label, once common leading ones are dropped while more than two labels remain."""
    labels = F.split(netloc(url), r"\.", -1)
    own = F.array_position(F.transform(labels, lambda x: ~x.isin(COMMON_LABELS)), True)
    size = F.size(labels)
    at = F.least(F.greatest(size - 2, F.lit(0)), F.when(own == 0, size).otherwise(own.cast("int") - 1))
    return F.element_at(labels, at + 1)


def page_path(url: Column) -> Column:
    """The path without outer slashes; ``_root`` for none. A trailing slash makes no other page."""
    bare = F.regexp_replace(path(url), r"^/+|/+$", "")
    return F.when(url.isNull(), None).when(bare == "", ROOT_PATH).otherwise(bare)


def scope_prefix(url: Column) -> Column:
    bare = F.regexp_replace(path(url), r"/+$", "")
    return F.when(bare == "", "/").otherwise(bare)


def crawl_scope(url: Column) -> Column:
    """``(netloc, path_prefix)`` that pages found from an entry url must keep to."""
    return F.struct(netloc(url).alias("netloc"), scope_prefix(url).alias("path_prefix"))


def in_scope(url: Column, scope_netloc: Column, prefix: Column) -> Column:
    """Same host, and the path is the prefix or under it; ``/pay`` has no ``/pay-more``. The scheme plays no part."""
    own = F.when(path(url) == "", "/").otherwise(path(url))
    return (netloc(url) == scope_netloc) & ((prefix == "/") | (own == prefix) | F.startswith(own, F.concat(prefix, F.lit("/"))))


def is_web(url: Column) -> Column:
    return scheme(url).isin("http", "https")


def normalized(url: Column) -> Column:
    """Without query and fragment."""
    return F.regexp_replace(url, r"(?s)[?#].*$", "")


def parent_directory(url: Column) -> Column:
    """The directory of a url's path: ``.`` for none, ``/`` for the root's own."""
    parts = F.filter(F.split(path(url), "/", -1), lambda x: (x != "") & (x != "."))
    up = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    rooted = F.startswith(path(url), F.lit("/"))
    return F.when(url.isNull(), None).when(rooted, F.concat(F.lit("/"), up)).when(up == "", ".").otherwise(up)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _resolved_path(base: Column, ref: Column) -> Column:
    """A reference's path seen from a base path, without dot segments."""
    empty = F.array().cast("array<string>")
    rooted = F.startswith(ref, F.lit("/"))

    def below(b: Column) -> Column:
        kept = F.when(F.element_at(b, -1) == "", b).otherwise(F.slice(b, 1, F.size(b) - 1))
        return _let(F.concat(kept, F.split(ref, "/", -1)), without_gaps)

    def without_gaps(s: Column) -> Column:
        inner = F.filter(F.slice(s, 2, F.greatest(F.size(s) - 2, F.lit(0))), lambda x: x != "")
        return F.when(F.size(s) > 2, F.concat(F.slice(s, 1, 1), inner, F.slice(s, F.size(s), 1))).otherwise(s)

    def without_dots(s: Column) -> Column:
        out = F.aggregate(
            s,
            empty,
            lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))),
        )
        tail = F.when(F.element_at(s, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(empty)
        return F.array_join(F.concat(out, tail), "/")

    made = _let(F.when(rooted, F.split(ref, "/", -1)).otherwise(_let(F.split(base, "/", -1), below)), without_dots)
    return _let(made, lambda m: F.when(m == "", "/").otherwise(m))


def resolve(base: Column, href: Column) -> Column:
    """An href as an absolute url, seen from the page ``base`` (an absolute web url).

    Empty hrefs give the page, ``//host`` keeps the scheme, other schemes stay as they are, dot segments are taken
    out of what is resolved, and a reference's own absolute url is left alone.
    """
    parts = F.struct(
        *(_part(href, k).alias(n) for k, n in enumerate("snpqf", 1)), scheme(base).alias("bs"), netloc(base).alias("bn"), raw_path(base).alias("bp"), query(base).alias("bq"), base.alias("base"), href.alias("href")
    )

    def put(x: Column) -> Column:
        own = x["n"] != ""
        path_ = F.when(own, x["p"]).when(x["p"] == "", x["bp"]).otherwise(_resolved_path(x["bp"], x["p"]))
        query_ = F.when(~own & (x["p"] == "") & (x["q"] == ""), x["bq"]).otherwise(x["q"])
        slashed = _let(path_, lambda p: F.concat(F.when((p != "") & ~F.startswith(p, F.lit("/")), "/").otherwise(""), p))
        tail = F.concat(_let(query_, lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")), F.when(x["f"] != "", F.concat(F.lit("#"), x["f"])).otherwise(""))
        made = F.concat(x["bs"], F.lit("://"), F.when(own, x["n"]).otherwise(x["bn"]), slashed, tail)
        foreign = (x["s"] != "") & (F.lower(x["s"]) != x["bs"])
        return F.when(x["href"].isNull() | x["base"].isNull(), None).when(x["href"] == "", x["base"]).when(foreign, x["href"]).otherwise(made)

    return _let(parts, put)


def relative_md(target: Column, source: Column) -> Column:
    """The link from the page at ``source`` to the page at ``target``, both page paths, as files of one bundle."""
    empty = F.array().cast("array<string>")

    def put(x: Column) -> Column:
        least = F.least(F.size(x["here"]), F.size(x["there"]) - 1)
        steps = F.when(least > 0, F.sequence(F.lit(1), F.greatest(least, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        common = F.aggregate(steps, F.lit(0), lambda acc, i: F.when((acc == i - 1) & (F.get(x["there"], i - 1) == F.get(x["here"], i - 1)), i).otherwise(acc))
        return _let(common, lambda k: F.concat(F.repeat(F.lit("../"), F.size(x["here"]) - k), F.array_join(F.slice(x["there"], k + 1, F.size(x["there"]) - k), "/")))

    here = _let(F.split(source, "/", -1), lambda p: F.when(F.size(p) > 1, F.slice(p, 1, F.size(p) - 1)).otherwise(empty))
    return _let(F.struct(here.alias("here"), F.split(F.concat(target, F.lit(".md")), "/", -1).alias("there")), put)
