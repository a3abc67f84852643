"""Main text of a page: a site's template is deduced from its pages, the slots that remain are the article."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.lines import site, slices
from foliant.llm.residue import altogether
from foliant.scale import bounded_broadcast, cut, one_row_per_id

_FENCE = re.compile(r"^[ \t]{0,3}(`{3,}|~{3,})")
_LIST = re.compile(r"^\s*(?:(?:[-+]|\*{1,4}|\d+[.)])\s+(?!\[[ xX]\] )|<li\b[^>]*>)", re.I)
_HEADING = re.compile(r"^\s*(?:#{1,6}\s|={2,6}[^=].*={2,6}\s*$|<h[1-6]\b|\\(?:chapter|(?:sub)*section|paragraph)\b)", re.I)
#: Lines of an article's own markup: tables, definitions, quotes, formulas, tasks, blocks of elements.
_OWN = re.compile(r"^\s*(?:\||\{\||[;:](?=\S)|>|\\|\$|!\[|\[\^?[^\]]+\]:|[-*+]\s+\[[ xX]\] |</?(?:p|div|table|t[rdh]|ul|ol|dl|pre|hr|img|blockquote|section|article|figure)\b|<!--|`|data:)", re.I)
_LINK = re.compile(r"^\s*(?:(?:[-*+]|\d+[.)])\s+)?(?:\[[^\]]*\]\([^)]*\)|<li>\s*<a\b[^>]*>.*?</a>\s*</li>|<a\b[^>]*>.*?</a>)\s*$", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_ANCHOR = re.compile(r"!?\[([^\[\]]*)\]\([^)]*\)")
_SPLIT = re.compile(r"[|·•»›→←/>–—]+|[:;,.!?…]+\s+|\s(?:\s+|[-<]\s)")
#: The same for lines without two white spaces in a row or single dashes.
_PLAIN_SPLIT = re.compile(r"[|·•»›→←/>–—]+|[:;,.!?…]+\s+")
_END = re.compile(r"[.!?…:;。！？)\]}>`\"”’»,]\s*$")
_NEXT = re.compile(r"[.!?…][)\"'”»]*\s+(?=[^\W\d_a-zß-ÿ])|[。！？](?=\w)")
#: What separates the steps of a trail.
_TRAIL = re.compile(r"[|·•»›→←/>–—]|\s(?:\s|[-<]\s)")
_DIGITS = re.compile(r"\d+")
_MARKS = " \t\r!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”„‘’…·•–—→←›‹©®👍👎\u200d"


#: The name under which the classes of many sites stand.
SHARED = "*"
#: Fingerprints of occurrence vectors are sums of page hashes of so many bits.
_VECTOR = (1 << 47) - 1


def visible(line: str) -> str:
    """A line's words without list marker, link and tag syntax and emphasis."""
    if "<" in line:
        line = _TAG.sub("", line)
    if "[" in line:
        line = _ANCHOR.sub(r"\1", line)
    return _LIST.sub("", line).replace("**", "").replace("__", "").strip()


def tokens(shown: str) -> list[str]:
    """The segments of a line between separators, without case, digits and outer marks."""
    flat = _DIGITS.sub("0", shown.lower())
    pattern = _SPLIT if "  " in flat or "\t" in flat or "\xa0" in flat or " - " in flat or " < " in flat else _PLAIN_SPLIT
    return [" ".join(t.split()) if "\t" in t or "\xa0" in t else t for t in (x.strip(_MARKS) for x in pattern.split(flat)) if t]


class Line:
    """A line with its number, block, role (head, list, own, link, text) and visible words."""

    __slots__ = ("no", "block", "role", "shown", "_tokens", "_short", "_finished")

    def __init__(self, no: int, block: int, role: str, shown: str) -> None:
        self.no, self.block, self.role, self.shown, self._tokens, self._short, self._finished = no, block, role, shown, None, None, None

    @property
    def tokens(self) -> list[str]:
        if self._tokens is None:
            self._tokens = tokens(self.shown)
        return self._tokens

    @property
    def short(self) -> bool:
        """No sentence: the line neither ends with a mark that closes one nor has one inside."""
        if self._short is None:
            self._short = not self.finished and not self.running
        return self._short

    @property
    def finished(self) -> bool:
        if self._finished is None:
            self._finished = _END.search(self.shown[-8:]) is not None
        return self._finished

    @property
    def first(self) -> str:
        """The first token alone."""
        if self._tokens is None:
            m = _SPLIT.search(self.shown)
            found = tokens(self.shown[: m.start()]) if m else None
            if found:
                return found[0]
        return self.tokens[0] if self.tokens else ""

    @property
    def running(self) -> bool:
        """A sentence ends and another begins within the line."""
        return _NEXT.search(self.shown) is not None

    @property
    def words(self) -> list[str]:
        """The words of an unfinished line of text, where a template's words may stand between slots."""
        words = _DIGITS.sub("0", self.shown.lower()).split() if self.role == "text" and self.short else []
        return words if len(words) > 2 else []


def role_of(raw: str, bare: str) -> str:
    first = bare[0]
    if first.isalpha():
        return "own" if first in "dD" and bare[:5].lower() == "data:" else "text"
    if _HEADING.match(raw):
        return "head"
    if _LINK.match(raw):
        return "link"
    return "own" if _OWN.match(raw) else "list" if _LIST.match(raw) else "text"


def parse(text: str) -> list[Line]:
    """The lines of a page outside fenced code that aren't blank, each with its block and role."""
    out, block, fence = [], 0, None
    for no, raw in enumerate(text.split("\n"), 1):
        bare = raw.strip()
        if not bare:
            block += not fence
            continue
        m = _FENCE.match(raw) if bare[0] in "`~" else None
        if fence or m:
            if m and not fence:
                fence = m.group(1)
            elif m and m.group(1).startswith(fence[:3]) and not bare.strip("`~"):
                fence = None
            block += not fence
            continue
        role = role_of(raw, bare)
        out.append(Line(no, block, role, bare if role == "text" and "<" not in bare and "[" not in bare and "*" not in bare and "__" not in bare else visible(raw)))
    return out


def word(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token) - (1 << 63)


def in_line(first: str, other: str) -> int:
    """A word with its role: the word that begins its line tells one role of it from another."""
    return word(f"{first}\x1f{other}")


_SEGMENT, _IN_HEAD = (0, False, 0), (0, True, 0)


def page_tokens(text: str) -> dict[int, tuple[int, bool, int]]:
    """The tokens of a page: hash to (line role, whether it stands in headings alone, place in its line).

    Tokens are the segments of lines (role 0), and the words of unfinished lines of text, whose role is the hash of the
    word that begins the line.
    """
    own: dict[int, tuple[int, bool, int]] = {}
    for line in parse(text):
        if line.role == "head":
            for t in line.tokens:
                own.setdefault(word(t), _IN_HEAD)
            continue
        for t in line.tokens:
            own[word(t)] = _SEGMENT
        words = line.words
        if words:
            role = word(words[0])
            for k, t in enumerate(words):
                own.setdefault(in_line(words[0], t), (role, False, k))
    return own


def template_classes(docs: DataFrame, min_docs: int = 3, min_share: float = 0.004, shared_docs: int = 10, shared_share: float = 0.0015) -> DataFrame:
    """``(site, token, role, docs, head_docs, size, class, rank)``: the tokens of each site's template.

    ``docs`` has id, text and site. Each page sends each of its tokens once (page_tokens), with a hash of the page;
    summed by site and token, the sums are fingerprints of occurrence vectors, so tokens that stand on the same pages
    share them without any page list being kept. Tokens of one role and fingerprint make an equivalence class of
    ``size`` tokens; ``rank`` is a token's place among them, by its mean place in the line.

    A class of segments is valid on ``min_docs`` pages and ``min_share`` of the site's, or, with two and more, on half
    that share. A class of words is valid with two and more, on ``shared_docs`` pages and ``min_share``: single words
    recur by chance, words that always come together in one order don't. Widgets that many sites use (consent notices,
    feedback) make the classes of the site ``*``: on ``shared_docs`` pages and ``shared_share`` of all, so at most
    (tokens a page) / ``shared_share`` of them. Sums are combined in the worker, then before the shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                places: dict[str, dict[int, int]] = {}
                hosts, token, roles, pages, heads, vectors, at = [], [], [], [], [], [], []
                for key, text, host in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    page = xxhash.xxh3_64_intdigest(str(key)) & _VECTOR
                    known = places.setdefault(host, {})
                    for w, (role, head, place) in page_tokens(text).items():
                        i = known.get(w)
                        if i is None:
                            known[w] = len(token)
                            hosts.append(host), token.append(w), roles.append(role), pages.append(1), heads.append(int(head)), vectors.append(page), at.append(place)
                        else:
                            pages[i] += 1
                            vectors[i] += page
                            if head:
                                heads[i] += 1
                            if place:
                                at[i] += place
                if token:
                    vectors = [v & _VECTOR for v in vectors]
                    yield pa.RecordBatch.from_arrays([pa.array(hosts), *(pa.array(x, pa.int64()) for x in (token, roles, pages, heads, vectors, at))], ["site", "token", "role", "docs", "head_docs", "vector", "place"])

    sums = docs.select("id", "text", "site").filter("text is not null and site is not null").mapInArrow(count, "site string, token long, role long, docs long, head_docs long, vector long, place long")
    total = [F.first("role").alias("role"), *(F.sum(c).alias(c) for c in ("docs", "head_docs", "place")), F.expr(f"sum(vector) & {_VECTOR}").alias("vector")]
    every = cut(sums.groupBy("site", "token").agg(*total))  # with tokens on one page of a site: of many sites they make the shared classes
    pages, _ = bounded_broadcast(docs.groupBy("site").agg(F.count(F.lit(1)).alias("pages")))
    all_pages = pages.agg(F.sum("pages")).first()[0] or 0

    def classes(tokens: DataFrame) -> DataFrame:
        members = F.array_sort(F.collect_list(F.struct((F.col("place") / F.col("docs")).alias("at"), "token", "head_docs")))
        found = tokens.groupBy("site", "role", "docs", "vector").agg(members.alias("members")).withColumn("size", F.size("members"))
        return found.select("site", "role", "docs", F.col("vector").alias("class"), "size", F.posexplode("members").alias("rank", "m")).select("site", "m.token", "role", "docs", "m.head_docs", "size", "class", "rank")

    own = classes(every.filter(F.col("docs") >= min_docs)).join(pages, "site")
    words = (F.col("role") != 0) & (F.col("size") >= 2) & (F.col("docs") >= shared_docs) & (F.col("docs") >= min_share * F.col("pages"))
    segments = (F.col("role") == 0) & (F.col("docs") >= min_share * F.col("pages") * F.when(F.col("size") >= 2, 0.5).otherwise(1.0))
    shared = every.groupBy("token").agg(*total).filter(F.col("docs") >= max(shared_docs, shared_share * all_pages))
    shared = classes(shared.withColumn("site", F.lit(SHARED))).filter("role = 0 or size >= 2")
    return own.filter(words | segments).drop("pages").unionByName(shared)




class Template:
    """What the extraction needs of a site's classes. What many sites share is held once, beside each site's own."""

    def __init__(self, rows: list[tuple[int, int, bool, int, int, int]], shared: Template | None = None) -> None:
        """Rows are (token, role, whether it heads articles, size, class, rank)."""
        self.shared = shared
        self.tokens = {t for t, role, *_ in rows if not role}
        self.heads = {t for t, role, head, *_ in rows if head and not role}
        self.frames = {t: (size, name, rank) for t, role, _, size, name, rank in rows if role}

    def has(self, token: str) -> bool:
        w = word(token)
        return w in self.tokens or self.shared is not None and w in self.shared.tokens

    def whole(self, line: Line) -> bool:
        """All tokens of the line are the template's, or it is a row of such tokens."""
        if line.finished and not self.has(line.first):
            return False  # a paragraph is left at its first segment
        return bool(line.tokens) and all(self.has(t) for t in line.tokens) or line.short and self.menu(line.shown)

    def framed(self, line: Line) -> bool:
        """The line has all words of a class in their order, with slots between them."""
        words = line.words
        if not words:
            return False
        hashes = [in_line(words[0], x) for x in words]
        for frames in (self.frames, self.shared.frames if self.shared else {}):
            ranks: dict[int, list[int]] = {}
            for h in hashes:
                if h in frames:
                    size, name, rank = frames[h]
                    met = ranks.setdefault(name, [size, 0])
                    met[1] += rank == met[1]
            if any(n == size for size, n in ranks.values()):
                return True
        return False

    def member(self, line: Line) -> bool:
        """A token of the line is the template's, or it is a row of such tokens, or has a class of words."""
        return any(self.has(t) for t in line.tokens) or self.framed(line) or self.menu(line.shown)

    def heading(self, token: str) -> bool:
        w = word(token)
        return w in self.heads or self.shared is not None and w in self.shared.heads

    def menu(self, shown: str) -> bool:
        """The words of a line are a row of template tokens with nothing between them but blanks and marks."""
        words = [w for x in _DIGITS.sub("0", shown.lower()).split() if (w := x.strip(_MARKS))]
        if len(words) < 2:
            return False
        at, found = 0, 0
        while at < len(words):
            n = next((n for n in (4, 3, 2, 1) if at + n <= len(words) and self.has(" ".join(words[at : at + n]))), 0)
            if not n:
                return False
            at, found = at + n, found + 1
        return found >= 2


def chrome_lines(text: str, template: Template, title: str | None = None) -> list[int]:
    """The numbers of the lines that are the template's, or in one of its slots, and not the article's.

    A line belongs to the template if all its tokens do. Slots nest in it: short unfinished lines and links are the
    template's if they, or a line of their run in the block, have a template token; without one they are the
    article's, whatever their form. So are running sentences, headings, tables, formulas, code and lists that no
    template line opens; trails that end in the page's own title are not.
    """
    if altogether(text):
        return []
    lines = parse(text)
    own_heads = {" ".join(x.tokens) for x in lines if x.role == "head"}
    own_title = " ".join(tokens(title or ""))
    by_block: dict[int, list[Line]] = {}
    for x in lines:
        by_block.setdefault(x.block, []).append(x)
    out: set[int] = set()
    for block in by_block.values():
        opened = False  # a template line has opened a list
        whole = [x.role == "text" and template.whole(x) for x in block]
        nested = _nested(block, whole, template)
        for k, x in enumerate(block):
            if x.role in ("head", "own"):
                opened = False
                continue
            chrome = False
            if x.role == "link":
                chrome = nested[k]
            elif x.role == "list":
                chrome = opened or (x.short and _listed(block, k, template))
            elif whole[k] or (nested[k] and x.short):
                chrome = True
            elif _TRAIL.search(x.shown) and x.tokens[-1:] and len(x.tokens) > 1 and (x.tokens[-1] == own_title or x.tokens[-1] in own_heads) and not x.running:
                chrome = True
            if chrome:
                out.add(x.no)
            if x.role == "text":
                opened = chrome and x.short
    return sorted(out)


def _nested(block: list[Line], whole: list[bool], template: Template) -> list[bool]:
    """For each line of a block whether its run has a line of the template. Headings, an article's own markup and running sentences end a run."""
    out: list[bool] = []
    found = False
    start = 0
    for k, x in enumerate(block):
        running = x.role == "text" and not whole[k] and not x.short
        if x.role in ("head", "own") or running:
            out += [found] * (k - start) + [False]
            found, start = False, k + 1
        elif not found and x.role in ("text", "link"):
            found = whole[k] or template.member(x)
    return out + [found] * (len(block) - start)


def _listed(block: list[Line], k: int, template: Template) -> bool:
    """All items of the list around line ``k`` are the template's, and most are no headings of articles."""
    a = b = k
    while a and block[a - 1].role in ("list", "link"):
        a -= 1
    while b + 1 < len(block) and block[b + 1].role in ("list", "link"):
        b += 1
    items = [x for x in block[a : b + 1] if x.role == "list"]
    return any(not template.heading(t) for t in block[k].tokens) and len(items) > 1 and all(x.tokens and all(template.has(t) for t in x.tokens) for x in items)


class Templates:
    """The templates of many sites from columns (site, token, role, head, size, class, rank), each made when it is asked for."""

    def __init__(self, sites: list[str], columns: dict[str, np.ndarray]) -> None:
        order = np.argsort(np.array(sites, dtype=object), kind="stable") if sites else np.zeros(0, np.int64)
        self.columns = {k: v[order] for k, v in columns.items()}
        self.span: dict[str, tuple[int, int]] = {}
        ordered = [sites[k] for k in order]
        starts = [k for k, x in enumerate(ordered) if not k or ordered[k - 1] != x]
        for start, end in zip(starts, [*starts[1:], len(ordered)], strict=False):
            self.span[ordered[start]] = (start, end)
        self.made: dict[str, Template] = {}

    def _rows(self, site: str) -> list[tuple]:
        start, end = self.span.get(site, (0, 0))
        return list(zip(*(self.columns[k][start:end].tolist() for k in ("token", "role", "head", "size", "class", "rank")), strict=True))

    def __getitem__(self, site: str | None) -> Template:
        if SHARED not in self.made:
            self.made[SHARED] = Template(self._rows(SHARED))
        if site is None or site not in self.span:
            return self.made[SHARED]
        if site not in self.made:
            self.made[site] = Template(self._rows(site), self.made[SHARED])
        return self.made[site]


_KINDS = {"token": np.int64, "role": np.int64, "head": np.bool_, "size": np.int64, "class": np.int64, "rank": np.int64}


def _templates(table: pa.Table) -> Templates:
    return Templates(table.column("site").to_pylist(), {k: table.column(k).to_numpy().astype(t) for k, t in _KINDS.items()})


def _pages(df: DataFrame, id_col: str, text: str, url: str, title: str | None) -> DataFrame:
    return df.select(
        F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"), site(F.col(url)).alias("site"), (F.col(title).cast("string") if title else F.lit(None).cast("string")).alias("title")
    )


def _judged(df: DataFrame, judge, schema: T.StructType, id_col: str, text: str, url: str, title: str | None, min_docs: int, min_share: float, max_broadcast_rows: int, pages_per_group: int) -> DataFrame:
    """What ``judge(rows, templates)`` makes of all rows of ``df``, which have ``_site`` and ``_title`` beside their own columns."""
    names = dict.fromkeys(x for x in (id_col, text, url, title) if x)
    found = template_classes(_pages(one_row_per_id(df.select(*names), id_col), id_col, text, url, title), min_docs, min_share)
    found = cut(found.select("site", "token", "role", (F.col("head_docs") > 0.3 * F.col("docs")).alias("head"), "size", "class", "rank"))
    rows = df.withColumn("_site", site(F.col(url))).withColumn("_title", F.col(title).cast("string") if title else F.lit(None).cast("string"))
    if found.count() <= max_broadcast_rows:  # 50 bytes each
        sent = found.sparkSession.sparkContext.broadcast(_templates(found.toArrow()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            templates = sent.value
            for batch in batches:
                for part in slices(batch, text):
                    yield judge(part, templates)

        return rows.mapInArrow(run, schema)

    shared = found.sparkSession.sparkContext.broadcast(found.filter(F.col("site") == SHARED).toArrow())  # bounded by its share of all pages
    rows = rows.withColumn("_of", F.coalesce("_site", F.lit("")))
    groups = rows.groupBy("_of").agg(F.ceil(F.count(F.lit(1)) / pages_per_group).cast("int").alias("_groups"))
    left = rows.join(groups.withColumnRenamed("_of", "_named"), F.col("_of") == F.col("_named")).drop("_named").withColumn("_salt", F.pmod(F.xxhash64(id_col, "_title"), F.col("_groups")).cast("int")).drop("_groups")
    named = groups.withColumnRenamed("_of", "_named").withColumnRenamed("_groups", "_many")
    right = found.filter(F.col("site") != SHARED).join(named, F.col("site") == F.col("_named")).withColumnRenamed("_named", "_of").withColumnRenamed("_many", "_groups").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1))).drop("_groups")

    def meet(pages: pa.Table, classes: pa.Table) -> pa.Table:
        if not pages.num_rows:
            return schema_table(schema)
        templates = _templates(pa.concat_tables([shared.value, classes.select(shared.value.column_names).cast(shared.value.schema)]))
        return pa.Table.from_batches([judge(part, templates) for part in pages.drop_columns(["_of", "_salt"]).to_batches()])

    return left.groupBy("_of", "_salt").cogroup(right.groupBy("_of", "_salt")).applyInArrow(meet, schema)


def schema_table(schema: T.StructType) -> pa.Table:
    """No rows of a schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema).empty_table()


def _lines(part: pa.RecordBatch, templates: Templates, text: str) -> list[list[int]]:
    columns = [part.column(k).to_pylist() for k in (text, "_site", "_title")]
    return [chrome_lines(t, templates[h], name) if t else [] for t, h, name in zip(*columns, strict=True)]


def page_chrome(
    df: DataFrame,
    id_col: str = "concept_id",
    text: str = "content",
    url: str = "resource",
    title: str | None = "title",
    min_docs: int = 3,
    min_share: float = 0.004,
    max_broadcast_rows: int = 500_000,
    pages_per_group: int = 2_000,
) -> DataFrame:
    """``(id, lines)``: for each page the numbers of its lines that are the site's and not its article's.

    The template tokens of all sites go to the workers if they are at most ``max_broadcast_rows`` rows; beyond that,
    pages and templates meet in groups of a site's ``pages_per_group`` pages, so a site with a third of all pages is
    many groups, and so are the pages without a host. Those have the template that all sites share.

    Defined cases: repeated rows of an id count once for the template and come again here; a null or empty text has no
    lines; a page that is nothing but residue (error page, placeholder, filler) has none either; extra columns play no
    part.
    """
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("lines", T.ArrayType(T.IntegerType()))])

    def judge(part: pa.RecordBatch, templates: Templates) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(id_col), pa.array(_lines(part, templates, text), pa.list_(pa.int32()))], ["id", "lines"])

    own = df.select(*dict.fromkeys(x for x in (id_col, text, url, title) if x)).withColumn(text, F.col(text).cast("string"))
    return _judged(own, judge, schema, id_col, text, url, title, min_docs, min_share, max_broadcast_rows, pages_per_group)


def chrome_rows(df: DataFrame, id_col: str = "concept_id", **options) -> DataFrame:
    """``(id_col, line_no)`` of every line outside the main article; options as in page_chrome."""
    return page_chrome(df, id_col, **options).select(F.col("id").alias(id_col), F.explode("lines").alias("line_no")).distinct()


def main_text(
    df: DataFrame,
    id_col: str = "concept_id",
    text: str = "content",
    url: str = "resource",
    title: str | None = "title",
    min_docs: int = 3,
    min_share: float = 0.004,
    max_broadcast_rows: int = 500_000,
    pages_per_group: int = 2_000,
) -> DataFrame:
    """All rows and columns of ``df`` with nothing but the main article left in ``text``; null stays null. Texts are
    read and written in one pass, not shuffled, as long as the templates can be sent out; options as in page_chrome."""
    if {"_site", "_title", "_of", "_salt", "_groups"} & set(df.columns):
        raise ValueError("columns _site, _title, _of, _salt and _groups are taken")
    columns = df.columns

    def judge(part: pa.RecordBatch, templates: Templates) -> pa.RecordBatch:
        out = []
        for t, drop in zip(part.column(text).to_pylist(), _lines(part, templates, text), strict=True):
            gone = set(drop)
            out.append("\n".join(x for k, x in enumerate(t.split("\n"), 1) if k not in gone) if gone else t)
        return pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text else part.column(c) for c in columns], columns)

    rows = df.withColumn(text, F.col(text).cast("string"))
    return _judged(rows, judge, rows.schema, id_col, text, url, title, min_docs, min_share, max_broadcast_rows, pages_per_group)
