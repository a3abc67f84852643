"""Template residue, filler, error pages and script notices in place of real text."""

from __future__ import annotations

import re
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.lines import normal_line, per_slice, site
from foliant.llm.markup import without_code
from foliant.scale import bounded_broadcast, cut

try:
    import ahocorasick
except ImportError:  # hints are then looked for one by one
    ahocorasick = None

#: Words of the usual filler text.
FILLER_WORDS = frozenset(
    """ad adipiscing aliqua aliquip amet anim aute cillum commodo consectetur consequat culpa cupidatat deserunt do dolor dolore
    duis ea eiusmod elit enim esse est et eu ex excepteur exercitation fugiat id in incididunt ipsum irure labore laboris laborum
    lorem magna minim mollit nisi non nostrud nulla occaecat officia pariatur proident qui quis reprehenderit sed sint sit sunt
    tempor ullamco ut velit veniam voluptate""".split()
)
#: Those of them that other languages of the corpus don't have as common words.
FILLER_ONLY = FILLER_WORDS - frozenset("ad do ea est et eu ex id in non qui sed sint sit sunt ut est dolor minim".split())

#: Patterns of unfilled placeholders; a text's urls and code are taken out before.
PLACEHOLDER = re.compile(
    r"""\{\{\{?[^{}\n]{0,80}\}?\}\} | \{\{\w+ | \{\ \{\w+\}\ \} | \$\{[^{}\n]{1,60}\} | \$\([a-z_]+\)s? | %\([a-z_]+\)[sdif]?
    | %%[A-Z][A-Z_]*%% | %[A-Z]+_[A-Z_]+% | @@\w+@@ | &&[A-Z_]+&& | (?<!~)~[A-Z]{3,}~(?!~) | X{4}-[A-Z]+-X{4} | \bX{6,}\b
    | \{[a-z_\ ]+\ goes\ here\} | (?<![\w}\]\\$^_{])\{(?:\d|[a-z_]{2,})\}(?!\}) | \{%[^%\n]{1,80}%\} | <%[^%\n]{1,80}%> | \#\{\w[^{}\n]{0,60}\}
    | \[(?:INSERT|YOUR|ENTER)\b[^\]\n]{0,60}\](?![(\[]) | \[(?:insert|your|enter)\ [^\]\n]{1,40}\](?![(\[:]) | <(?:insert|your|enter)[\ _-][^>\n]{1,40}>
    | \({3,}[^()\n]{1,60}\){3,} | __[A-Z]+(?:_[A-Z]+)+__ | (?<![\w%])(?<!\d\ )%[sd](?!\w) | \[object\ Object\] | \bInvalid\ Date\b | \bNaN\b.{0,40}\bundefined\b
    | \bundefined\b.{0,40}\bNaN\b | \b(?:Hello|Dear|Welcome)\ (?:undefined|null)\b | ^\W*undefined\W*$""",
    re.X,
)
#: Sentences that stand for a text yet to be written.
FILLER = re.compile(
    r"""^\W*(?:TODO|TBD|FIXME)\b\s*[:–-] | \basdf\b | \bplaceholder\ text,\ replace | \btext\ about\ .{1,60}\ goes\ here\b | ^\W*body\ text\.?\W*$
    | ^\W*(?:sample|dummy|filler|example)\ text\.?\W*$ | \bTexte\ sur\ .{1,60}\ à\ venir\b | \bHier\ folgt\ noch\ ein\ Text\b | \bAquí\ (?:va|irá)\ (?:el|un)\ texto\b
    | \bTexto\ (?:sobre|de)\ .{1,60}\ (?:pendiente|por\ escribir)\b""",
    re.X | re.I,
)
#: What error pages say, as a whole line or sentence.
ERROR_PAGE = re.compile(
    r"""^\W*(?:error\s+)?[45]\d\d\s*[-–—:.]?\s*(?:page\ not\ found|not\ found|bad\ gateway|forbidden|internal\ server\ error|service\ unavailable|gateway\ time-?out|gone|unauthorized|too\ many\ requests)(?:\W*\w+/\d+)?\W*(?:-.*)?$
    | <title>\s*[45]\d\d\b | ^\W*(?:page\ not\ found|internal\ server\ error|access\ denied|bad\ gateway|seite\ nicht\ gefunden|page\ introuvable|página\ no\ encontrada|service\ unavailable)\W*$
    | \bsomething\ went\ wrong\ on\ our\ (?:side|end)\b | \bpage\ \S+\ (?:doesn['’]t|does\ not)\ exist\ or\ has\ moved\b | \bcouldn['’]t\ find\ what\ you\ were\ looking\ for\b
    | \bmay\ have\ been\ renamed,\ or\ perhaps\ it\ never\ was\b | \byour\ session\ has\ expired\b | \bdon['’]t\ have\ permission\ to\ view\b | \bThe\ request\ \w+\ could\ not\ be\ completed\b
    | \bcontent\ is\ not\ available\ in\ your\ (?:country|region)\b | \byou\ have\ been\ rate\ limited\b | ^\W*too\ many\ requests\b | \bchecking\ your\ browser\ before\b
    | \bdown\ for\ maintenance\b | \bwe['’]ll\ be\ back\ shortly\b | \berreur\ \d{3}\s*:\ la\ page\ demandée | \bla\ page\ demandée\ est\ introuvable\b
    | \bdie\ angeforderte\ (?:adresse|seite)\ .{1,200}\bnicht\ (?:bekannt|gefunden) | ^\W*error\ \d{3}\.\ no\ se\ ha\ encontrado | \bno\ se\ ha\ encontrado\ la\ página\b""",
    re.X | re.I,
)
SCRIPT = re.compile(
    r"""\b(?:enable|activate|turn\ on|allow|switch\ on)\ (?:java\s?script|scripts)\b | \bjava\s?script\ (?:is|seems|appears)\ (?:to\ be\ )?(?:disabled|turned\ off|off|required|not\ enabled)\b
    | \bbrowser\ (?:does\ not|doesn['’]t)\ (?:run|support)\ (?:java\s?)?scripts?\b | ^\W*noscript\b | \bactiver\ java\s?script\b | \bjava\s?script\ (?:aktivieren|einschalten)\b
    | \baktivieren\ sie\ java\s?script\b | \b(?:active|habilite|activar)\ java\s?script\b""",
    re.X | re.I,
)
#: Messages of the fetch itself, which are no residue whatever their url holds.
OWN_MESSAGE = re.compile(r"^\s*(?:\d{3} (?:Client|Server) Error: .* for url:|HTTPS?ConnectionPool\(|\('Connection aborted|Exceeded \d+ redirects|Page\.\w+: Timeout|could not decode the response body)", re.S)
#: A status code as a number of its own at the start or end of a page's first line, markup and the word for error aside.
_STATUS = re.compile(r"^\W*(?:[^\W\d_]+\W+){0,2}[45]\d\d\b(?!\s*(?:[%€$]|[^\W\d_]{1,2}\b))|\b[45]\d\d\W*$")
#: What is too little for an article.
SMALL_WORDS, SMALL_LINES = 40, 6
#: Words of a title at most; a sentence is none.
TITLE_WORDS = 6
_URL = re.compile(r"(?:https?://|www\.)\S+")
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
#: A line with neither of these can show no residue; plain substring search keeps most texts from the patterns above.
#: Each alternative of PLACEHOLDER needs one of the signs, each of the other patterns one of the hints, filler one of its words.
_SIGNS = re.compile(r"\(\(\(|\{[\w{% ]|\$[{(]|%[(%A-Zsd]|@@|&&[A-Z_]|~[A-Z]|XXXX|#\{|\[(?:INSERT|YOUR|ENTER|insert|your|enter|object)|<(?:%|insert|your|enter)|__[A-Z]+_|undefined|NaN|Invalid Date|(?:Hello|Dear|Welcome) null")
_HINTS = {
    "filler": "todo|tbd|fixme|asdf|placeholder text|text about|texte sur|body text|sample text|dummy text|filler text|example text|noch ein text|el texto|un texto|texto ".split("|"),
    "words": sorted(FILLER_ONLY),
    "script": "java|scripts|run script|support script|noscript".split("|"),
    "error": """not found|bad gateway|gateway time|forbidden|server error|unavailable|unauthorized|too many requests|gone|<title>|page not|access denied|nicht gefunden
introuvable|no encontrada|went wrong|exist or has moved|were looking for|been renamed|session has|permission|not be completed|not available|rate limited|checking your
for maintenance|back shortly|page demandée|angeforderte|no se ha""".replace("\n", "|").split("|"),
}


def _low(text: str) -> str:
    """Lower case, with the letters that patterns without case take for an i or s."""
    low = text.lower()
    return low if low.isascii() else low.replace("i\u0307", "i").replace("ı", "i").replace("ſ", "s")


def is_filler(sentence: str) -> bool:
    """Most of its words are those of the usual filler text."""
    words = _WORD.findall(sentence.lower())
    known = sum(w in FILLER_WORDS for w in words)
    return len(words) > 1 and known >= 0.7 * len(words) and any(w in FILLER_ONLY for w in words)


def evidence(line: str, groups: frozenset[str] = frozenset(_HINTS)) -> str | None:
    """What kind of residue a line without code shows, if any; ``groups`` names the patterns that can match."""
    bare = _URL.sub("URL", line)
    if _SIGNS.search(bare) and PLACEHOLDER.search(bare):
        return "placeholder"
    if groups:
        for sentence in _SENTENCE.split(bare):
            if "filler" in groups and FILLER.search(sentence) or "words" in groups and is_filler(sentence):
                return "filler"
            if "script" in groups and SCRIPT.search(sentence):
                return "script"
            if "error" in groups and ERROR_PAGE.search(sentence):
                return "error"
    return "error" if "error" in groups and ERROR_PAGE.search(bare) else None


#: What each sign begins with, in lower case.
_SIGN_HINTS = "((( { ${ $( % @@ && ~ xxxx #{ [insert [your [enter [object <% <insert <your <enter __ undefined nan".split() + ["invalid date", "hello null", "dear null", "welcome null"]


@lru_cache(1)
def _automaton():
    """Finds all hints in one pass; None without the library."""
    if ahocorasick is None:
        return None
    made = ahocorasick.Automaton()
    by_word: dict[str, list[str]] = {}
    for group, words in [*_HINTS.items(), ("signs", _SIGN_HINTS)]:
        for w in words:
            by_word.setdefault(w, []).append(group)
    for w, groups in by_word.items():
        made.add_word(w, (w, groups))
    made.make_automaton()
    return made


def _hints_of(low: str) -> dict[str, list[str]]:
    """The hints that a text in lower case has, by group."""
    found: dict[str, list[str]] = {}
    automaton = _automaton()
    if automaton is None:
        found = {g: own for g, words in [*_HINTS.items(), ("signs", _SIGN_HINTS)] if (own := [w for w in words if w in low])}
    else:
        for w, groups in {w: g for _, (w, g) in automaton.iter(low)}.items():
            for g in groups:
                found.setdefault(g, []).append(w)
    if "words" in found and FILLER_ONLY.isdisjoint(_WORD.findall(low)):
        del found["words"]
    return found


def _suspects(text: str) -> list[tuple[int, str, frozenset[str]]]:
    """``(line_no, line, groups)`` of the lines that may show residue."""
    hints = _hints_of(_low(text))
    signs = hints.pop("signs", None) and _SIGNS.search(text)
    if not hints and not signs or OWN_MESSAGE.search(text):
        return []
    out = []
    for i, line in enumerate(without_code(text).split("\n"), 1):
        if line:
            low = _low(line) if hints else line
            groups = frozenset(g for g, words in hints.items() if any(w in low for w in words))
            if groups or signs and _SIGNS.search(line):
                out.append((i, line, groups))
    return out


def is_small(text: str) -> bool:
    """No more than a heading and a sentence or two: too little for an article."""
    return len(text) <= 600 and len(_WORD.findall(text)) <= SMALL_WORDS and sum(1 for x in text.split("\n") if x.strip()) <= SMALL_LINES


def shaped_like_an_error(text: str) -> int | None:
    """The line of a small page, whatever its language, that an error's status code opens or closes, or that is all
    there is of its title."""
    if not is_small(text):
        return None
    for i, line in enumerate(without_code(text).split("\n"), 1):
        if line.strip():
            bare = _URL.sub("", line).strip()
            return i if bare[-1:] not in ".!?。" and len(_WORD.findall(bare)) <= TITLE_WORDS and _STATUS.search(bare) else None
    return None


def residue_lines(text: str) -> list[tuple[int, str]]:
    """``(line_no, kind)`` of the lines of a text that show residue; code, fenced or inline, has none.

    Evidence are the patterns above and, in any language, the shape of an error page."""
    found = {i: kind for i, line, groups in _suspects(text) if (kind := evidence(line, groups))}
    if not found and not OWN_MESSAGE.search(text) and (at := shaped_like_an_error(text)):
        found[at] = "error"
    return sorted(found.items())


def altogether(text: str) -> bool:
    """The text is nothing but residue: half of it and more stands in such lines, or it is small and has no article."""
    suspects = _suspects(text)
    if not suspects:
        return not OWN_MESSAGE.search(text) and shaped_like_an_error(text) is not None
    small = is_small(text)
    numbered = text.split("\n")
    size = lambda numbers: sum(len(numbered[i - 1].strip()) for i in numbers)
    half = 0.5 * size(range(1, len(numbered) + 1))
    if not small and size(i for i, *_ in suspects) < half:
        return False
    at = [i for i, line, groups in suspects if evidence(line, groups)]
    if small:
        return bool(at) or shaped_like_an_error(text) is not None
    return bool(at) and size(at) >= half


def residue(
    sources: list[tuple[str, DataFrame, str, str, str]], min_docs: int = 20, min_share: float = 0.2
) -> DataFrame:
    """``(origin, record_id, kinds)`` of the records whose own text shows residue.

    ``sources`` has ``(origin, table, id, text, url)`` each; ids that aren't whole numbers make all of them strings.
    Lines with evidence are counted by host in their normal form: one that at least ``min_docs`` records and
    ``min_share`` of all records of a host have is the site's furniture (a notice for readers without scripts, a
    banner) and no evidence against a record. What remains is. A line that is no evidence need not be counted, so the
    texts are read once, and only lines with evidence are grouped.

    Defined cases: null and empty texts show none; a fetch's own message shows none; repeated rows give one row; a
    record without a host has no furniture; tables may be empty.
    """
    parts = []
    kind_of_id = id_type(sources)
    for origin, df, id_col, text, url in sources:
        docs = df.select(F.col(id_col).cast(kind_of_id).alias("record_id"), F.col(text).cast("string").alias("text"), F.col(url).alias("url"))
        schema = T.StructType([T.StructField("record_id", kind_of_id), T.StructField("url", T.StringType()), T.StructField("line", T.StringType()), T.StructField("kind", T.StringType())])

        def work(batch: pa.RecordBatch, names=schema.names) -> pa.RecordBatch:
            rows, line, kind = [], [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                if t:
                    own = None
                    for i, found in residue_lines(t):
                        own = own or t.split("\n")
                        rows.append(k), line.append(own[i - 1]), kind.append(found)
            at = pa.array(rows, pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(line, pa.string()), pa.array(kind, pa.string())], names)

        hits = docs.filter("text is not null").mapInArrow(per_slice(work, "text"), schema)
        hits = cut(hits.select("record_id", site(F.col("url")).alias("site"), F.xxhash64(normal_line(F.col("line"))).alias("line"), "kind").distinct())
        hosts, _ = bounded_broadcast(hits.filter("site is not null").select("site").distinct())
        records = docs.select("record_id", site(F.col("url")).alias("site")).join(hosts, "site", "left_semi").distinct()
        sizes, _ = bounded_broadcast(records.groupBy("site").agg(F.count(F.lit(1)).alias("records")))
        counts = hits.select("record_id", "site", "line").distinct().groupBy("site", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs)
        furniture, _ = bounded_broadcast(counts.join(sizes, "site").filter(F.col("n") >= F.ceil(F.col("records") * min_share - 1e-9)).select("site", "line"))
        kept = hits.join(furniture, ["site", "line"], "left_anti")
        parts.append(kept.groupBy("record_id").agg(F.concat_ws(" ", F.sort_array(F.collect_set("kind"))).alias("kinds")).select(F.lit(origin).alias("origin"), "record_id", "kinds"))
    return reduce(DataFrame.unionByName, parts)


def id_type(sources: list[tuple[str, DataFrame, str, str, str]]) -> T.DataType:
    """Whole numbers if all ids are, else strings."""
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    return T.LongType() if all(isinstance(df.schema[i].dataType, whole) for _, df, i, _, _ in sources) else T.StringType()


def without_residue(sources: list[tuple[str, DataFrame, str, str, str]], **limits) -> DataFrame:
    """``(origin, record_id)`` of the records that show no residue, each once."""
    kind = id_type(sources)
    all_rows = reduce(DataFrame.unionByName, [df.select(F.lit(o).alias("origin"), F.col(i).cast(kind).alias("record_id")).distinct() for o, df, i, _, _ in sources])
    return all_rows.join(residue(sources, **limits), ["origin", "record_id"], "left_anti")
