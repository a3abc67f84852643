"""Markup residue in documents: flat text blocks, a small trained decision tree, conversion to clean text."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.lines import per_slice

KINDS = ("html", "markdown", "wiki", "latex")

#: HTML element names.
TAGS = """a abbr address article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col
colgroup dd del details dfn dialog div dl dt em embed fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header
hr html i iframe img input ins kbd label legend li link main map mark menu meta nav noscript object ol optgroup option p param
picture pre q s samp script section select small source span strike strong style sub summary sup svg table tbody td template
textarea tfoot th thead time title tr tt u ul var video wbr""".split()
#: LaTeX commands.
COMMANDS = """alpha author beta begin bf bibitem bibliography caption cdot centering chapter cite cline date delta documentclass
dots em emph end enumerate epsilon eqref equation footnote footnotesize frac gamma ge geq hline href hspace huge in include
includegraphics infty input int it item itemize label lambda large ldots le left leq ln log maketitle mathbb mathbf mathcal mathrm
maximum mbox mu multicolumn neq newline newpage noindent omega operatorname ovalbox pagebreak pageref par paragraph part
partial phi pi pm prod ref renewcommand newcommand right rm sc section sf sigma sin cos sl small sqrt subparagraph subsection
subsubsection sum tableofcontents tabular textbf textit textrm textsc textsf textsl texttt textup theta times title today tt
underline url usepackage vdots verb vspace""".split()

#: Each alternative begins with a plain character, so that the engine skips to it; what must stand before comes after.
_WITHIN = {
    "html": rf"<(?:/?(?:{'|'.join(t for t in TAGS if t != 'a')})(?=[\s/>])[^<>]*>|!--|!doctype)|&(?:[A-Za-z][A-Za-z0-9]{{1,24}}|#\d{{1,7}}|#[xX][0-9A-Fa-f]{{1,6}});",
    "latex": rf"\\(?:(?:{'|'.join(COMMANDS)})(?![A-Za-z])|\(.*?\\\)|\[[^\n]*?\\\]|\[[ \t\r]*\n(?:(?![ \t\r]*\n)[^\n]*\n)*?[^\n]*?\\\]|\\(?:\[-?\d|[ \t\r]*$))|\$(?:\$|(?<![\w$\\]\$)(?=[^\s$])[^$\n]*[\\^_{{][^$\n]*(?<=\S)\$(?![\w$])|(?<![\w$\\]\$)[A-Za-z](?:\s*[=<>+*/-]\s*[\w.]+)*\$(?!\w))",
    "wiki": r"''(?<!''')(?:'''(?=[^\s'])[^\n]*?'''''|'?(?=[^\s'])[^\n]*?(?<=[^\s'])'''?(?!'))|<nowiki|~~~~|__(?:TOC|NOTOC|NOEDITSECTION)__",
    "markdown": r"\*(?<![\\*\w]\*)\*{0,2}(?=[^\s*])[^*\n]*?(?<=[^\s*\\])\*{1,3}(?![*\w])|_(?<![\\\w]_)_{0,2}(?=[^\s_])[^\n]*?(?<=[^\s_\\])_{1,3}(?!\w)|~~(?=\S)[^~\n]+~~|\[\^[^\]\s]+\]|<(?:https?|ftp|mailto):[^\s<>]+>|\\(?<!\\\\)(?:[*_#`~>!{}+.|-]|\[(?=[^\s\\\n][^\\\n]*\\\]))",
}
#: Marks at the start of a line; the text gets a newline in front.
_AHEAD = {
    "wiki": r"\n(?:(={2,6})[^=\n].*?\1[ \t\r]*(?=\n|$)|\{\||\|\}|\|-|;[^\s;].*\n:|[*#:;]*:(?=[^\s:/])[A-Za-zÀ-ÿ])",
    "markdown": r"\n(?: {0,3}(?:>|\[[^\]\n]+\]:\s*\S)|[ \t]*(?:[-*+]|\d+[.)])\s+\[[ xX]\](?=\s)|[ \t]*\|?(?:[ \t]*:?-{3,}:?[ \t]*\|)+(?:[ \t]*:?-{3,}:?[ \t]*)?\r?(?=\n|$))",
}
WITHIN = {k: re.compile(p, re.M | (re.I if k == "html" else 0)) for k, p in _WITHIN.items()}
AHEAD = {k: re.compile(p) for k, p in _AHEAD.items()}
#: A text without any of these characters can have no mark of the kind inside a line.
TRIGGERS = {"html": "<&", "latex": "\\$", "wiki": "'<~_", "markdown": "*_~[<\\"}
#: The links of each kind; their words make its link density.
LINKS = {
    "html": re.compile(r"<a\b(?=[\s>])[^<>]*>(.*?)</a\s*>|</?a\b(?=[\s>])[^<>]*>()", re.I),
    "markdown": re.compile(r"\[(?:([^\[\]\n]*)\]\([^()\s]*(?:\([^()\s]*\)[^()\s]*)*(?:\s+[\"'(][^\n]*?[\"')])?\)|([^\[\]\n]+)\]\[[^\[\]\n]*\](?!\]))"),
    "wiki": re.compile(r"\[\[(?:[^\]\[|\n]*\|)?([^\]\[\n]+)\]\]"),
}
#: What only looks like a mark of a kind: elements and commands that no list knows. The text around a block decides.
LOOSE = {"html": re.compile(rf"</?(?!(?:{'|'.join(TAGS)})[\s/>])[A-Za-z][\w.-]*(?:\s+[\w:-]+=(?:\"[^\"<>]*\"|'[^'<>]*'))*\s*/?>", re.I), "latex": re.compile(r"(?<![\w\\:.])\\[A-Za-z]{2,}(?=[\[{])")}
FENCE = re.compile(r"^[ \t]{0,3}(`{3,}|~{3,})[^\n]*\n(?:.*?^[ \t]{0,3}\1[`~]*[ \t\r]*$|.*)", re.M | re.S)
INLINE = re.compile(r"(?<!`)(`+)(?!`)(?:(?!\n[ \t\r]*\n).)*?(?<!`)\1(?!`)", re.S)
BLOCK = re.compile(r"\n(?:[ \t\r]*\n)+")

FEATURES = ("words", "link_density", "words_before", "density_before", "words_after", "density_after", "lines", *(f"{k}_marks" for k in KINDS), *(f"{k}_links" for k in LINKS), *(f"{k}_loose" for k in LOOSE))
#: Texts around labelled blocks: prose, and the short, linked blocks of a page's own template.
PROSE = ("The worker reads every row of the table and writes a page for each of them once a day.", "Each of these pages is kept until the next run has ended, so nothing is lost on the way.")
MENU = ("[Home](/)\n[Blog](/b)", "[Next](/n)", " ".join(f"[Part {k}](/p/{k})" for k in range(12)))
SHORT = ("Usage", "An example:")
FORMULA = ("So $x^2 + y^2 = z^2$ holds.", "Proof of it.")

#: The labelled table: one block a row, with the kinds of markup in it ("" for none).
LABELLED = [
    ("A queue keeps at most ten rows.", ""),
    ("## How to start", ""),
    ("- first item\n- second item", ""),
    ("1. open the page\n2. close it", ""),
    ("* one\n* two", ""),
    ("Set a_long_name to 5 * 3 and b to 4 * 2.", ""),
    ("If a < b and c > d, nothing happens.", ""),
    ("It costs $5 a day; set $HOME first.", ""),
    ("Logs go to C:\\Tools\\logs on that system.", ""),
    ("The call returns Map<String, Int> each time.", ""),
    ("Home | Blog | Contact", ""),
    ("Docs > Guides > Start", ""),
    ("An item [archived] stays.", ""),
    ("R&D and Q&A pages stay as they are.", ""),
    ("Don't use the ''' sign.", ""),
    ("<p>A paragraph.</p>", "html"),
    ("<li><a href=\"/x\">X</a></li>\n<li><a href=\"/y\">Y</a></li>", "html"),
    ("<h2 id=\"a\">Title</h2>", "html"),
    ("fish &amp; chips&#39;", "html"),
    ("a line<br/>another <!-- note -->", "html"),
    ("<IMG src=x> and <FONT color=red>red</FONT>", "html"),
    ("Read **this** first.", "markdown"),
    ("Read *this* first.", "markdown"),
    ("Read __this__ and _that_.", "markdown"),
    ("See [the page](./page.md) or [that][ref].", "markdown"),
    ("[ref]: https://a.example/x", "markdown"),
    ("![alt](/i.png)", "markdown"),
    ("> quoted words", "markdown"),
    ("| a | b |\n| --- | --- |\n| 1 | 2 |", "markdown"),
    ("- [x] done\n- [ ] open", "markdown"),
    ("A note.[^1]", "markdown"),
    ("A \\*star\\* and ~~gone~~.", "markdown"),
    ("See <https://a.example/5> today.", "markdown"),
    ("- [One](/one)\n- [Two](/two)\n- [Three](/three)", "markdown"),
    ("== Title ==", "wiki"),
    ("It is '''bold''' or ''slanted''.", "wiki"),
    ("See [[Page|the page]] and [[Other]].", "wiki"),
    ("{| class=\"wikitable\"\n|-\n| a\n|}", "wiki"),
    (";term\n:its meaning", "wiki"),
    ("\\section{Title}", "latex"),
    ("\\begin{itemize}\n\\item one\n\\end{itemize}", "latex"),
    ("It is \\textbf{bold} and {\\bf old}.", "latex"),
    ("The bound is \\(t \\cdot 4\\).", "latex"),
    ("So $x_{1}^2 + \\alpha$ holds~\\cite{a}.", "latex"),
    ("<b>x</b> and **y**", "html markdown"),
    ("== T ==\n<p>text</p>", "html wiki"),
    ("\\emph{a} &amp; b", "html latex"),
    ("[[A]] and [b](c)", "markdown wiki"),
    ("See the [page](./a_(b).md) for more words on how it is done.", "markdown"),
    ("A sentence with one link, [here](/x), and many other words around it that are no link at all.", "markdown"),
    ("A sentence with one link, [[Here]], and many other words around it that are no link at all.", "wiki"),
    ("A sentence with one link, <a href='/x'>here</a>, and many other words around it that are no link.", "html"),
    ("Read the whole text at [that page][ref] if you want to know it.", "markdown"),
]
#: Blocks with what only looks like a mark: the same block is markup or not by what stands around it.
IN_CONTEXT = [
    (MENU[0], "<x-card>", MENU[1], "html"),
    (MENU[0], "<app-menu open=\"yes\">\n</app-menu>", MENU[1], "html"),
    (MENU[1], "</x-card>", MENU[0], "html"),
    (MENU[0], "<Tabs>\n</Tabs>", MENU[0], "html"),
    (MENU[2], "<x-card>", MENU[2], "html"),
    (MENU[2], "<app-menu open=\"yes\">\n</app-menu>", MENU[1], "html"),
    (MENU[0], "<Tabs>\n</Tabs>", MENU[2], "html"),
    (PROSE[0], "<x-card>", PROSE[1], ""),
    (SHORT[0], "<x-card>", SHORT[1], ""),
    (SHORT[1], "<your_name>", SHORT[0], ""),
    (SHORT[1], "<name>", PROSE[0], ""),
    (PROSE[1], "<Tabs>\n</Tabs>", SHORT[0], ""),
    (SHORT[0], "mycommand <name> <path>", MENU[1], ""),
    (MENU[0], "mycommand <name> <path> --to <other>", MENU[1], ""),
    (MENU[2], "mycommand <name> <path> and then with the <other> name of it", MENU[2], ""),
    (PROSE[1], "<your_name>", PROSE[0], ""),
    (PROSE[0], "</x-card>", PROSE[1], ""),
    (PROSE[0], "<Tabs>\n</Tabs>", PROSE[0], ""),
    (PROSE[0], "The call returns a List<String> or a <name> in place of it, as the type says.", PROSE[1], ""),
    (MENU[0], "The call returns a List<String> or a <name> in place of it, as the type says.", PROSE[1], ""),
    (MENU[0], "Pass <name> and <path> to the command.", MENU[1], ""),
    (FORMULA[0], "\\theoremname{x} \\qedhere{}", FORMULA[1], "latex"),
    (FORMULA[1], "\\newthought{So} it is.", FORMULA[0], "latex"),
    (FORMULA[0], "\\sidenote{y}", FORMULA[0], "latex"),
    (PROSE[0][:60], "\\sidenote{y}", PROSE[1], ""),
    (PROSE[0], "\\theoremname{x} \\qedhere{}", PROSE[1], ""),
    (PROSE[1], "\\newthought{So} it is.", PROSE[0], ""),
    (PROSE[0], "\\sidenote{y}", PROSE[1], ""),
]


def without_code(text: str) -> str:
    """The text with fenced and inline code blanked out, its lines kept."""
    if "`" not in text and "~~~" not in text:
        return text
    text = FENCE.sub(lambda m: "\n" * m.group().count("\n"), text)
    return INLINE.sub(lambda m: "`" + "\n" * m.group().count("\n") + "`", text) if "`" in text else text


@dataclass
class Block:
    text: str
    row: list[float]


def marks(bare: str, kind: str) -> Iterator[int]:
    """Where the marks of a kind stand in a text without code."""
    if any(c in bare for c in TRIGGERS[kind]):
        yield from (m.start() for m in WITHIN[kind].finditer(bare))
    if kind in AHEAD:
        yield from (m.start() for m in AHEAD[kind].finditer("\n" + bare))


def blocks(text: str) -> list[Block]:
    """Flat blocks of a text without code: what lies between blank lines, with the features named in FEATURES."""
    bare = without_code(text)
    starts, ends = [0], []
    for m in BLOCK.finditer(bare):
        ends.append(m.start())
        starts.append(m.end())
    ends.append(len(bare))
    n = len(starts)
    words = [float(bare.count(" ", a, b) + bare.count("\n", a, b) + 1) if b > a else 0.0 for a, b in zip(starts, ends, strict=True)]
    links = {k: [0.0] * n for k in LINKS}
    for kind, own in links.items():
        if ("<a" in bare or "<A" in bare or "</a" in bare) if kind == "html" else "[[" in bare if kind == "wiki" else "](" in bare or "][" in bare:
            for m in LINKS[kind].finditer(bare):
                own[bisect_right(starts, m.start()) - 1] += next((g for g in m.groups() if g is not None), "").count(" ") + 1.0
    loose = {k: [0.0] * n for k in LOOSE}
    for kind, own in loose.items():
        if ("<" if kind == "html" else "\\") in bare:
            for m in LOOSE[kind].finditer(bare):
                own[bisect_right(starts, m.start()) - 1] += 1.0
    counts = [[0.0] * n for _ in KINDS]
    for kind, own in zip(KINDS, counts, strict=True):
        for at in marks(bare, kind):
            own[bisect_right(starts, at) - 1] += 1.0
    share = {k: [min(1.0, x / w) if w else 0.0 for x, w in zip(own, words, strict=True)] for k, own in links.items()}
    density = [max(x) for x in zip(*share.values(), strict=True)]
    out = []
    for i in range(n):
        if words[i]:
            w, d = (words[i - 1], density[i - 1]) if i else (0.0, 0.0)
            x, e = (words[i + 1], density[i + 1]) if i + 1 < n else (0.0, 0.0)
            row = [words[i], density[i], w, d, x, e, bare.count("\n", starts[i], ends[i]) + 1.0, *(own[i] for own in (*counts, *share.values(), *loose.values()))]
            out.append(Block(bare[starts[i] : ends[i]], row))
    return out


@dataclass
class Tree:
    """A decision tree over numeric features (CART, Gini)."""

    feature: int = -1
    at: float = 0.0
    value: bool = False
    low: Tree | None = None
    high: Tree | None = None
    depth: int = field(default=6, repr=False)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, depth: int = 6) -> Tree:
        node = cls(value=bool(y.mean() >= 0.5), depth=depth)
        if depth == 0 or y.all() or not y.any():
            return node
        best, gini = None, lambda v: 2 * v.mean() * (1 - v.mean()) * len(v) if len(v) else 0.0
        base = gini(y)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in values[:-1]:
                low = x[:, f] <= cut
                gain = base - gini(y[low]) - gini(y[~low])
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, f, cut)
        if best is None or best[0] <= 1e-9:
            return node
        low = x[:, best[1]] <= best[2]
        node.feature, node.at = best[1], float(best[2])
        node.low, node.high = cls.fit(x[low], y[low], depth - 1), cls.fit(x[~low], y[~low], depth - 1)
        return node

    def used(self) -> set[str]:
        """The features that it splits on."""
        return {FEATURES[self.feature]} | self.low.used() | self.high.used() if self.feature >= 0 else set()

    def __call__(self, row: list[float]) -> bool:
        node = self
        while node.feature >= 0:
            node = node.low if row[node.feature] <= node.at else node.high
        return node.value


def training() -> tuple[np.ndarray, list[list[str]]]:
    """The features and kinds of the labelled blocks: each alone and between two others, those in context there only."""
    rows, kinds = [], []
    labelled = [(around, text, label) for text, label in LABELLED for around in (text, f"{PROSE[0]}\n\n{text}\n\n{PROSE[1]}", f"{MENU[0]}\n\n{text}\n\n{MENU[1]}")]
    for around, text, label in [*labelled, *((f"{a}\n\n{x}\n\n{b}", x, label) for a, x, b, label in IN_CONTEXT)]:
        rows.append(next(b.row for b in blocks(around) if b.text.strip() == text.strip()))
        kinds.append(label.split())
    return np.array(rows), kinds


@lru_cache(1)
def trees() -> dict[str, Tree]:
    """A tree for each kind, trained on the labelled tables."""
    x, kinds = training()
    return {k: Tree.fit(x, np.array([k in label for label in kinds])) for k in KINDS}


def kinds_of(text: str) -> list[str]:
    """The kinds of markup in a text: those that the trees give any of its blocks."""
    judge, found = trees(), set()
    for b in blocks(text):
        found |= {k for k in KINDS if k not in found and judge[k](b.row)}
    return [k for k in KINDS if k in found]


# Conversion

_KEEP = "\ue100{}\ue101"
_HTML_HEADING = re.compile(r"<h([1-6])\b[^>]*>(.*?)</h\1\s*>", re.I | re.S)
_LATEX_HEADING = re.compile(r"\\(chapter|section|subsection|subsubsection|paragraph)\*?\{([^{}]*)\}")
_DEPTH = {"chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}


_PRE = re.compile(r"<pre\b[^>]*>(?:\s*<code\b[^>]*>)?(.*?)(?:</code\s*>\s*)?</pre\s*>", re.I | re.S)
_CODE = re.compile(r"<code\b[^>]*>(.*?)</code\s*>", re.I | re.S)
_ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,24}|#\d{1,7}|#[xX][0-9A-Fa-f]{1,6});")
_HTML_LIST = re.compile(r"(\s*)<(/?)(ul|ol|li)\b[^>]*>(\s*)", re.I)
_LATEX_LIST = re.compile(r"([ \t\r]*)\\(?:(begin|end)\{(itemize|enumerate|description)\}(?:\[[^\]\n]*\])?|item\b(?:\[([^\]\n]*)\])?)[ \t\r]*\n?[ \t]*")
_VERBATIM = re.compile(r"\\begin\{(verbatim|lstlisting|minted)\*?\}(?:\[[^\]\n]*\])?(?:\{\w+\})?[ \t\r]*\n?(.*?)\n?[ \t]*\\end\{\1\*?\}", re.S)
_DISPLAY = re.compile(r"\\begin\{(equation|align|gather|multline|displaymath|eqnarray)(\*?)\}\s*(.*?)\s*\\end\{\1\2\}|\\\[\s*(.+?)\s*\\\]|\$\$\s*(.+?)\s*\$\$", re.S)
_FORMULA = re.compile(r"\\\((.+?)\\\)|(?<![\w$\\])\$(?=[^\s$])([^$\n]*[\\^_{][^$\n]*)(?<=\S)\$(?![\w$])|(?<![\w$\\])\$([A-Za-z](?:\s*[=<>+*/-]\s*[\w.]+)*)\$(?!\w)")


def _bare(t: str) -> str:
    """Code of an HTML page without its elements and entities."""
    return html.unescape(re.sub(r"<[^>]+>", "", t))


class _Items:
    """Markers of nested lists: ``-`` or running numbers, indented by what stands above."""

    def __init__(self) -> None:
        self.open: list[list] = []

    def begin(self, numbered: bool) -> None:
        self.open.append([numbered, 0])

    def end(self) -> None:
        if self.open:
            self.open.pop()

    def item(self) -> str:
        if not self.open:
            return "- "
        self.open[-1][1] += 1
        return "".join("   " if n else "  " for n, _ in self.open[:-1]) + (f"{self.open[-1][1]}. " if self.open[-1][0] else "- ")


def _html_lists(t: str) -> str:
    lists = _Items()

    def put(m: re.Match) -> str:
        before, closing, tag, after = m.group(1), bool(m.group(2)), m.group(3).lower(), m.group(4)
        if tag == "li":
            return "" if closing else "\n" + lists.item()
        if closing:
            lists.end()
        else:
            lists.begin(tag == "ol")
        if lists.open and not (len(lists.open) == 1 and not closing):
            return ""  # between items of an outer list
        return ("\n\n" if (before if not closing else after).count("\n") > 1 else "\n") if closing or before else ""

    return _HTML_LIST.sub(put, t)


def _from_html(t: str) -> str:
    t = re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<!doctype[^>]*>", "", t, flags=re.I | re.S)
    t = _HTML_HEADING.sub(lambda m: f"\n{'#' * int(m.group(1))} {m.group(2).strip()}\n", t)
    starts = t.startswith("\n")
    t = _html_lists(t)
    t = t if starts else t.lstrip("\n")
    t = re.sub(r"<img\b[^>]*\balt=[\"']?([^\"'>]*)[\"']?[^>]*>", r"\1", t, flags=re.I)
    t = re.sub(r"<br\s*/?>|</(?:p|div|tr|table|section|article)\s*>", "\n", t, flags=re.I)
    t = re.sub(r"</t[dh]\s*>", "\t", t, flags=re.I)
    t = re.sub(rf"</?(?:{'|'.join(TAGS)})(?=[\s/>])[^<>]*>", "", t, flags=re.I)
    return _ENTITY.sub(lambda m: html.unescape(m.group()), t)


def _from_wiki(t: str, lists: bool = True) -> str:
    if lists:  # numbers run on until another line; a deeper list starts anew
        counts: list[int] = []
        out = []
        for line in t.split("\n"):
            m = re.match(r"([*#]+)[ \t]*(?=\S)(.*)", line)
            if m:
                depth = len(m.group(1))
                counts = [*counts[:depth], *[0] * (depth - len(counts))]
                counts[-1] += 1
                line = "".join("   " if c == "#" else "  " for c in m.group(1)[:-1]) + (f"{counts[-1]}. " if m.group(1)[-1] == "#" else "- ") + m.group(2)
            else:
                counts = []
            out.append(line)
        t = "\n".join(out)
    t = re.sub(r"^(={2,6})\s*(.*?)\s*\1[ \t\r]*$", lambda m: f"{'#' * len(m.group(1))} {m.group(2)}", t, flags=re.M)
    t = re.sub(r"'{5}(?=\S)(.+?)'{5}|'{3}(?=\S)(.+?)'{3}|'{2}(?=\S)(.+?)'{2}", lambda m: next(g for g in m.groups() if g), t)
    t = re.sub(r"\[\[(?:[^\]|\n]*\|)?([^\]\n]*)\]\]", r"\1", t)
    t = re.sub(r"^\{\|[^\n]*\n(.*?)(?:^\|\}[^\n]*\n?|\Z)", lambda m: re.sub(r"^[|!]\s?(?=\S)", "", re.sub(r"^\|[-+].*\n?", "", m.group(1), flags=re.M), flags=re.M), t, flags=re.M | re.S)
    return re.sub(r"^[;:]+[ \t]*(?=\S)", "", t, flags=re.M)


def _from_latex(t: str) -> str:
    t = _LATEX_HEADING.sub(lambda m: f"{'#' * _DEPTH[m.group(1)]} {m.group(2)}", t)
    lists = _Items()

    def put(m: re.Match) -> str:
        if m.group(2):
            lists.begin(m.group(3) == "enumerate") if m.group(2) == "begin" else lists.end()
            return ""
        return lists.item() + (f"{m.group(4)} " if m.group(4) else "")

    t = _LATEX_LIST.sub(put, t)
    t = re.sub(r"\\(?:begin|end)\{(?:center|document|abstract|quote|figure|table)\*?\}(?:\[[^\]\n]*\])?[ \t\r]*\n?", "", t)
    before = None
    while before != t:  # from the innermost group outwards
        before = t
        t = re.sub(r"\\(?:textbf|textit|texttt|textsc|textsl|emph|underline|textrm|textsf|textup|mbox)\{([^{}]*)\}", r"\1", t)
        t = re.sub(r"\{\\(?:bf|it|em|tt|sc|rm|sf|sl)\s+([^{}]*)\}", r"\1", t)
        t = re.sub(r"\\footnote\{([^{}]*)\}", r" (\1)", t)
        t = re.sub(r"\\href\{[^{}]*\}\{([^{}]*)\}|\\url\{([^{}]*)\}", lambda m: m.group(1) or m.group(2) or "", t)
    t = re.sub(r"~?\\(?:cite|ref|label|pageref|eqref)\{[^{}]*\}", "", t)
    t = re.sub(r"\\\\(?:\[-?\d[^\]\n]*\])?[ \t\r]*$", "", t, flags=re.M)
    return re.sub(r"\\([%&#$_{}])", r"\1", t)


def _from_markdown(t: str) -> str:
    t = re.sub(r"\\([*_#\[\]`~>!{}+.()|-])", lambda m: _KEEP.format(format(ord(m.group(1)), "x")), t)
    t = re.sub(r"!?\[([^\[\]\n]*)\]\([^()\s]*(?:\([^()\s]*\)[^()\s]*)*(?:\s+[\"'(][^\n]*?[\"')])?\)", r"\1", t)
    t = re.sub(r"!?\[([^\[\]\n]+)\]\[[^\[\]\n]*\]", r"\1", t)
    t = re.sub(r"^ {0,3}\[[^\]\n]+\]:.*\n?", "", t, flags=re.M)
    t = re.sub(r"\[\^[^\]\s]+\]", "", t)
    t = re.sub(r"<((?:https?|ftp|mailto):[^\s<>]+)>", r"\1", t)
    t = re.sub(r"^ {0,3}(?:> ?)+", "", t, flags=re.M)
    t = re.sub(r"^(\s*(?:[-*+]|\d+[.)])\s+)\[[ xX]\]\s+", r"\1", t, flags=re.M)
    t = re.sub(r"^[ \t]*\|?(?:[ \t]*:?-{3,}:?[ \t]*\|)+.*\n?", "", t, flags=re.M)
    t = re.sub(r"^[ \t]*\|(.*)\|[ \t\r]*$", lambda m: "\t".join(c.strip() for c in m.group(1).split("|")), t, flags=re.M)
    t = re.sub(r"(?<![\\*\w])(\*{1,3})(?=[^\s*])([^*\n]*?)(?<=[^\s*])\1(?![*\w])", r"\2", t)
    t = re.sub(r"(?<![\\\w])(_{1,3})(?=[^\s_])([^\n]*?)(?<=[^\s_])\1(?!\w)", r"\2", t)
    t = re.sub(r"~~(?=\S)([^~\n]+)~~", r"\1", t)
    return re.sub("\ue100([0-9a-f]+)\ue101", lambda m: chr(int(m.group(1), 16)), t)


_SPAN = re.compile("\ue102(\\d+)\ue103")


def clean_text(text: str) -> str:
    """The text without markup. Headings become ``#`` lines, lists ``-`` or ``1.`` lines with their nesting, formulas
    ``$`` or ``$$``, code of other markup fenced or inline; fenced and inline code stay as they are. Blocks are judged
    where they stand; what the kinds found write over several blocks (lists, environments) is converted as a whole. In
    a wiki text without Markdown, ``#`` and ``*`` begin list items."""
    kept: list[str] = []

    def keep(value: str) -> str:
        kept.append(value)
        return f"\ue102{len(kept) - 1}\ue103"

    if any("\ue100" <= c <= "\ue103" for c in text):
        text = re.sub("[\ue100-\ue103]", "", text)
    kinds = set(kinds_of(text))
    if not kinds:
        return text
    t = INLINE.sub(lambda m: keep(m.group()), FENCE.sub(lambda m: keep(m.group()), text))
    if "latex" in kinds:
        t = _VERBATIM.sub(lambda m: keep(f"```\n{m.group(2)}\n```"), t)
        t = re.sub(r"\\verb\*?([^\w\s*])(.*?)\1", lambda m: keep(f"`{m.group(2)}`"), t)
        t = _DISPLAY.sub(lambda m: keep("$$" + re.sub(r"\s*\\label\{[^{}]*\}", "", m.group(3) or m.group(4) or m.group(5) or "").strip() + "$$"), t)
        t = _FORMULA.sub(lambda m: keep(f"${m.group(1) or m.group(2) or m.group(3)}$"), t)
    if "html" in kinds:
        t = _PRE.sub(lambda m: keep(f"\n```\n{_bare(m.group(1)).strip(chr(10))}\n```\n"), t)
        t = _CODE.sub(lambda m: keep(f"`{_bare(m.group(1))}`"), t)
    if "wiki" in kinds:
        t = _from_wiki(t, lists="markdown" not in kinds)
    for kind, convert in (("latex", _from_latex), ("markdown", _from_markdown), ("html", _from_html)):
        if kind in kinds:
            t = convert(t)
    while _SPAN.search(t):
        t = _SPAN.sub(lambda m: kept[int(m.group(1))], t)
    return t


def markup_kinds(df: DataFrame, id_col: str = "concept_id", text: str = "content") -> DataFrame:
    """``(id_col, markup)``: each kind of markup (html, markdown, wiki, latex) in each text, code left out.

    A text is cut into flat blocks; each has its word count and link density, its neighbours', how many marks of each
    kind it shows, and how many that only look like marks. Trees trained on LABELLED and IN_CONTEXT say which kinds it
    is written in: links tell by their density, and what only looks like a mark by what stands around the block. One pass; the rows
    shuffled are one id and kind each. Null and empty texts give no rows, repeated rows one each.
    """
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("markup", T.StringType())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        hits = [(k, kind) for k, t in enumerate(batch.column(1).to_pylist()) if t for kind in kinds_of(t)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k for k, _ in hits], pa.int64())), pa.array([x for _, x in hits], pa.string())], schema.names)

    return df.select(F.col(id_col), F.col(text).cast("string").alias("_text")).mapInArrow(per_slice(work, "_text"), schema).distinct()


def clean_texts(df: DataFrame, id_col: str = "concept_id", text: str = "content") -> DataFrame:
    """``(id_col, text)``: every text as clean text; null stays null, empty empty, repeated rows come again."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([clean_text(t) if t else t for t in batch.column(1).to_pylist()], pa.string())], schema.names)

    return df.select(F.col(id_col), F.col(text).cast("string").alias("_text")).mapInArrow(per_slice(work, "_text"), schema)
