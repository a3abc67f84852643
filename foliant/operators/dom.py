"""A small HTML tree with selectors, and what is read off it: title, main content, links, labels, code blocks.

The tree follows the tolerant rules of plain tag events: no end tag is implied, an end tag closes the nearest open
element of its name and is ignored if none is open, void elements never stay open, the last of repeated attributes wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: What is site chrome on a page, wherever it stands.
CHROME_SELECTORS = [
    "nav",
    "header",
    "footer",
    "[role='navigation']",
    "[role='banner']",
    "[role='contentinfo']",
    ".sidebar",
    ".toc",
    ".on-this-page",
    "[class*='copy-button']",
    "button.copy-button",
    ".copy-button",
    "[aria-label='breadcrumb']",
    ".breadcrumb",
    ".breadcrumbs",
    ".edit-page",
    ".feedback",
    ".page-nav",
    ".DocSearch",
]
#: Where a page's content is, best first.
CONTENT_SELECTORS = ["main", "[role='main']", "article", ".content", ".doc-content", ".documentation", ".docs-content", ".markdown-body", "#content", "#main-content"]
#: Line numbers beside code.
GUTTER_SELECTORS = [".line-numbers-rows", ".gutter", ".linenodiv", "td.linenos"]
#: Class names of the current link of a menu, and languages that say nothing.
CURRENT_CLASSES = ["active", "current", "is-active", "is-current", "selected"]
NO_LANGUAGE = frozenset({"none", "plaintext", "text"})
LANGUAGE_PREFIXES = ["language-", "lang-", "highlight-"]


class Node:
    """An element, or a text node if ``tag`` is empty."""

    __slots__ = ("tag", "attrs", "children", "parent", "text")

    def __init__(self, tag: str = "", attrs: dict[str, str] | None = None, text: str = "") -> None:
        self.tag, self.attrs, self.text = tag, attrs or {}, text
        self.children: list[Node] = []
        self.parent: Node | None = None

    def append(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children.remove(self)
            self.parent = None

    def replace(self, others: list[Node]) -> None:
        parent = self.parent
        at = parent.children.index(self)
        parent.children[at : at + 1] = others
        for x in others:
            x.parent = parent
        self.parent = None

    def walk(self) -> Iterator[Node]:
        """The elements below, in document order; the tree may lose nodes meanwhile."""
        stack = list(reversed(self.children))
        while stack:
            node = stack.pop()
            if node.tag:
                yield node
                stack += reversed(node.children)

    def find(self, *tags: str) -> Node | None:
        return next((x for x in self.walk() if x.tag in tags), None)

    def strings(self) -> Iterator[str]:
        for x in self.children:
            if not x.tag:
                yield x.text
            elif x.tag not in ("script", "style"):
                yield from x.strings()

    def stripped(self) -> str:
        """The text with each node's outer white space removed, joined without a separator."""
        return "".join(s.strip() for s in self.strings())

    @property
    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("[document]")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = self.at.append(Node(tag, {k: v or "" for k, v in attrs}))
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.append(Node(text=data))


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


_SIMPLE = re.compile(r"([a-zA-Z][\w-]*)?((?:\.[\w-]+)*)(?:#([\w-]+))?(?:\[([\w-]+)(\*?)='([^']*)'\])?$")


def matcher(selector: str):
    """A predicate for ``tag``, ``.class``, ``#id``, ``[attr='v']``, ``[attr*='v']`` and their compounds."""
    m = _SIMPLE.match(selector)
    if not m or not selector:
        raise ValueError(f"selector not known: {selector}")
    tag, dotted, ident, attr, part, value = m.groups()
    wanted = [c for c in dotted.split(".") if c]

    def test(x: Node) -> bool:
        if tag and x.tag != tag or ident and x.attrs.get("id") != ident:
            return False
        own = x.classes
        if any(c not in own for c in wanted):
            return False
        if attr:
            have = x.attrs.get(attr)
            return have is not None and (value in have if part else have == value)
        return True

    return test


_CHROME = [matcher(s) for s in CHROME_SELECTORS]
_CONTENT = [matcher(s) for s in CONTENT_SELECTORS]
_GUTTER = [matcher(s) for s in GUTTER_SELECTORS]


def title_of(root: Node) -> str:
    """The first h1 anywhere, else the title element; taken before anything is removed."""
    h1, title = root.find("h1"), root.find("title")
    return h1.stripped() if h1 is not None else title.stripped() if title is not None else ""


def content_of(root: Node) -> Node:
    """The page's content: chrome is taken out of the whole page, then the best selector wins."""
    for x in list(root.walk()):
        if any(t(x) for t in _CHROME):
            x.remove()
    elements = list(root.walk())
    for test in _CONTENT:
        found = next((x for x in elements if test(x)), None)
        if found is not None:
            return found
    return next((x for x in elements if x.tag == "body"), root)


def hrefs(root: Node) -> list[str]:
    return [x.attrs["href"] for x in root.walk() if x.tag == "a" and "href" in x.attrs]


# Code blocks


def language_of(x: Node) -> str:
    for name in ("data-lang", "data-language"):
        if x.attrs.get(name, "").strip():
            return x.attrs[name].strip()
    for name in x.classes:
        for prefix in LANGUAGE_PREFIXES:
            if name.startswith(prefix) and name[len(prefix) :] and name[len(prefix) :] not in NO_LANGUAGE:
                return name[len(prefix) :]
    return ""


def _clean_pre(pre: Node) -> Node:
    code = pre.find("code")
    language = (language_of(code) if code is not None else "") or language_of(pre)
    for x in list(pre.walk()):
        if x.tag == "button" or any(t(x) for t in _GUTTER):
            x.remove()
    made = Node("pre", {"clean": "1"})
    made.append(Node("code", {"class": f"language-{language}"} if language else {})).append(Node(text="".join(pre.strings())))
    return made


def _expand(container: Node, labels: list[str], panels: list[Node], content: Node) -> None:
    """Each panel's code under its label, in place of the container; panels without code are dropped."""
    out: list[Node] = []
    for i, panel in enumerate(panels):
        for pre in [panel] if panel.tag == "pre" else [x for x in panel.walk() if x.tag == "pre"][:1]:
            label = Node("p")
            label.append(Node("strong")).append(Node(text=labels[i] if i < len(labels) and labels[i] else f"Tab {i + 1}"))
            out += [label, _clean_pre(pre)]
    if container is content:  # the content itself is kept, with the panels for children
        container.children = []
        for x in out:
            container.append(x)
    elif container.parent is not None:
        container.replace(out)


def clean_code(root: Node, content: Node) -> None:
    """Tab sets, then ARIA tabs, then every other pre as one plain ``pre > code.language-x``."""
    for x in [x for x in root.walk() if "tabbed-set" in x.classes]:
        labels = [y.stripped() for z in x.walk() if "tabbed-labels" in z.classes for y in z.walk() if y.tag == "label"]
        _expand(x, labels, [y for y in x.walk() if "tabbed-block" in y.classes], content)
    for x in [x for x in root.walk() if x.attrs.get("role") == "tablist"]:
        box = x.parent
        if box is None or box.tag in ("html", "body", "[document]"):
            continue
        labels = [y.stripped() for y in x.walk() if y.attrs.get("role") == "tab"]
        _expand(box, labels, [y for y in box.walk() if y.attrs.get("role") == "tabpanel"], content)
    for x in [x for x in root.walk() if x.tag == "pre"]:
        if x.parent is not None and not x.attrs.pop("clean", ""):
            x.replace([_clean_pre(x)])


# Labels of the current page in the site's menus


def _current_link(menus: list[Node], url: str) -> tuple[Node, Node] | None:
    links = [(m, a) for m in menus for a in m.walk() if a.tag == "a"]
    for m, a in links:
        if "aria-current" in a.attrs:
            return m, a
    for m in menus:
        for name in CURRENT_CLASSES:
            found = next((a for a in m.walk() if a.tag == "a" and name in a.classes), None)
            if found is not None:
                return m, found
    own = urlparse(url).path.rstrip("/")
    for m, a in links:
        if "href" in a.attrs:
            try:
                there = urlparse(urljoin(url, a.attrs["href"])).path.rstrip("/")
            except ValueError:
                continue
            if there == own:
                return m, a
    return None


def nav_path(root: Node, url: str) -> list[str]:
    """The labels above the current page's link in a nav or aside, outermost first: before each element around the
    link, up to the menu, the nearest label that stands beside it and has a text."""
    found = _current_link([x for x in root.walk() if x.tag in ("nav", "aside")], url)
    if found is None:
        return []
    menu, link = found
    out: list[str] = []
    node = link.parent
    while node is not menu and node is not None and node.parent is not None:
        at = node.parent.children.index(node)
        for before in reversed(node.parent.children[:at]):
            if before.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "summary", "strong", "button") and before.stripped():
                out.append(before.stripped())
                break
        node = node.parent
    return out[::-1]
