"""HTML trees as Markdown: ATX headings, ``-`` bullets, fenced code, pipe tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import urljoin

from foliant.operators.dom import Node

_SPACE = re.compile(r"\s+")
_BLOCKS = frozenset("address article aside blockquote body dd details div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table ul".split())


def absolute_src(src: str, base: str) -> str:
    if src.startswith("data:"):
        return src
    try:
        return urljoin(base, src)
    except ValueError:
        return src


class Renderer:
    """Renders one tree; ``link`` says what stands for the n-th href."""

    def __init__(self, base: str, link: Callable[[int, str], str]) -> None:
        self.base, self.link, self.links = base, link, 0

    def __call__(self, node: Node) -> str:
        text = self.blocks(node)
        text = re.sub(r"[ \t]+\n", lambda m: m.group() if m.group() == "  \n" else "\n", text)
        return re.sub(r"\n{3,}", "\n\n", text).strip()

    def blocks(self, node: Node) -> str:
        out, line = [], []

        def flush() -> None:
            text = "".join(line).strip(" ")
            line.clear()
            if text.strip():
                out.append(text.strip("\n"))

        for x in node.children:
            if x.tag in _BLOCKS:
                flush()
                text = self.block(x)
                if text.strip():
                    out.append(text)
            else:
                line.append(self.inline(x))
        flush()
        return "\n\n".join(out)

    def block(self, x: Node) -> str:
        tag = x.tag
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            text = _SPACE.sub(" ", self.inlines(x)).strip()
            return f"{'#' * int(tag[1])} {text}" if text else ""
        if tag == "pre":
            code = next((c for c in x.children if c.tag == "code"), None)
            name = next((c[9:] for c in code.classes if c.startswith("language-")), "") if code is not None else ""
            text = "".join(x.strings()).strip("\n")
            fence = "`" * max(3, 1 + max((len(m) for m in re.findall(r"`+", text)), default=0))
            return f"{fence}{name}\n{text}\n{fence}"
        if tag in ("ul", "ol"):
            return self.items(x)
        if tag == "blockquote":
            return "\n".join(f"> {line}".rstrip() for line in self.blocks(x).split("\n"))
        if tag == "table":
            return self.table(x)
        if tag == "hr":
            return "---"
        if any(c.tag in _BLOCKS for c in x.children):
            return self.blocks(x)
        return self.tidy(self.inlines(x))

    @staticmethod
    def tidy(text: str) -> str:
        return "\n".join(line.strip(" ") + "  " * line.endswith("  ") for line in text.split("\n")).strip()

    def items(self, x: Node) -> str:
        out, number = [], int(x.attrs.get("start", "1")) if x.attrs.get("start", "1").isdigit() else 1
        for item in (c for c in x.children if c.tag == "li"):
            mark = "- " if x.tag == "ul" else f"{number}. "
            number += 1
            parts, line = [], []
            for c in item.children:
                if c.tag in _BLOCKS:
                    if "".join(line).strip():
                        parts.append(self.tidy("".join(line)))
                    line = []
                    parts.append(self.block(c))
                else:
                    line.append(self.inline(c))
            if "".join(line).strip():
                parts.append(self.tidy("".join(line)))
            text = "\n".join(p for p in parts if p.strip())
            out.append(mark + text.replace("\n", "\n" + " " * len(mark)))
        return "\n".join(out)

    def table(self, x: Node) -> str:
        rows = [[self.tidy(self.inlines(c)).replace("\n", " ").replace("|", "\\|") for c in r.children if c.tag in ("td", "th")] for r in x.walk() if r.tag == "tr"]
        rows = [r for r in rows if r]
        if not rows:
            return self.tidy(self.inlines(x))
        width = max(map(len, rows))
        line = lambda r: "| " + " | ".join([*r, *[""] * (width - len(r))]) + " |"
        return "\n".join([line(rows[0]), "| " + " | ".join(["---"] * width) + " |", *map(line, rows[1:])])

    def inlines(self, x: Node) -> str:
        return "".join(self.inline(c) for c in x.children)

    def inline(self, x: Node) -> str:
        if not x.tag:
            return re.sub(r"([*_])", r"\\\1", _SPACE.sub(" ", x.text))
        tag = x.tag
        if tag in ("script", "style", "template", "head", "noscript"):
            return ""
        if tag == "br":
            return "  \n"
        if tag in ("code", "kbd", "samp", "tt"):
            text = "".join(x.strings())
            ticks = "`" * (1 + max((len(m) for m in re.findall(r"`+", text)), default=0))
            return f"{ticks}{text}{ticks}" if text.strip() else ""
        if tag == "img":
            title = f' "{x.attrs["title"]}"' if x.attrs.get("title") else ""
            return f"![{x.attrs.get('alt', '')}]({absolute_src(x.attrs.get('src', ''), self.base)}{title})" if x.attrs.get("src") else ""
        text = self.blocks(x) if tag in _BLOCKS else self.inlines(x)
        if tag == "a" and "href" in x.attrs:
            at = self.links
            self.links += 1
            title = f' "{x.attrs["title"]}"' if x.attrs.get("title") else ""
            shown = _SPACE.sub(" ", text).strip()
            return f"[{shown}]({self.link(at, x.attrs['href'])}{title})" if shown else ""
        mark = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~"}.get(tag)
        if mark and text.strip():
            body = text.strip()
            return f"{text[: len(text) - len(text.lstrip())]}{mark}{body}{mark}{text[len(text.rstrip()) :]}"
        return text
