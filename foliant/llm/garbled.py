"""Text decoded with a wrong character encoding: a hidden Markov model labels it, inverse transforms restore it."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.lines import slices
from foliant.scale import cut

#: Fixed values: (true encoding, encoding it was taken for), one state of the model each.
PAIRS = [
    ("utf-8", "cp1252"),
    ("utf-8", "latin-1"),
    ("utf-8", "cp1250"),
    ("utf-8", "cp1251"),
    ("utf-8", "cp437"),
    ("utf-8", "cp850"),
    ("utf-8", "mac_roman"),
    ("utf-8", "koi8_r"),
    ("utf-8", "cp866"),
    ("utf-8", "cp1253"),
    ("cp1251", "cp1252"),
    ("cp1251", "latin-1"),
    ("cp1251", "koi8_r"),
    ("koi8_r", "cp1252"),
    ("koi8_r", "latin-1"),
    ("koi8_r", "cp1251"),
    ("cp866", "cp1251"),
    ("cp866", "cp1252"),
    ("cp1252", "cp437"),
    ("cp1252", "cp850"),
    ("cp1252", "mac_roman"),
    ("cp1252", "cp1251"),
    ("cp437", "cp1252"),
    ("mac_roman", "cp1252"),
    ("shift_jis", "cp1252"),
    ("shift_jis", "latin-1"),
    ("euc_jp", "cp1252"),
    ("euc_jp", "latin-1"),
    ("gbk", "cp1252"),
    ("gbk", "latin-1"),
    ("euc_kr", "cp1252"),
    ("big5", "cp1252"),
]
UTF8_PAIRS = [p for p in PAIRS if p[0] == "utf-8"]
ALIKE = {"utf-8", "cp1252", "cp437", "mac_roman"}
CYRILLIC = {"cp1251", "koi8_r", "cp866"}
LOST = "�"
CODE = re.compile(r"(`+)(?!`)(?:(?!\1)[^\n])*?[^`\n]\1(?!`)")
FENCE = re.compile(r"^[ \t]*(```|~~~)", re.M)
RUN = re.compile(r"[^\x00-\x7f]+")
CONTROL = re.compile(r"[\x80-\x84\x86-\x9f]")
_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")


def _byte_of(encoding: str) -> dict[str, int]:
    """The byte behind each character of a single-byte encoding; bytes it leaves undefined pass as C1 controls."""
    out = {chr(b): b for b in range(0x80)}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


BYTE = {wrong: _byte_of(wrong) for wrong in dict.fromkeys(w for _, w in PAIRS)}


def invert(run: str, true: str, wrong: str) -> str | None:
    """A run of characters as it was before ``true`` was taken for ``wrong``; null if that can't be or changes nothing.

    For UTF-8 only the parts that are whole sequences change, so that clean characters may stand beside them.
    """
    table = BYTE[wrong]
    if true != "utf-8":
        try:
            return bytes(map(table.__getitem__, run)).decode(true)
        except (KeyError, UnicodeDecodeError):
            return None
    raw = bytes(table.get(c, 0) for c in run)  # 0 is no part of a sequence
    out, last = [], 0
    for m in _UTF8.finditer(raw):
        out += [run[last : m.start()], m.group().decode("utf-8")]
        last = m.end()
    return "".join([*out, run[last:]]) if last else None


#: Encodings in which a character may end in an ASCII byte: pairs of bytes (and single ones) that make a stretch of text.
TRAILED = {
    "shift_jis": re.compile(rb"(?:[\x81-\x9f\xe0-\xef][\x40-\x7e\x80-\xfc]|[\xa1-\xdf])+"),
    "big5": re.compile(rb"(?:[\xa1-\xf9][\x40-\x7e\xa1-\xfe])+"),
}
_LATIN = {w: {ord(c): b for c, b in BYTE[w].items()} for w in ("cp1252", "latin-1")}


def stretches(text: str) -> list[tuple[int, int]]:
    """Where a text can be one of TRAILED taken for Latin, of three characters and more with ASCII ends among them and
    nearly all of a script that it is used for; such a stretch is one unit of the model, ASCII characters included."""
    out: list[tuple[int, int]] = []
    for wrong, table in _LATIN.items():
        raw = text.translate(table).encode("latin-1", "replace")
        for true, pattern in TRAILED.items():
            if (true, wrong) not in PAIRS:
                continue
            for m in pattern.finditer(raw):
                if len(m.group()) < 6 or not any(x < 0x80 for x in m.group()):
                    continue
                try:
                    found = m.group().decode(true)
                except UnicodeDecodeError:
                    continue
                if sum(symbol(c) in "あ漢。" for c in found) >= 0.9 * len(found):
                    out.append(m.span())
    merged: list[tuple[int, int]] = []
    for a, b in sorted(out, key=lambda x: (x[0] - x[1], x)):  # the longest first
        if all(b <= x or a >= y for x, y in merged):
            merged.append((a, b))
    return sorted(merged)


def units(text: str) -> list[tuple[int, int]]:
    """The spans that the model labels: runs of other than ASCII characters, and stretches in place of theirs."""
    runs = [m.span() for m in RUN.finditer(text)]
    wide = stretches(text) if len(runs) > 2 else []
    if not wide:
        return runs
    out = [r for r in runs if all(r[1] <= a or r[0] >= b for a, b in wide)]
    return sorted([*out, *wide])


def symbol(c: str) -> str:
    """A character's symbol in the language model: ASCII and the large scripts by class, others themselves."""
    if c < "\x80":
        return "a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if c.isdigit() else " " if c.isspace() else "."
    n = ord(c)
    if n < 0x2E80:
        return c
    if 0x3040 <= n <= 0x30FF:
        return "あ"
    if 0xFF66 <= n <= 0xFF9F:
        return "ｱ"
    if 0x3400 <= n <= 0x9FFF:
        return "漢"
    if 0xAC00 <= n <= 0xD7A3:
        return "한"
    return "。" if n < 0x3040 or 0xFF00 <= n <= 0xFF65 else "\U0001f642" if n > 0xFFFF else c if unicodedata.category(c)[0] == "C" else "ﬁ"


#: Natural logarithm of a character's share in its symbol, for the symbols that stand for whole scripts.
SHARE = {"あ": -4.0, "ｱ": -4.0, "漢": -7.0, "한": -6.5, "\U0001f642": -6.0, "ﬁ": -6.0, "。": -2.0}


def readings(run: str) -> list[tuple[int, str]]:
    """The states that a run of characters can come from, each with the text behind it."""
    out = []
    for k, (true, wrong) in enumerate(PAIRS):
        text = invert(run, true, wrong)
        if text is None or text == run:
            continue
        found = [text]
        if true == "utf-8":  # decoded wrongly more than once
            for again in found:  # grows while there is another; each is shorter than what it came from
                found += [t for a, b in UTF8_PAIRS if (t := invert(again, a, b)) is not None and t not in found]
        out += [(k, t) for t in found if all(c >= " " and not "\x7f" <= c <= "\x9f" for c in t)]
    return out


def contexts(text: str) -> Iterator[tuple[str, str, str]]:
    """Each run of other than ASCII characters with the character before and after."""
    for m in RUN.finditer(text):
        a, b = m.span()
        yield text[a - 1] if a else "\n", m.group(), text[b] if b < len(text) else "\n"


def _common(c: str) -> bool:
    return ord(c) < 0x530 or 0x2000 <= ord(c) < 0x2200 or 0x2E80 <= ord(c) < 0xFB00


def bigrams(counts: Counter) -> Counter:
    """Pairs of symbols in runs that no UTF-8 reading explains, so that garbled text teaches the model little."""
    out: Counter = Counter()
    doubtful: dict[str, bool] = {}
    for (a, run, b), n in counts.items():
        bad = doubtful.get(run)
        if bad is None:
            bad = LOST in run or CONTROL.search(run) is not None
            for x, w in UTF8_PAIRS:
                t = invert(run, x, w)
                # clean text has a chance sequence now and then; garble gives common signs, and of Cyrillic leaves none
                bad |= t is not None and t != run and all(_common(c) for c in t) and (w not in CYRILLIC or not set(t) & set(run))
            doubtful[run] = bad
        if not bad:
            s = symbol(a) + "".join(map(symbol, run)) + symbol(b)
            for pair in zip(s, s[1:], strict=False):
                out[pair[0] + pair[1]] += n
    return out


@dataclass
class Model:
    """States: 0 clean, k + 1 for PAIRS[k]. Symbols of any state's text follow the bigrams of the clean corpus."""

    pairs: dict[str, int]
    enter: float = 1e-4
    enter_script: float = 1e-9  # a whole other script, with no structure like UTF-8's to check
    leave: float = 0.1
    weight: float = 0.3

    @cached_property
    def firsts(self) -> Counter:
        out: Counter = Counter()
        for pair, n in self.pairs.items():
            out[pair[0]] += n
        return out

    @cached_property
    def seconds(self) -> Counter:
        out: Counter = Counter()
        for pair, n in self.pairs.items():
            out[pair[1]] += n
        return out

    def log_likelihood(self, text: str) -> float:
        total = sum(self.seconds.values()) + 1
        s = "".join(map(symbol, text))
        out = 0.0
        for a, b in zip(s, s[1:], strict=False):
            base = (self.seconds[b] + 1e-3) / total
            out += SHARE.get(b, 0.0) + math.log((self.pairs.get(a + b, 0) + self.weight * base) / (self.firsts[a] + self.weight))
        return out

    def emission(self, before: str, run: str, after: str) -> list[tuple[int, float, str]]:
        """``(state, log-likelihood, text)`` of a run under each state that can give it; the clean one comes first."""
        out = [(0, self.log_likelihood(before + run + after), run)]
        best: dict[int, tuple[float, str]] = {}
        lone = len(run) == 1 and not run.isalpha() and not CONTROL.search(run) and not (before.isalpha() and after.isalpha())
        for k, text in readings(run):
            # a run of n characters stands for fewer ones: each saved character costs what a likely one would
            saved = max(0, len(run) - len(text)) * -1.0
            score = self.log_likelihood(before + text + after) + saved - 0.01 * k
            if lone and PAIRS[k][0] != "utf-8":  # no evidence of another meaning, but no hindrance among others that are
                score = min(score, out[0][1])
            if k not in best or score > best[k][0]:
                best[k] = (score, text)
        out += [(k + 1, *x) for k, x in best.items()]
        if CONTROL.search(run) or LOST in run:  # no clean text has these
            out[0] = (0, out[0][1] - 30, run)
        return out

    def label(self, emissions: list[list[tuple[int, float, str]]]) -> list[int]:
        """The likeliest state of each run of a text (Viterbi)."""
        n = len(PAIRS) + 1
        start = np.array([math.log((self.enter if p[0] in ALIKE else self.enter_script) / (n - 1)) for p in (("", ""), *PAIRS)])
        start[0] = math.log(1 - self.enter)
        move = np.tile(start + math.log(self.leave), (n, 1))
        move[:, 0] = math.log(self.leave)
        np.fill_diagonal(move, math.log(1 - self.leave))
        move[0] = start
        score, back = None, []
        for run in emissions:
            e = np.full(n, -1e9)
            for k, x, _ in run:
                e[k] = x
            if score is None:
                score = start + e
            else:
                ways = score[:, None] + move
                back.append(ways.argmax(0))
                score = ways.max(0) + e
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]


class Repairer:
    """Labels and restores texts; what a run can be is kept for up to ``keep`` distinct runs."""

    def __init__(self, model: Model, keep: int = 200_000) -> None:
        self.model, self.keep, self.known = model, keep, {}

    def emission(self, context: tuple[str, str, str]) -> list[tuple[int, float, str]]:
        short = (symbol(context[0]), context[1], symbol(context[2]))
        found = self.known.get(short)
        if found is None:
            if len(self.known) > self.keep:
                self.known = {}
            found = self.known[short] = self.model.emission(*context)
        return found

    def __call__(self, text: str) -> tuple[bool, str, list[str]]:
        """Whether ``text`` has garbled characters outside inline code, the text restored, and the pairs found."""
        if text.isascii():
            return False, text, []
        seen = CODE.sub(lambda m: "`" * len(m.group()), text) if "`" in text else text
        found = [((a, b), self.emission((seen[a - 1 : a] if a else "\n", seen[a:b], seen[b : b + 1] or "\n"))) for a, b in units(seen)]
        if not any(len(e) > 1 and max(x for _, x, _ in e[1:]) > e[0][1] for _, e in found):
            lost = LOST in seen or CONTROL.search(seen) is not None
            return lost, text, []
        path = self.model.label([e for _, e in found])
        out, last, names = [], 0, []
        for ((a, b), e), state in zip(found, path, strict=True):
            if state:
                out += [text[last:a], next(t for k, _, t in e if k == state)]
                last = b
                names.append("{}>{}".format(*PAIRS[state - 1]))
        fixed = "".join([*out, text[last:]])
        return bool(names) or LOST in seen or CONTROL.search(seen) is not None, fixed, list(dict.fromkeys(names))


def corpus_bigrams(docs: DataFrame, text: str = "text", min_share: float = 5e-6) -> dict[str, int]:
    """Counts of symbol pairs in all texts, of those with at least ``min_share`` of all (so at most 1 / min_share).

    Symbols are classes beyond U+2E80, so what reaches the driver is bounded by the alphabet, not by the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "_text"):
                runs: Counter = Counter()
                for t in part.column(0).to_pylist():
                    if not t.isascii():
                        runs.update(contexts(t))
                out.update(bigrams(runs))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(out)), pa.array(list(out.values()), pa.int64())], ["pair", "n"])

    source = docs.select(F.col(text).cast("string").alias("_text")).filter(F.col("_text").isNotNull())
    rows = cut(source.mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    least = (rows.agg(F.sum("n")).first()[0] or 0) * min_share
    return {r.pair: r.n for r in rows.filter(F.col("n") >= max(2, least)).collect()}


def repaired_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", only_garbled: bool = False) -> DataFrame:
    """``(doc_id, text, garbled, pairs)``: each text with its wrongly decoded spans restored.

    The model has one clean state and one for each encoding pair. A state's text is what its inverse transform gives,
    scored by the bigrams of all clean-looking text of the corpus; Viterbi labels each run of characters. Two passes
    over the texts, no shuffle but that of the bigram counts.

    Defined cases: null stays null, is not garbled; ASCII texts are never garbled; characters in inline code are left
    alone; lost characters (U+FFFD) and stray C1 controls make a text garbled but can't be restored; repeated rows
    are judged again; an empty table gives an empty one.
    """
    model = docs.sparkSession.sparkContext.broadcast(Model(corpus_bigrams(docs, text)))
    schema = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("text", T.StringType()), T.StructField("garbled", T.BooleanType()), T.StructField("pairs", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = Repairer(model.value)
        for batch in batches:
            for part in slices(batch, "_text"):
                rows = [(False, None, []) if t is None else repair(t) for t in part.column(1).to_pylist()]
                keep = [k for k, r in enumerate(rows) if r[0] or not only_garbled]
                if keep:
                    ids = part.column(0).take(pa.array(keep, pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([rows[k][1] for k in keep], pa.string()), pa.array([rows[k][0] for k in keep]), pa.array([" ".join(rows[k][2]) for k in keep])], schema.names)

    source = docs.select(F.col(doc_id), F.col(text).cast("string").alias("_text"))
    if only_garbled:
        source = source.filter(F.col("_text").rlike(r"[^\x00-\x7f]"))
    return source.mapInArrow(run, schema)


def garbled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id,)`` of the texts with wrongly decoded or lost characters, each once."""
    return repaired_texts(docs, doc_id, text, only_garbled=True).select(doc_id).distinct()
