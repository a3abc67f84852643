import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm.bpe import Encoder, Merger, encode_ids, load_ranks, vocabulary_path
from foliant.llm.lines import site
from foliant.llm.pieces import cuts, oversized, reached, text_pieces
from foliant.llm.repeated import frequent_lines, repeated_lines, without_repeated_lines

COLUMNS = "concept_id long, resource string, content string, site string, line string"
NOTE = "This long notice is on every page number {} of ours"


def pages(spark):
    rows = [(i, f"https://{'WWW.' if i % 2 else ''}A.example{':443' if i % 3 else ''}/p{i}", f"own text {i}\n  {NOTE.format(i)}  \nshort", "x", "y") for i in range(6)]
    rows += [rows[0], (20, "https://a.example/n", None, None, None), (21, "https://a.example/e", "", None, None), (22, None, NOTE, None, None), (23, "https://b.example/", NOTE.upper(), None, None)]
    return spark.createDataFrame(rows, COLUMNS)


def test_site(spark):
    d = spark.createDataFrame([("HTTPS://u@WWW.Docs.X.example:8/p",), ("//x.y",), ("no host",), (None,), ("https:///p",)], "u string")
    assert [r[0] for r in d.select(site(F.col("u"))).collect()] == ["docs.x.example", "x.y", None, None, None]


def test_repeated_lines(spark):
    got = sorted(map(tuple, repeated_lines(pages(spark)).collect()))
    assert got == [(i, 2) for i in range(6)]
    assert repeated_lines(pages(spark), min_docs=7).count() == 0  # rows of one id count once
    assert repeated_lines(pages(spark), min_share=0.76).count() == 0  # null and empty pages count: 6 of 8
    assert repeated_lines(pages(spark), min_share=0.75).count() == 6
    assert repeated_lines(pages(spark).limit(0)).count() == 0


def test_lines_are_removed_in_place(spark):
    d = pages(spark)
    out = without_repeated_lines(d)
    assert out.columns == d.columns and out.count() == d.count()
    got = {r.concept_id: r.content for r in out.collect()}
    assert got[0] == "own text 0\nshort" and got[20] is None and got[21] == "" and got[22] == NOTE
    with pytest.raises(ValueError):
        without_repeated_lines(d.withColumn("_site", F.lit(1)))


def test_the_way_without_broadcast_agrees(spark):
    want, clean = sorted(repeated_lines(pages(spark)).collect()), sorted(without_repeated_lines(pages(spark)).collect(), key=str)
    assert sorted(repeated_lines(pages(spark), max_broadcast_lines=0).collect()) == want
    assert sorted(without_repeated_lines(pages(spark), max_broadcast_lines=0).collect(), key=str) == clean
    assert frequent_lines(pages(spark), "concept_id", "content", "resource").count() == 1


def check_pieces(text, spans, limit, overlap):
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b), (c, d) in zip(spans, spans[1:], strict=False):
        assert c == b - overlap and d > b
    assert all(b - a <= limit for a, b in spans)


def test_cuts_cover_every_text():
    r = random.Random(3)
    texts = ["a" * 20_000, "ab " * 5_000, "x" * 401, "é\n\n" * 900, "word. " * 400 + "y" * 3_000, "日本。" * 700]
    texts += ["".join(r.choice(["a", "b ", ". ", "\n", "\n\n", "cccc"]) for _ in range(r.randint(300, 4_000))) for _ in range(40)]
    texts = [t for t in texts if len(t) > 400]
    for text, spans in zip(texts, cuts(texts, 400, 50), strict=True):
        check_pieces(text, spans, 400, 50)
    one = [cuts([t], 400, 50)[0] for t in texts]
    assert one == cuts(texts, 400, 50)  # texts don't touch each other


def test_cuts_prefer_better_boundaries():
    text = "One sentence here. " * 15 + "\n\n" + "Other words " * 60
    first = cuts([text], 400, 50)[0][0]
    assert text[: first[1]].endswith("\n\n")


def test_reached_is_the_plain_walk():
    r = np.random.default_rng(1)
    for _ in range(50):
        n = int(r.integers(2, 200))
        nxt = np.minimum(np.arange(n) + r.integers(1, 9, n), n - 1)
        want, at = {0}, 0
        while nxt[at] != at:
            at = int(nxt[at])
            want.add(at)
        assert set(np.flatnonzero(reached(nxt, np.array([0])))) == want


def test_pieces_of_rows(spark):
    long = "word " * 2_000
    d = spark.createDataFrame([(1, long, 0), (1, long, 0), (2, "", 0), (3, None, 0), (4, "x" * 4_000, 0), (5, "x" * 4_001, 0)], "concept_id long, content string, piece_no int")
    got = text_pieces(d).collect()
    by = {}
    for r in got:
        by.setdefault(r.concept_id, []).append(r)
    assert len(by[2]) == len(by[3]) == len(by[4]) == 1 and len(by[5]) == 2 and by[3][0].piece is None and by[2][0].piece == ""
    mine = sorted({(r.piece_no, r.start, r.piece) for r in by[1]})
    assert "".join([mine[0][2], *(p[200:] for _, _, p in mine[1:])]) == long
    assert sorted(r[0] for r in oversized(d).collect()) == [1, 5]
    assert text_pieces(d.limit(0)).count() == 0
    with pytest.raises(ValueError):
        text_pieces(d, limit=100, overlap=50)


TEXTS = ["", "plain words, it's 'll 12 345", "a_b __init__ \ue000_x", "½ ² Ⅷ \x1c\x1d", "  \n\n\t tabs  ", "日本語 emoji 🙂‍💻 é ê", "<|endoftext|> x", "z" * 300, " " * 90, "١٢٣ ②"]


def test_ids_agree_with_a_reference_encoder():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    r = random.Random(5)
    texts = TEXTS + ["".join(r.choice("abcdeins t_'\n.,ßéж🙂0123 ") for _ in range(r.randint(1, 400))) for _ in range(200)]
    got = Encoder(vocabulary_path()).column([*texts, None]).to_pylist()
    assert got[-1] is None
    assert got[:-1] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    small = Encoder(vocabulary_path(), keep=5).column(texts).to_pylist()  # a memory of five words changes nothing
    assert small == got[:-1]


def test_short_and_long_words_merge_alike():
    m, r = Merger(load_ranks(vocabulary_path())), random.Random(6)
    for _ in range(200):
        w = bytes(r.choice(b"abcdeinst \xc3\xa9") for _ in range(r.randint(2, 150)))
        assert m._short(w) == m._long(w)


def test_encode_rows(spark):
    d = spark.createDataFrame([(1, "a b", 7), (1, "a b", 7), (2, "", 7), (3, None, 7)], "doc_id long, text string, ids long")
    assert sorted((r.doc_id, r.ids) for r in encode_ids(d).collect() if r.ids is not None) == [(1, [64, 275]), (1, [64, 275]), (2, [])]
    assert encode_ids(d).filter("ids is null").collect()[0].doc_id == 3
    assert encode_ids(d.limit(0)).count() == 0
    assert re.match(r".*\.tiktoken$", vocabulary_path())
