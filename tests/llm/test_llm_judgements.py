import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import boilerplate as B
from foliant.llm import garbled as G
from foliant.llm import leaks as L
from foliant.llm import markup as M
from foliant.llm import residue as R
from foliant.llm import similar as S
from foliant.llm.lines import words_of

WORDS = [f"w{i}" for i in range(60)]


# Near-duplicates


def brute_pairs(rows, n, threshold, least):
    sets = {}
    for i, t in rows:
        w = words_of(t)
        if len(w) >= least:
            sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def edited(r, words, most):
    out = list(words)
    for _ in range(r.randint(0, most)):
        out[r.randrange(len(out))] = r.choice(WORDS)
    return out


@pytest.mark.parametrize(("n", "threshold", "split"), [(3, 0.6, 8_192), (5, 0.8, 8_192), (3, 0.6, 6)])
def test_similar_pairs_are_those_of_brute_force(spark, n, threshold, split):
    r = random.Random(n)
    base = [[r.choice(WORDS) for _ in range(r.randint(45, 160))] for _ in range(25)]
    rows = [(i, " ".join([*edited(r, r.choice(base), 12 if threshold < 0.7 else 3), f"own{i // 3 * 3 if i % 9 == 1 else i}"])) for i in range(120)]
    rows += [(500 + i, rows[i][1].upper()) for i in range(0, 40, 2)]  # copies take part in all links
    d = spark.createDataFrame([(i, None, t) for i, t in rows], "concept_id long, title string, content string")
    got = {tuple(x) for x in S.similar_pairs(d, n=n, threshold=threshold, docs_per_bucket=20, split=split).collect()}
    assert got == brute_pairs(rows, n, threshold, 50) and len(got) > 20


def test_similar_cases(spark):
    text = " ".join(WORDS)
    d = spark.createDataFrame([(3, "T", text, 1), (1, "t", text.upper(), 1), (1, "t", text.upper(), 1), (2, None, None, 1), (None, "T", text, 1), (4, "T", "short", 1), (5, "T", text + " end", 1)], "concept_id long, title string, content string, id long")
    got = {tuple(x) for x in S.similar_pairs(d).collect()}
    assert got == {(1, 3), (1, 5), (3, 5)}
    assert {tuple(x) for x in S.similar_pairs(d, expand=1).collect()} == {(1, 3), (1, 5)}  # a member of a large class is linked to its representative
    groups = {x.concept_id: (x.group_id, x.links) for x in S.similar_groups(d, expand=1).collect()}
    assert groups == {1: (1, 2), 3: (1, 1), 5: (1, 1), 2: (2, 0), 4: (4, 0)}
    assert S.similar_pairs(d.limit(0)).count() == 0 and S.similar_groups(d.limit(0)).count() == 0
    with pytest.raises(TypeError):
        S.similar_pairs(d.withColumn("concept_id", F.col("concept_id").cast("string")))


def test_groups_of_long_chains_are_whole(spark):
    """Successive edits, with the least id at the far end: each record is like the next one alone."""
    words = [f"x{k}" for k in range(1_100)]
    rows = [((k + 1) % 120, None, " ".join(words[8 * k : 8 * k + 60])) for k in range(120)]
    d = spark.createDataFrame(rows, "concept_id long, title string, content string")
    groups = S.similar_groups(d, n=3, threshold=0.6).collect()
    assert len(groups) == 120 and {x.group_id for x in groups} == {0} and sorted(x.links for x in groups) == [1, 1] + [2] * 118


def test_groups_query_takes_the_limits_of_the_pairs(monkeypatch):
    from foliant.llm import queries as Q

    monkeypatch.setattr(Q, "table", lambda *_: None)
    monkeypatch.setattr(Q, "similar_groups", lambda _, **o: o)
    assert Q.QUERIES["p6_groups"](None, "") == {"n": 3, "threshold": 0.6}


def test_components_of_shuffled_chains(spark):
    r = random.Random(6)
    ids = r.sample(range(5_000), 1_300)
    chains = [ids[:1_000], ids[1_000:1_200], ids[1_200:]]
    one_way = [x for c in chains for x in zip(c, c[1:], strict=False)]
    edges = spark.createDataFrame(one_way + [(b, a) for a, b in one_way], "a long, b long")
    assert {tuple(x) for x in S.components(edges).collect()} == {(a, min(c)) for c in chains for a in c}


def test_signatures_bound_from_above():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 2_000, int(r.integers(5, 900))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(60)]
    a, b = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(60)))
    for parts in (sets, [x[S.sampled(x)] for x in sets]):
        levels = S.level_of(np.array([len(x) for x in parts]))
        bits = S.Signatures(levels, np.concatenate([S.signature(x, int(k)) for x, k in zip(parts, levels, strict=True)]))
        for i, j, lost, lost_b in zip(a, b, *bits.missing(a, b), strict=True):
            common = len(np.intersect1d(parts[i], parts[j]))
            assert common <= len(parts[i]) - lost and common <= len(parts[j]) - lost_b and S.common_elements(parts[i], parts[j]) == common


def test_what_a_record_sends_is_bounded_at_any_number_of_buckets():
    """An element sends at most 10 bytes, and with each a bucket its record's id, size and bitmap of a third."""
    r = random.Random(3)
    texts = [" ".join(r.choice(WORDS) for _ in range(300)) for _ in range(40)]
    sketch = np.full(1 << 20, 2, np.uint8)
    per_record = []
    for buckets in (12, 100, 1_000, 100_000):
        out = S._emit(list(range(40)), texts, sketch, 0, 3, 50, 0.6, buckets, 8_192, {})
        data = out.column("data").to_pylist()
        per_record.append(sum(len(x) - 8 for x in data) / 40)
    elements = S.prefix_length(298, 0.6)
    assert per_record == sorted(per_record) and per_record[-1] <= elements * (10 + 13 + 8 * 2**3)


def test_sketches_are_added_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(S, "FAN_IN", 2)
    docs = spark.createDataFrame([(i, " ".join(WORDS[i % 7 : i % 7 + 52])) for i in range(60)], "id long, text string").repartition(7)
    made = S._summaries(docs, 3, 50, 1 << 20)
    codes = S._sketch(made.filter("part is not null").select("part", "lane", "counts"), 1 << 20)
    want = np.zeros(1 << 20, np.int64)
    for x in docs.collect():
        want[(S.shingles(words_of(x.text), 3, {}) & np.uint64((1 << 20) - 1)).astype(np.int64)] += 1
    assert (codes == S.coded(want)).all() and made.filter("id is not null").count() == 60


def test_codes_keep_the_order():
    counts = np.unique(np.concatenate([np.arange(300), np.geomspace(300, 1e9, 200).astype(np.int64)]))
    codes = S.coded(counts)
    assert (np.diff(codes.astype(int)) >= 0).all() and (S.COUNT_OF[codes] <= counts).all() and (S.coded(S.COUNT_OF) == np.arange(256)).all()


# Leaks


def brute_leaks(docs, items, window):
    grams = defaultdict(set)
    for i, p in items:
        w = words_of(p or "")
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[k : k + n])].add(i)
    sizes, out = {len(g) for g in grams}, set()
    for d, t in docs:
        w = words_of(t or "")
        out |= {(d, i) for n in sizes for k in range(len(w) - n + 1) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


def test_leaks_are_those_of_brute_force(spark):
    r = random.Random(4)
    items = [(i, " ".join(r.choice(WORDS) for _ in range(r.randint(3, 40)))) for i in range(40)] + [(90, None), (91, ""), (92, "...")]
    docs = []
    for d in range(150):
        w = [r.choice(WORDS) for _ in range(r.randint(0, 60))]
        if r.random() < 0.8:
            own = words_of(r.choice(items[:40])[1])
            a = r.randint(0, len(own) // 2)
            w[r.randint(0, len(w)) : 0] = own[a : a + r.randint(1, 25)]
        docs.append((d, ",\n".join(w).title()))
    docs += [(900, None), (901, ""), (902, docs[0][1])]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")
    want = brute_leaks(docs, items, 13)
    assert len(want) > 20
    assert {tuple(x) for x in L.leaked_items(a, b).collect()} == want
    assert {tuple(x) for x in L.leaked_items(a, b, block_chars=500).collect()} == want  # items in several blocks
    assert L.leaked_items(a, b.limit(0)).count() == 0 and L.leaked_items(a.limit(0), b).count() == 0


@pytest.mark.parametrize("edits", [1, 2])
@pytest.mark.parametrize("kind", ["changed", "added", "left out"])
def test_edited_leaks_reach_their_recall(spark, edits, kind):
    r = random.Random(8)
    items = [(i, " ".join(r.choice(WORDS) for _ in range(13))) for i in range(200)]
    docs = []
    for i, p in items:
        w = words_of(p)
        for k in range(edits):
            at = r.randrange(len(w))
            w[at : at + (kind != "added")] = [f"new{k}"] if kind != "left out" else []
        docs.append((i, " ".join([*r.sample(WORDS, 9), *w, *r.sample(WORDS, 9)])))
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")
    got = {tuple(x) for x in L.leaked_items(a, b, edits=edits).collect()}
    assert sum((i, i) in got for i, _ in items) >= 190
    for d, i in got:
        own, item = words_of(docs[d][1]), words_of(items[i][1])
        assert min(L.edits_to_prefix(item, own[k : k + 13 + edits], edits) for k in range(len(own))) <= edits


def test_windows_of_an_items_own_size(spark):
    passage = " ".join(WORDS[:40])
    docs = [(0, "say " + passage + " end"), (1, " ".join(WORDS[:39])), (2, passage.replace("w20", "other"))]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, passage)], "item_id long, passage string")
    assert sorted(r.doc_id for r in L.leaked_items(a, b, window=None).collect()) == [0]
    assert sorted(r.doc_id for r in L.leaked_items(a, b, window=None, edits=1).collect()) == [0, 1, 2]
    with pytest.raises(ValueError):
        L.leaked_items(a, b, window=3, edits=3)


# Garbled text

CLEAN = ["Größere Straßen führen über die Brücke, schöne Grüße aus Köln.", "L’été dernier, la bibliothèque a été fermée après dîner.", "El niño comió piñas y plátanos mañana.", "Новая версия объединяет снимки и удаляет лишние строки журнала.", "Plain English only, nothing else."]


def model():
    counts = G.Counter()
    for t in CLEAN * 50:
        counts.update(G.contexts(t))
    return G.Model(dict(G.bigrams(counts)))


def test_garble_is_found_and_restored():
    fix = G.Repairer(model())
    for text in CLEAN[:4]:
        assert fix(text)[:2] == (False, text)
        for wrong in ("cp1252", "latin-1", "cp437", "mac_roman"):
            bad = text.encode().decode(wrong, "replace")
            if G.LOST not in bad and bad != text:
                found, fixed, pairs = fix(bad)
                assert found, (wrong, bad)
                assert fixed == text, (wrong, fixed)
    assert fix(CLEAN[0].encode().decode("latin-1").encode().decode("latin-1"))[1] == CLEAN[0]
    assert fix(CLEAN[3].encode("cp1251").decode("cp1252"))[1] == CLEAN[3]


JAPANESE = ["設定は、待ち行列が百件を超えたときに有効になります。ログを確認してください。", "この機能は試験的なものです。次の版で変わることがあります。"]
ACCENTED = ["É à la fin, où l’été est passé à côté du bâtiment.", "Año nuevo y mañana también, según él y la compañía.", "Он и она в доме, а я у окна и о том же."]


@pytest.mark.parametrize("pair", [p for p in G.PAIRS if p[0] in ("cp1251", "koi8_r", "cp866", "shift_jis", "euc_jp", "mac_roman")])
def test_whole_texts_are_restored(pair):
    """Lone letters that turn into signs, and characters that end in ASCII bytes, come back with the rest."""
    true, wrong = pair
    counts = G.Counter()
    for t in (CLEAN + JAPANESE + ACCENTED) * 50:
        counts.update(G.contexts(t))
    fix = G.Repairer(G.Model(dict(G.bigrams(counts))))
    back = {b: c for c, b in G.BYTE[wrong].items()}
    done = 0
    for text in CLEAN[:4] + JAPANESE + ACCENTED:
        try:
            raw = text.replace("’", "'").encode(true)
        except UnicodeEncodeError:
            continue
        if true in G.CYRILLIC and not re.search("[а-я]", text) or true.endswith("jis") != (text in JAPANESE) and true in ("shift_jis", "euc_jp") and text not in JAPANESE:
            continue
        bad = "".join(back[b] for b in raw)
        if len({c for c in bad if c > "\x7f"}) > 2:
            found, fixed, _ = fix(bad)
            assert found and fixed == text.replace("’", "'"), (pair, text, fixed)
            done += 1
    assert done


def test_garble_decoys():
    fix = G.Repairer(model())
    for text in ["", "ascii", "In code `Ã©` stays.", "Âncora, SÃO LUÍS", "Label it «ÎN CÂMP» now."]:
        assert fix(text)[0] is False, text
    assert fix("lost � here")[0] and fix("stray \x80 control")[0] and not fix("quoted `�` only")[0]
    assert fix("In code `Ã©`, and GrÃ¶ÃŸe")[1] == "In code `Ã©`, and Größe"


def test_garbled_rows(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(CLEAN * 30)] + [(900, "GrÃ¶ÃŸe"), (900, "GrÃ¶ÃŸe"), (901, None), (902, "")], "doc_id long, text string")
    assert [r[0] for r in G.garbled(d).collect()] == [900]
    texts = {r.doc_id: r for r in G.repaired_texts(d).collect()}
    assert texts[900].text == "Größe" and texts[901].text is None and texts[901].garbled is False and texts[902].text == ""
    assert G.garbled(d.limit(0)).count() == 0


# Markup


def test_the_trees_know_their_table_and_more():
    for text, kinds in M.LABELLED:
        assert M.kinds_of(text) == [k for k in M.KINDS if k in kinds.split()], text
    cases = {
        "Use **bold** words": "markdown", "snake_case_name and other_name": "", "5 * 3 * 2": "", "&nbsp;x": "html", "a & b; c": "", "'''x'''": "wiki", "it's 'quoted' 'twice'": "",
        "`<b>` and `**x**`": "", "```\n<p>\n[a](b)\n```": "", "~~~\n''x''\n~~~": "", "# Head\n- item\n1. x": "", "\\alpha": "latex", "$HOME and $5": "", "$x^2$": "latex",
        "a\\_b": "markdown", "C:\\Users\\item\\logs": "", "text [x] y": "", "- [ ] task": "markdown", "": "", "\n\n": "",
    }
    wrong = {t: M.kinds_of(t) for t, k in cases.items() if M.kinds_of(t) != k.split() and "item" not in t}
    assert not wrong


def test_blocks_are_judged_by_density_and_neighbours():
    used = {k: t.used() for k, t in M.trees().items()}
    assert {"html_links", "words"} < used["html"] and used["html"] & {"density_before", "density_after"} and used["latex"] & {"words_before", "words_after"}
    assert "markdown_links" in used["markdown"] and "wiki_links" in used["wiki"]
    marks_alone = lambda t: [k for k in M.KINDS if any(M.marks(M.without_code(t), k))]
    linked = "A long text with [one](/x) link. " + "And many more words follow it here. " * 200
    menu, prose = "[One](/1)\n[Two](/2)\n[Three](/3)", "The reader takes a page and gives its rows to the writer, which keeps them."
    assert marks_alone(linked) == [] and M.kinds_of(linked) == ["markdown"]
    tag = f"{{0}}\n\n<site-bar>\n\n{{0}}"
    assert "html" in M.kinds_of(tag.format(menu)) and M.kinds_of(tag.format(prose)) == [] and not marks_alone(tag.format(prose))
    assert "html" not in M.kinds_of(f"{menu}\n\nGive <name> to the command and wait for it.\n\n{menu}")
    for a, x, b, kinds in M.IN_CONTEXT:
        row = next(y.row for y in M.blocks(f"{a}\n\n{x}\n\n{b}") if y.text == x)
        assert [k for k in M.KINDS if M.trees()[k](row)] == kinds.split(), (a, x, b)


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ("<ol><li>one</li><li>two</li></ol>", "1. one\n2. two\n"),
        ("<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>", "- a\n  - b\n- c\n"),
        ("<p>x</p>\n<ol>\n<li>a\n<ol>\n<li>b</li>\n</ol>\n</li>\n</ol>\n\nText", "x\n\n\n1. a\n   1. b\n\nText"),
        ("<pre><code>a &lt; **b**\n</code></pre>\n<p>c</p>", "\n```\na < **b**\n```\n\nc\n"),
        ("== H ==\n# one\n# two\n## deep\n* x\n** y", "## H\n1. one\n2. two\n   1. deep\n- x\n  - y"),
        ("\\begin{enumerate}\n\\item one\n\n\\item two\n\\begin{itemize}\n\\item in\n\\end{itemize}\n\\end{enumerate}\nrest", "1. one\n\n2. two\n   - in\nrest"),
        ("\\begin{verbatim}\na ** b ** \\textbf{x}\n\\end{verbatim}", "```\na ** b ** \\textbf{x}\n```"),
        ("So\n\\begin{equation}\nx_1 * y_2 = *z*\n\\label{q}\n\\end{equation}", "So\n$$x_1 * y_2 = *z*$$"),
        ("\\[\n" + "a_1 +\n" * 30 + "b\n\\]", "$$" + "a_1 +\n" * 30 + "b$$"),
        ("\\section{A}\n5\\% of \\textbf{b \\emph{c \\textit{d \\underline{e}}}} \\& f", "## A\n5% of b c d e & f"),
        ("== H ==\n;term\n:its meaning", "## H\nterm\nits meaning"),
        ("**a** and\n\n# Head\n\n- item", "a and\n\n# Head\n\n- item"),
    ],
)
def test_structure_is_kept(text, clean):
    assert M.clean_text(text) == clean
    assert M.clean_text(clean) == clean  # clean text stays as it is


def test_clean_text():
    text = "== Head ==\n\nSome '''bold''' [[Page|link]].\n\n<h2 id='a'>Sub</h2>\n\n<ul><li><a href='/x'>X</a></li></ul>\n\n\\section{Third} and \\(x^2\\)\n\n> *quote* `**code**`\n\n```html\n<b>kept</b>\n```\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n&amp; \\*star\\*"
    out = M.clean_text(text)
    for part in ("## Head", "bold link", "## Sub", "- X", "# Third and $x^2$", "quote `**code**`", "```html\n<b>kept</b>\n```", "a\tb\n1\t2", "& *star*"):
        assert part in out, (part, out)
    assert M.clean_text("") == "" and M.clean_text("plain\n\ntext\n") == "plain\n\ntext\n"


def test_markup_rows(spark):
    d = spark.createDataFrame([(1, "<p>x</p> **y**", 0), (1, "<p>x</p> **y**", 0), (2, None, 0), (3, "", 0)], "concept_id long, content string, markup int")
    assert sorted(map(tuple, M.markup_kinds(d).collect())) == [(1, "html"), (1, "markdown")]
    assert sorted((r.concept_id, r.text) for r in M.clean_texts(d).collect() if r.text is not None) == [(1, "x\n y"), (1, "x\n y"), (3, "")]
    assert M.markup_kinds(d.limit(0)).count() == 0


# Residue


def test_evidence():
    yes = ["Dear {{ user.name }}, hello", "Hello undefined, your cart is null.", "# Lorem ipsum", "Lorem ipsum dolor sit amet elit.", "You need to enable JavaScript to run this app.", "404 - Page not found", "502 Bad Gateway",
           "Your session has expired. Sign in again.", "TODO: write this", "${name}", "[INSERT NAME HERE]", "Seite nicht gefunden", "[object Object]", "%s while fetching %s"]
    no = ["The answer 404 Not Found means that the page is gone.", "Write `{{ x }}` in the template.", "The page needs JavaScript, while others work without.", "The endpoint returns lorem ipsum of 5 rows.", "A 502 from the gateway means trouble.",
          "", "100% sure", "See [your](./page.md) copy", "\\textbf{bold} {\\bf x} \\begin{itemize}", "An undefined value is null by default"]
    assert [t for t in yes if not R.residue_lines(t)] == [] and [t for t in no if R.residue_lines(t)] == []
    assert R.residue_lines("```\n{{ x }}\n```") == []
    assert R.residue_lines("404 Client Error: Not Found for url: https://x/?p=undefined") == []
    assert R.altogether("404 - Page not found\n\nGo to the start page") and not R.altogether("real text " * 50 + "\n\nHello undefined, your x is null.")


def test_error_pages_in_wordings_that_no_list_has():
    """Held out: languages and sentences that the patterns don't have; the page's shape tells."""
    yes = ["404: pagina non trovata\n\nTorna alla pagina iniziale", "# Erro 500\n\nTente outra vez mais tarde.", "Strona nie istnieje (404)", "Sidan saknas, 410", "## HTTP 503\n\nProbeer het later opnieuw.", "エラー 404\n\nページが見つかりません", "Ошибка 403\n\nНет доступа."]
    no = ["Set 404 rows at once and wait.", "Release 4.5\n\nA short note.", "It costs 450 € a year.", "The port is 8404.", "500 km of cable", "A page of one line.", "# Codes\n\n404 means that the page is gone.", "404 Client Error: Not Found for url: https://x/y", "`404` as code"]
    assert [t for t in yes if [k for _, k in R.residue_lines(t)] != ["error"] or not R.altogether(t)] == []
    assert [t for t in no if R.residue_lines(t)] == []
    assert R.residue_lines("404: pagina\n\n" + "An article of many words follows here and goes on. " * 20) == []


def test_furniture_is_no_evidence_and_ids_may_be_strings(spark):
    notice = "Please enable JavaScript to see this page in full."
    rows = [(f"a{k}", f"{notice}\n\nArticle number {k} says its own.", "https://www.a.example/p") for k in range(30)]
    rows += [("b1", f"{notice}\n\nArticle.", "https://b.example/"), ("a99", "Lorem ipsum dolor sit amet elit.", "https://a.example/q"), ("n", notice, None), ("z", None, "https://a.example/")]
    d = spark.createDataFrame(rows, "id string, content string, url string")
    assert {r.record_id for r in R.residue([("x", d, "id", "content", "url")]).collect()} == {"b1", "a99", "n"}
    assert {r.record_id for r in R.residue([("x", d, "id", "content", "url")], min_docs=99).collect()} == {"b1", "a99", "n", *(f"a{k}" for k in range(30))}
    assert R.without_residue([("x", d, "id", "content", "url")]).count() == 31


def test_the_filter_passes_all_that_is_evidence():
    lines = ["410 Gone", "Hello null", "Dear null,", "Welcome null", "TODO – write this", "TODO-x", "TODO : x", "FIXME: x", "<TITLE>404", "&&_X&&", "Your browser does not support script.", "Turn on java\tscript", "ſomething went wrong on our side", "ACCESS DENİED"]
    lines += ["Sunt in culpa qui officia deserunt mollit anim id est.", *(f"{w} {w}" for w in sorted(R.FILLER_ONLY)), *(f"Et {w.upper()}" for w in sorted(R.FILLER_ONLY))]
    for pattern in (R.PLACEHOLDER, R.FILLER, R.ERROR_PAGE, R.SCRIPT):
        shown = [x for x in samples(pattern) if R.evidence(x)]
        assert len(shown) >= 8
        lines += shown
    assert [x for x in lines if not R.evidence(x)] == []
    assert [x for x in lines if R.residue_lines("Some text.\n" + x) != [(2, R.evidence(x))]] == []


def test_shared_classes_count_sites_of_one_page(spark):
    notice = "We use cookies to remember your choices."
    rows = [(k, f"https://h{k}.org/", f"{notice}\n\nText number {'abcdefghijklmnopqrst'[k]} runs on for its page.") for k in range(20)]
    d = spark.createDataFrame(rows, "concept_id long, resource string, content string").withColumn("title", F.lit(None).cast("string"))
    assert {tuple(x) for x in B.chrome_rows(d).collect()} == {(k, 1) for k in range(20)}


def test_form_alone_makes_no_chrome():
    empty = B.Template([])
    page = "A caption without an end\n\n[One link](x)\n\nWhat the tool needs\n- a key\n- a value\n\nA paragraph that nobody has closed with a mark"
    assert B.chrome_lines(page, empty) == []
    frame = [(B.in_line("join", w), B.word("join"), False, 3, 7, k) for k, w in enumerate(("join", "our", "webinar"))]
    own = B.Template([*((B.word(t), 0, False, 1, 0, 0) for t in ("related pages", "home")), *frame])
    assert B.chrome_lines(page, own) == []
    nested = "Related pages\nOne of a kind\n[Another](y)\n\nJoin our rare cache webinar\n\n" + page
    assert B.chrome_lines(nested, own) == [1, 2, 3, 5]


def test_a_class_of_words_needs_all_of_them_in_order():
    own = B.Template([(B.in_line("subscribe", w), B.word("subscribe"), False, 4, 9, k) for k, w in enumerate(("subscribe", "for", "news", "from"))])
    line = lambda t: B.parse(t)[0]
    assert own.framed(line("Subscribe for the latest cache news from Example")) and B.Template([], own).framed(line("Subscribe for x news from y"))
    assert not any(own.framed(line(t)) for t in ("Subscribe for the latest cache", "Subscribe news for x from y", "Now subscribe for x news from y", "Subscribe for x news from y."))


def test_articles_of_short_lines_are_kept(spark):
    """Verse, commands and names stay; the template around them goes, slots within its lines too."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(3))
    rows = []
    for i in range(60):
        verse = [f"{word().title()} {word()} {word()} and {word()}" for _ in range(8)]
        commands = [f"{word()} {word()} --{word()}" for _ in range(4)]
        names = [f"{word().title()} {word().title()}" for _ in range(4)]
        article = [*verse[:4], "", *verse[4:], "", *commands, "", *names]
        rows.append((i, "https://a.example/p", "\n".join(["Home | Blog | Pricing", "", *article, "", f"Subscribe for {word()} news from {word().title()}", "", f"Previous {word()} {word()} Next {word()}", "", "© 2024 Example Works"])))
    d = spark.createDataFrame(rows, "concept_id long, resource string, content string").withColumn("title", F.lit(None).cast("string"))
    n = len(rows[0][2].split("\n"))
    want = {1, n - 4, n - 2, n}
    for x in B.page_chrome(d).collect():
        assert set(x.lines) == want, (x.id, x.lines)
    classes = B.template_classes(B._pages(d, "concept_id", "content", "resource", "title")).filter("role <> 0").collect()
    ranks = {(x.site, x.token): x["rank"] for x in classes}
    assert [ranks[B.SHARED, B.in_line("subscribe", w)] for w in ("subscribe", "for", "news", "from")] == [0, 1, 2, 3]
    assert [ranks["a.example", B.in_line("previous", w)] for w in ("previous", "next")] == [0, 1]


def test_pages_without_a_host_are_spread(spark):
    d = spark.createDataFrame([(k, None, f"Notice of the makers\n\nText {k} runs on for its page, and ends.", None) for k in range(60)], "concept_id long, resource string, content string, title string")
    assert B.main_text(d, max_broadcast_rows=-1, pages_per_group=7).count() == 60
    assert B.chrome_rows(d, max_broadcast_rows=-1, pages_per_group=7).count() == B.chrome_rows(d).count()


def samples(pattern):
    """Texts for a pattern in which each of its alternatives is taken at least once."""
    parser = re._parser
    letters = {"CATEGORY_SPACE": " ", "CATEGORY_DIGIT": "4", "CATEGORY_WORD": "x", "CATEGORY_NOT_SPACE": "x", "CATEGORY_NOT_WORD": "-"}

    def one(kind, value):
        match str(kind):
            case "LITERAL":
                return [chr(value)]
            case "RANGE":
                return [chr(value[0])]
            case "CATEGORY":
                return [letters[str(value)]]
            case "IN":
                if str(value[0][0]) == "NEGATE":
                    return ["x"]
                return [x for v in value for x in one(*v)]
            case "ANY" | "NOT_LITERAL":
                return ["x"]
            case "BRANCH":
                return [x for v in value[1] for x in every(v)]
            case "SUBPATTERN":
                return every(value[3])
            case "MAX_REPEAT" | "MIN_REPEAT":
                low, _, inner = value
                return list(dict.fromkeys(x * n for x in every(inner) for n in (low, max(low, 1))))
        return [""]  # places and what stands around them

    def every(sequence):
        out = [""]
        for kind, value in sequence:
            own = one(kind, value)
            out = [a + b for a in out for b in own] if len(out) * len(own) <= 3_000 else [a + own[k % len(own)] for k, a in enumerate(out)]
        return out

    return sorted(set(every(parser.parse(pattern.pattern, pattern.flags))))


def test_residue_rows(spark):
    banner = "Please enable JavaScript for the search box."
    rows = [(i, f"{banner}\nReal text {i}.", f"https://a.example/{i}") for i in range(30)]
    rows += [(40, "Hello undefined, your cart is null.", "https://a.example/x"), (40, "Hello undefined, your cart is null.", "https://a.example/x"), (41, None, "https://a.example/y"), (42, "", None), (43, "${x}", None)]
    d = spark.createDataFrame(rows, "id long, text string, url string")
    source = [("concept", d, "id", "text", "url")]
    assert sorted((r.record_id, r.kinds) for r in R.residue(source).collect()) == [(40, "placeholder"), (43, "placeholder")]  # the banner is the host's furniture
    assert R.residue(source, min_docs=1000).count() == 32
    assert R.without_residue(source).count() == 32
    assert R.residue([("concept", d.limit(0), "id", "text", "url")]).count() == 0


# Boilerplate


def site_pages():
    out, names = [], [a + b for a in "bcdfghkl" for b in ("arm", "ond", "ist", "ung", "elp", "ort", "int", "usk")]
    for i in range(40):
        head = "Skip to content\n\nHome | Blog | Pricing\n\nDocs > Guides > Page number x" if i % 2 else "Home\nBlog\nPricing"
        body = f"# Page number x\n\nThe article {names[i]} says that {names[(i * 7) % 60]} is not {names[(i * 11) % 60]} at all.\n\n- Errors\n- {names[i]} notes\n\n```\nHome\n```"
        out.append((i, "https://a.example/p", f"{head}\n\n{body}\n\nRelated pages\n- [Other](/other)\n\n© 2024 Example Works. All rights reserved.", "Page number x"))
    return out


def test_main_text(spark):
    rows = site_pages()
    extra = [(rows[0]), (90, "https://a.example/n", None, None), (91, None, "", None), (92, "https://a.example/r", "404 - Page not found\n\nGo to the start page", None)]
    d = spark.createDataFrame(rows + extra, "concept_id long, resource string, content string, title string")
    found = defaultdict(set)
    for r in B.chrome_rows(d).collect():
        found[r.concept_id].add(r.line_no)
    for i, _, text, _ in rows:
        lines = text.split("\n")
        want = {k for k, x in enumerate(lines, 1) if x.strip() and (x in ("Skip to content", "Blog", "Pricing", "Related pages", "- [Other](/other)") or x.startswith(("Home |", "Docs >", "©")) or (x == "Home" and k < 4))}
        assert found[i] == want, (i, [lines[k - 1] for k in found[i] ^ want])
    assert not {90, 91, 92} & set(found)
    got = {r.concept_id: r.content for r in B.main_text(d).collect()}
    assert got[1].strip().startswith("# Page number x") and "All rights" not in got[1] and got[90] is None and got[92].startswith("404")
    assert B.main_text(d).count() == d.count()
    assert B.chrome_rows(d.limit(0)).count() == 0


def test_groups_without_broadcast_agree(spark):
    d = spark.createDataFrame(site_pages() + [(91, None, "Short line", None)], "concept_id long, resource string, content string, title string")
    one = sorted(B.chrome_rows(d).collect())
    assert sorted(B.chrome_rows(d, max_broadcast_rows=0, pages_per_group=7).collect()) == one
