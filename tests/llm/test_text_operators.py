"""Splitting, markup, encodings: round trips, brute force and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from quirework.llm import markup as K
from quirework.llm import mojibake as B
from quirework.llm import splitter as S

TEXT = "# Head\n\nFirst para. It has e.g. two sentences! Ünïcode 日本語。次の文。\n\n```\ncode line\n\nmore code\n```\n\n## Next\n\n" + "word " * 60 + "\n\n" + "x" * 150


@pytest.mark.parametrize("limit,overlap", [(40, 0), (40, 10), (100, 99), (7, 3), (1, 0), (10_000, 5)])
def test_split_round_trip(limit, overlap):
    spans = S.split_spans(TEXT, limit, overlap)
    assert "".join(TEXT[f:e] for _, f, e, _ in spans) == TEXT
    assert all(e - b <= limit for b, _, e, _ in spans)
    for (b0, _, e0, _), (b, f, _, _) in zip(spans, spans[1:]):
        assert f == e0 and b == max(b0, e0 - overlap)


def test_split_prefers_natural_boundaries():
    t = "# A\n\n" + "One two three. " * 4 + "\n\n# B\n\n" + "Four five six. " * 4
    assert [x[3] for x in S.split_spans(t, 80, 0)] == ["section", "end"]
    assert S.split_spans("", 5, 1) == [(0, 0, 0, "end")]
    assert S.split_spans("e\u0301" * 10, 3, 0)[0][2] == 2
    with pytest.raises(ValueError):
        S.split_spans("abc", 3, 3)


def test_split_random_texts():
    r = random.Random(1)
    for _ in range(60):
        t = "".join(r.choice(["a", "b ", ". ", "\n\n", "\n# ", "é", "。", "```\n"]) for _ in range(r.randint(0, 300)))
        limit = r.randint(2, 50)
        spans = S.split_spans(t, limit, r.randint(0, limit - 1))
        assert "".join(t[f:e] for _, f, e, _ in spans) == t and all(e - b <= limit for b, _, e, _ in spans)


def test_split_tables(spark):
    limits = spark.createDataFrame([("f", 10, 2), ("g", None, 1)], "field_name string, max_chars int, overlap_chars int")
    df = spark.createDataFrame([(1, "a" * 25), (1, "a" * 25), (2, None), (3, ""), (4, "日" * 10), (5, "日" * 11)], "i long, t string")
    out = S.split_texts({"f": df, "g": df.select(F.col("i").alias("piece"), F.col("t").alias("row_id")), "h": df}, limits)
    assert sorted((r.row_id, r.piece_no) for r in out.collect()) == [(1, 0), (1, 0), (1, 1), (1, 1), (1, 2), (1, 2), (1, 3), (1, 3), (5, 0), (5, 1)]
    assert S.split_texts({"f": df.limit(0)}, limits).count() == 0


@pytest.mark.parametrize(
    "own,text,kinds",
    [
        ("markdown", "a **b** `<div>` $x < y$ and\n```\n<b>\\emph{x}</b>\n```", []), ("markdown", "if a < b, then b > a; R&D; C:\\dir a == b", []), ("markdown", "a <span class=\"x\">b</span>", ["html"]), ("markdown", "a &lt; b", ["html"]),
        ("markdown", "see \\cite{a} and \\textbf{b}", ["latex"]), ("markdown", "''it'' [[link|x]]", ["wiki"]), ("markdown", "== Head ==", ["wiki"]), ("html", "<p>a <b>b</b> &lt; c, R&amp;D</p>", []), ("html", "<p>a &lt;br&gt; b</p>", ["html"]),
        ("html", "<p>a **b** c</p>", ["markdown"]), ("html", "<p>![](images/a.png)</p>", ["markdown"]), ("html", "<p>\\emph{x}</p><code>**no**</code><pre>[[no]]</pre>", ["latex"]), ("html", "<p>open", []), ("latex", "\\emph{a} $<p>$ \\verb|<b>|", []), ("latex", "\\emph{a} <p>b</p>", ["html"]),
        ("html", "", []), ("markdown", "", []),
    ],
)
def test_foreign_markup(own, text, kinds):
    assert K.clean(text, own)[1] == kinds


def test_clean_text_keeps_structure():
    html = "<section><h2>T</h2><p>a <a href='#x'>b</a></p><ul><li>one</li><li>two</li></ul><ol><li>x</li></ol><table><tr><th>h</th><td>1|2</td></tr></table><math alttext='x^2'></math><pre>c\n d</pre><script>no</script>"
    assert K.clean(html, "html")[0] == "## T\n\na b\n\n- one\n- two\n1. x\n\n| h | 1\\|2 |\n| --- | --- |\n\n$x^2$\n\n```\nc\n d\n```"
    assert K.clean("\\section{A}\nx \\emph{y}~\\cite{k}\n\\begin{itemize}\\item p\\end{itemize}", "latex")[0] == "# A\n\nx y [k]\n\n- p"
    page = "<body><nav>" + "<a href='#'>menu</a>" * 9 + "</nav><article><p>" + "real text " * 40 + "</p></article></body>"
    assert "menu" not in K.clean(page, "html")[0] and "real text" in K.clean(page, "html")[0]
    assert K.clean("<div>" * 2000 + "x", "html")[0] == "x"


@pytest.mark.parametrize("part", ["div", "ul", "section", "table", "nav"])
def test_content_is_selected(part):
    inner = {"ul": "<li>{}</li>", "table": "<tr><td>{}</td></tr>"}.get(part, "<span>{}</span>")
    menu = f"<{part}>" + "".join(inner.format(f"<a href='#'>menu{k}</a>") for k in range(9)) + f"</{part}>"
    paragraphs = "".join(f"<p>{'real text ' * 30}{k}</p>" for k in range(5))
    page = f"<html><body>{menu}<h1>Head</h1><div><div class='main'>{paragraphs}</div>{menu}</div><p>{'beside it ' * 60}</p>{menu}</body></html>"
    text = K.clean(page, "html")[0]
    assert "menu" not in text and text.count("real text") == 150 and text.count("beside it") == 60 and "# Head" in text
    # markup beside the content is still found
    assert K.clean(page.replace("menu3", "**menu**"), "html")[1] == ["markdown"]


def test_foreign_markup_hangs_in_the_tree():
    root = K.parse_html("<div><p>plain words of about the same length here</p><p>so &lt;b&gt;bold&lt;/b&gt; and \\emph{x}</p></div>")
    K.hang_foreign(root, "html")
    K.content_root(root)
    plain, marked = root.kids[0].kids
    assert marked.foreign == ("html", "html", "latex") and plain.foreign == () and root.formats == {"html", "latex"}
    # tags of other formats make a node less dense
    assert marked.tags == 3 and plain.density > marked.density
    tree = K.read_marked("a\n\n```\nx\n\ny\n```\n\n$$z$$ b", K._MD_OPAQUE)
    assert [[k.tag if k.__class__ is K.Node else k for k in b.kids] for b in tree.kids[0].kids] == [["a"], ["", "code", ""], ["", "math", " b"]]


@pytest.mark.parametrize("own,text,kinds", [("html", f"<p>**{'wide ' * 400}end** x</p>", ["markdown"]), ("markdown", f"see [[{'wide ' * 300}]]", ["wiki"]), ("markdown", f"${'x + ' * 300}x <b> y$", []), ("markdown", "\\a{" * 40 + "x" + "}" * 40, [])])
def test_long_spans_of_markup(own, text, kinds):
    assert K.clean(text, own)[1] == kinds


def test_deep_markup_is_kept():
    assert "x" in K.clean("<table><tr><td>" * 400 + "x", "html")[0]
    assert K.latex_text("\\emph{" * 50 + "x" + "}" * 50) == "x"


def test_section_fragments_stay_whole():
    section = "<section><h2>T</h2><p>Short one.</p><figure><img src='a.png'><figcaption>" + "caption " * 40 + "</figcaption></figure><ul><li>x</li></ul><p>End.</p></section>"
    text = K.clean(section, "html")[0]
    assert all(x in text for x in ("## T", "Short one.", "caption", "- x", "End."))


def test_clean_markup_frame(spark):
    df = spark.createDataFrame([(1, "HTML ", "<p>a **b**"), (2, None, None), (3, "odd", "x"), (3, "odd", "x")], "text long, foreign string, row_id string")
    out = K.clean_markup({"f": df}).collect()
    assert sorted((r.row_id, tuple(r.foreign)) for r in out) == [(1, ("markdown",)), (3, ()), (3, ())]
    assert K.clean_markup({"f": df.limit(0)}).count() == 0


WORDS = {
    "utf8 as cp1252": ("Wir prüfen, ob die Größe über 77 Stufen gleichmäßig ist.", "utf-8", "cp1252"), "utf8 as mac": ("La fréquence est bornée où l’énergie décroît.", "utf-8", "mac_roman"), "utf8 as cp850": ("Größere Läufe erklären für die Oberfläche viel.", "utf-8", "cp850"),
    "koi8 as cp1251": ("Полученная модель описывает много режимов.", "koi8-r", "cp1251"), "cp1251 as cp1252": ("Кроме того, энергия не зависит от шума.", "cp1251", "cp1252"), "gbk as latin1": ("结果表明,频率与稀疏的密度有关。", "gbk", "latin-1"),
    "utf8 as cp1251": ("Каждая сеть остаётся случайной при измерениях.", "utf-8", "cp1251"), "cp1250 as cp1252": ("Każda miąższość jest wąska i główna gęstość.", "cp1250", "cp1252"),
}


@pytest.mark.parametrize("case", sorted(WORDS))
def test_encodings_come_back(case):
    text, was, seen = WORDS[case]
    garbled = text.encode(was).decode(seen, "strict" if seen != "cp1252" and seen != "cp1251" else "ignore")
    bad, _, fixed = B.repair(garbled)
    assert bad
    if garbled.encode(seen, "ignore") == text.encode(was):
        assert fixed == text
    assert B.repair(text)[0] is False


@pytest.mark.parametrize("word", ["caf&Atilde;&copy;", "caf&#195;&#169;", "caf\\u00c3\\u00a9", "caf\\xc3\\xa9", "caf=C3=A9", "caf%C3%A9"])
def test_escaped_words_come_back(spark, word):
    assert B.repair(f"The {word} is open.") == (True, True, "The café is open.")
    assert B.repair(f"Ünï: the {word} is open.")[2] == "Ünï: the café is open."
    assert [r.text for r in B.mend_texts(spark.createDataFrame([(1, f"The {word} is open.")], "doc_id long, text string")).collect()] == ["The café is open."]


@pytest.mark.parametrize("text", ["The caf&eacute; and R&amp;D", "a \\u00e9 and \\xe9", "see www.x.org/caf%C3%A9 or https://x.org/caf%C3%A9", "x=C3 and 5 %", "It is replaced by \\ufffd.", "shows `caf=C3=A9`"])
def test_sound_escapes_stay(text):
    assert B.repair(text) == (False, False, text)


@pytest.mark.parametrize("text", ["naïve café costs 3 €", "TÂRGU LUNCÂ, CÂMPU", "AVALIAÇÃO: a função", "Þórsvík and Ðalur stations", "shows `â€™` or \"Ã©\"", "At 6\xa0µm it is ≤ 3.0\xa0Å…", "Is it? Yes: http://x.org/a?b=c", "", "?"])
def test_sound_text_stays(text):
    assert B.repair(text) == (False, False, text)


def test_double_and_lost():
    twice = "é – ñ".encode().decode("cp1252").encode().decode("cp1252", "replace")
    assert B.repair("café " + twice)[0]
    assert B.repair("gr\ufffd\ufffde")[:2] == (True, False)
    assert B.repair("Lin?lujoth came")[0]
    long = ("Größe " * 200 + "\n") * 40
    assert B.repair(long.encode().decode("cp1252"))[2] == long


def test_search_climbs_and_ends():
    # the way to the restored name leads over a text that costs more
    assert B.search(("NamupÃ…Â¯guk",))[1] == ("Namupůguk",)
    # three layers, and a line of thousands of words that is judged as a whole
    text = "Größe für Läufe"
    for _ in range(3):
        text = text.encode().decode("latin-1")
    assert B.repair(text)[2] == "Größe für Läufe"
    line = " ".join(f"Größe{k}" for k in range(3000))
    assert B.repair(line.encode().decode("cp1252"))[::2] == (True, line)
    # what is lost shows in the cheapest state too
    assert B.repair("Lin?lujoth kam für Größe".encode().decode("cp1252"))[:2] == (True, False)
    assert B.repair("see a?b and x=y?z, or=w?x")[0] is True and B.repair("see http://x/a?b and x=y?z")[0] is False


def test_mend_frame(spark):
    df = spark.createDataFrame([(1, "caf\u00c3\u00a9"), (1, "caf\u00c3\u00a9"), (2, "fine"), (3, None), (4, "")], "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("restored", F.lit(1))
    assert [(r.id, r.restored, r.text) for r in B.mend_texts(df).collect()] == [(1, True, "café")] * 2
    assert B.mend_texts(df.limit(0)).count() == 0
