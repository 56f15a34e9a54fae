import pytest

from tessel.llm.markup import Line, clean, content_lines, converted, find_markup, formula, from_html, kinds_of

PLAIN = ["Plain prose, 3 < 4 and R&D.", "It costs $20 for A and $38 for B.", "A Map<String, List<Int>> holds 9.", "Run mine <path> twice for <name>.", "x | 15 | y\nz | 3 | w", "C:\\new\\table7\\x", "3 * 736 * 10", "see [872] and # 10", "use a & b, or ~8 == 5", "Fill {name} and {date}", "Call load_index_7 now", "├── a\n└── b", None, ""]


@pytest.mark.parametrize("text", PLAIN)
def test_plain_texts_are_no_cases(text):
    assert kinds_of(text) == [] and clean(text) == text


@pytest.mark.parametrize(
    "text,kind,shown",
    [
        ("<h2>Title</h2><p>One <b>bold</b> word.</p><ul><li>a</li><li>b</li></ul>", "html", "Title\n\nOne bold word.\n\n- a\n- b"),
        ("<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>", "html", "A | B\n1 | 2"),
        ("<pre>for x:\n    y</pre> end<style>p{}</style>", "html", "for x:\n    y\n\nend"),
        ("a &amp; b &#8212; c", "entity", "a & b — c"),
        ("# Head\n\n- one\n* two\n\n```py\nx = 1\n```\n**bold** [l](u.md) ~~no~~", "markdown", "Head\n\n- one\n- two\n\n    x = 1\nbold l no"),
        ("== Head ==\nA [[page|link]] and {{tpl|x=1}} '''b'''", "wiki", "Head\n\nA link and tpl, x: 1 b"),
        ("\\section{Head}\nText \\emph{it} $x_{12} = \\alpha \\cdot y^{2}$ \\cite{k}\n\\begin{itemize}\n\\item one\n\\end{itemize}", "latex", "Head\n\nText it x_12 = α · y^2 [k]\n\n- one"),
    ],
)
def test_structure_is_kept(text, kind, shown):
    assert kind in kinds_of(text)
    assert clean(text) == shown and kinds_of(shown) == []


def test_navigation_is_left_out():
    nav = "".join(f"<div><a href='{i}'>n{i}</a></div>" for i in range(30))
    body = "".join(f"<p>This is a long paragraph with many plain words in it, number {i}, and it goes on for a while.</p>" for i in range(15))
    text = from_html(f"<html><body>{nav}<h1>Head</h1>{body}{nav}</body></html>")
    assert "number 14" in text and "n12" not in text and "Head" in text
    assert content_lines([Line("short", 1)] * 3) == ["short"] * 3


def test_broken_and_long_html():
    assert clean("<p>open <b>and never closed " * 3)
    assert len(clean("<p>" + "word " * 200_000 + "</p>")) > 900_000


def test_rows(spark):
    rows = [(1, "<p>a</p>", None, "k"), (1, "<p>a</p>", None, "k"), (2, None, "**h**", ""), (3, "plain", "h", ""), (4, None, None, None)]
    df = spark.createDataFrame(rows, "chunk_id long, text string, heading string, kinds string")
    out = sorted((r.chunk_id, r.text, r.heading) for r in find_markup(df).collect())
    assert out == [(1, "a", None), (1, "a", None), (2, None, "h")]
    assert find_markup(df.limit(0)).count() == 0


@pytest.mark.parametrize("item", ["<li>short entry no. {}</li>\n", "<tr><td>row no. {}</td><td>{}</td></tr>\n", "<li>a wrapped\nentry no. {}</li>\n"])
def test_long_lists_and_tables_beside_paragraphs_stay_whole(item):
    body = "".join("<p>" + "This paragraph has many plain words in a row. " * 9 + "</p>\n" for _ in range(3))
    rows = "".join(item.replace("{}", str(i)) for i in range(100, 130))
    inside = f"<table>{rows}</table>" if "<tr>" in item else f"<ul>\n{rows}</ul>"
    for text in (from_html(body + inside), from_html(inside + body), from_html(body + "<h2>Head</h2>" + inside)):
        assert all(f"no. {i}" in text for i in range(100, 130))


def test_levels_code_and_formulas():
    got = converted("# One\n\n## Two\n\n```\n<b>x</b> = a[[1]]\n```\n<h3>Three</h3><pre>for x:\n    y</pre>== Four ==\n\\subsection{Five}\n")
    lines = got.text.split("\n")
    assert [(lines[k], kind, level) for k, kind, level in got.structure] == [("One", "heading", 1), ("Two", "heading", 2), ("    <b>x</b> = a[[1]]", "code", 0), ("Three", "heading", 3), ("for x:", "code", 0), ("    y", "code", 0), ("Four", "heading", 2), ("Five", "heading", 2)]
    assert formula(r"\frac{\frac{a}{b}}{c_{i+1}} + \sqrt[3]{x^{2}} \leq \text{all of it}") == "((a)/(b))/(c_(i+1)) + 3√(x^2) ≤ all of it"
    assert formula("{" * 5000) == "" and formula(r"\frac{a") == "(a)/()"
    assert clean("&amp;amp;amp;amp;lt; x **b** {{a|{{b|{{c|{{d|{{e|f}}}}}}}}}}").startswith("< x b")


def test_short_texts_reach_the_clusters(monkeypatch):
    from tessel.llm import markup

    seen = []
    monkeypatch.setattr(markup, "content_lines", lambda lines: seen.append(len(lines)) or content_lines(lines))
    assert clean("<p>a short one</p>") == "a short one" and clean("<ul><li>a</li><li>b</li></ul>") == "- a\n- b" and len(seen) == 2
    # Navigation goes from a text of few lines too; a signature stays.
    nav = "".join(f"<a href='{k}'>Go to page {k}</a><br>" for k in range(6))
    text = from_html("<p>" + "A long paragraph of many words. " * 12 + "</p>" + "<p>Yours, B.</p>" + nav)
    assert "Yours, B." in text and "page 5" not in text


def test_found_rows_of_the_tables_are_clean_outside_code(spark, folder):
    rows = find_markup(spark.read.parquet(f"{folder}/chunks.parquet")).collect()
    assert rows and not [r.chunk_id for r in rows if not any(x.kind == "code" for x in r.structure) and (kinds_of(r.text) or kinds_of(r.heading))]
