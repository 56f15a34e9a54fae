"""Markup residue: finding it, and converting it to clean, structured text.

Method: the standard library's streaming HTML parser turns a text into lines,
counting each line's characters, tags and characters of links or navigation; the
ratio of text to tags is smoothed with a Gaussian over the lines, and lines
below the threshold of one standard deviation form the cluster that regions of
navigation are in; of these, regions that are mostly links are left out. What
events the parser reports decides, with the grammars of Markdown, wiki text and
LaTeX, whether a text has markup at all; these are converted line by line.

The clean text is plain: headings are lines of their own, list items begin with
"- " or their number, code keeps its lines (fenced code four blanks further in),
formulas become plain characters with brackets where braces were. What cannot be
seen in plain text, the levels of headings and which lines are code, stands
beside it as a list of (line, kind, level).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.runtime import spread

# Element names of HTML, and of the wiki extensions that look like it.
HTML_TAGS = (
    "a abbr address article aside audio b big blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em embed "
    "fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main mark meta "
    "nav noscript object ol option p pre q ref nowiki gallery references s samp script section select small span strike strong style sub summary sup table tbody "
    "td textarea tfoot th thead time title tr tt u ul var video wbr"
).split()
BLOCKS = set("address article aside blockquote body center dd details div dl dt fieldset figure footer form head header hr html main nav ol p section table tbody tfoot thead tr ul title".split())
HEADINGS = {f"h{k}": k for k in range(1, 7)}
#: What stands in these elements counts like links.
ASIDE = {"a", "nav", "button", "select", "footer"}
UNSEEN = {"script", "style", "noscript", "iframe"}

# LaTeX names of signs.
SIGNS = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "theta": "θ", "lambda": "λ", "mu": "μ", "pi": "π", "rho": "ρ", "sigma": "σ",
    "tau": "τ", "phi": "φ", "omega": "ω", "Delta": "Δ", "Sigma": "Σ", "Omega": "Ω", "cdot": "·", "times": "×", "leq": "≤", "le": "≤", "geq": "≥", "ge": "≥",
    "neq": "≠", "approx": "≈", "infty": "∞", "pm": "±", "sum": "∑", "prod": "∏", "int": "∫", "sqrt": "√", "partial": "∂", "to": "→", "rightarrow": "→", "in": "∈",
    "ldots": "…", "dots": "…", "quad": " ", "qquad": " ", "div": "÷", "equiv": "≡", "subset": "⊂", "cup": "∪", "cap": "∩", "forall": "∀", "exists": "∃",
}

_tag = rf"</?(?:{'|'.join(HTML_TAGS)})(?=[\s/>])[^<>]*>"
_entity = r"&(?:[A-Za-z][A-Za-z0-9]{1,30}|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});"
_math = r"\$\$.+?\$\$|\$(?=[^$\n]*[\\^_{])[^\s$](?:[^$\n]*[^\s$])?\$(?!\d)|\\\(.+?\\\)|\\\[.+?\\\]"
_command = r"\\(?:begin|end|(?:sub)*section|paragraph|chapter|title|emph|text[a-z]{2}|underline|cite[a-z]?|ref|eqref|label|footnote|caption|url|href|item|includegraphics|frac|sqrt)\b\*?(?:\[[^\]\n]*\])?(?:\{|(?<=item))"

#: What counts as markup beside the events of the HTML parser, by kind.
KINDS = {
    "entity": re.compile(_entity),
    "markdown": re.compile(
        r"^ {0,3}#{1,6}[ \t]+\S"
        r"|\S[ \t]*\n(?:={3,}|-{3,})[ \t]*$"
        r"|^ {0,3}(?:```|~~~)"
        r"|^ {0,3}>[ \t]?\S"
        r"|\*\*(?=\S)[^*\n]+?(?<=\S)\*\*|(?<!\w)__(?=\w)[^_\n]+?(?<=[\w.,;:!?)])__(?!\w)|~~(?=\S)[^~\n]+?(?<=\S)~~"
        r"|(?<![\w*\\])\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*(?![\w*])|(?<![\w_\\/.])_(?=[^\W_])[^_\n]+?(?<=[\w.,;:!?)])_(?![\w/.])"
        r"|!?\[[^\]\[\n]*\]\([^)\s]*(?:[ \t]+\"[^\"\n]*\")?\)|^\[[^\]\n]+\]:[ \t]+\S"
        r"|(?<!`)`[^`\n]+`(?!`)"
        r"|^[ \t]*\|?(?:[ \t]*:?-{2,}:?[ \t]*\|)+(?:[ \t]*:?-{2,}:?[ \t]*)?$",
        re.M,
    ),
    "wiki": re.compile(r"^(={2,6})[ \t]*[^=\n].*?\1[ \t]*$|\[\[[^\[\]\n]*\]\]|\{\{[^{}]*\}\}|^\{\||^\|\}|''+[^'\n]+''+|\[https?://[^\s\]]+[^\]\n]*\]|^#REDIRECT", re.M),
    "latex": re.compile(rf"{_command}|{_math}|\{{\\(?:it|bf|em|tt|sc|rm|small|large)\b|\\(?:par|noindent|maketitle|newpage|hline|centering)\b(?![\\/:.\w])", re.S),
}
_bullets = re.compile(r"^[ \t]*(?:[-*+•]|\d+[.)])[ \t]+\S", re.M)


#: Marks for the way through the converters; these characters are never part of a text.
_HEAD, _OPEN, _CLOSE = "\ufdd0", "\ufdd8", "\ufdd9"
_marks = re.compile("[\ufdd0-\ufdd9]")


def kinds_of(text: str | None) -> list[str]:
    """The kinds of markup in a text; none for null and empty ones."""
    if not text:
        return []
    kinds = ["html"] if "<" in text and _parsed(text).events else []
    for k, p in KINDS.items():
        if p.search(text) and (k != "entity" or any(html.unescape(m.group()) != m.group() for m in p.finditer(text))):
            kinds.append(k)
    return kinds


@dataclass
class Line:
    """A line of a parsed text: how many tags it had, and how many of its characters stood in links or navigation."""

    text: str
    tags: int = 0
    linked: int = 0


class _Events(HTMLParser):
    """Parser events to lines with their counts; what is no known tag stays text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.line = Line("")
        self.events = 0
        self.hidden = self.code = self.aside = 0
        self.lists: list[int | None] = []
        self.cells = 0

    def end_line(self, blank: bool = False) -> None:
        line = self.line
        line.text = line.text.rstrip() if self.code else re.sub(r"[ \t]+", " ", line.text).strip()
        if line.text and not _marks.sub("", line.text):
            line.text = ""
        if line.text or line.tags:
            self.lines.append(line)
        if blank and self.lines and self.lines[-1].text:
            self.lines.append(Line(""))
        self.line = Line("")

    def add(self, text: str) -> None:
        if self.code and not self.line.text and text:
            self.line.text = _CLOSE
        self.line.text += text
        if self.aside:
            self.line.linked += len(text)

    def tag(self) -> None:
        self.events += 1
        self.line.tags += 1

    def handle_starttag(self, tag, attrs):
        if tag not in HTML_TAGS:
            self.handle_data(self.get_starttag_text() or f"<{tag}>")
            return
        self.tag()
        self.aside += tag in ASIDE
        if tag in UNSEEN:
            self.hidden += 1
        elif tag in HEADINGS:
            self.end_line(True)
            self.line.text = chr(ord(_HEAD) + HEADINGS[tag])
        elif tag in ("ul", "ol"):
            self.end_line()
            self.lists.append(1 if tag == "ol" else None)
        elif tag == "li":
            self.end_line()
            number = self.lists[-1] if self.lists else None
            self.line.text = "- " if number is None else f"{number}. "
            if number is not None:
                self.lists[-1] = number + 1
        elif tag == "pre":
            self.end_line(True)
            self.code += 1
        elif tag in ("td", "th"):
            self.line.text += " | " if self.cells else ""
            self.cells += 1
        elif tag == "tr":
            self.end_line()
            self.cells = 0
        elif tag == "br":
            self.end_line()
        elif tag == "img":
            self.add(dict(attrs).get("alt") or "")
        elif tag == "ref":
            self.add(" (")
        elif tag in BLOCKS:
            self.end_line(tag == "p")

    def handle_startendtag(self, tag, attrs):
        if tag == "ref":
            self.tag()
            return
        self.handle_starttag(tag, attrs)
        self.aside -= tag in ASIDE
        if tag in UNSEEN:
            self.hidden -= 1

    def handle_endtag(self, tag):
        if tag not in HTML_TAGS:
            self.handle_data(f"</{tag}>")
            return
        self.tag()
        if tag in ASIDE:
            self.aside = max(0, self.aside - 1)
        if tag in UNSEEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in HEADINGS:
            self.end_line(True)
        elif tag in ("ul", "ol"):
            self.end_line(True)
            if self.lists:
                self.lists.pop()
        elif tag == "pre":
            self.end_line(True)
            self.code = max(0, self.code - 1)
        elif tag == "ref":
            self.add(")")
        elif tag in BLOCKS or tag == "li":
            self.end_line(tag in ("p", "table", "section", "div"))

    def handle_data(self, data):
        if self.hidden:
            return
        for k, part in enumerate(data.split("\n")):
            if k:
                if self.code or self.line.text.strip():
                    self.end_line()
                elif self.lines and self.lines[-1].text:
                    self.lines.append(Line(""))
            self.add(part)

    def handle_comment(self, data):
        self.events += 1

    def handle_decl(self, decl):
        self.events += 1

    def unknown_decl(self, data):
        self.events += 1
        self.handle_data(data.partition("[")[2] if data.startswith("CDATA[") else "")


_not_tag = re.compile(rf"<(?!/?(?:{'|'.join(HTML_TAGS)})(?=[\s/>])[^<>]*>|!--|!DOCTYPE|!\[CDATA\[)", re.I)


def _parsed(text: str) -> _Events:
    """The parser after all of the text. It needs names that it may take for a tag; other angle brackets are text."""
    parser = _Events()
    parser.feed(_not_tag.sub("&lt;", text))
    parser.close()
    parser.end_line()
    return parser


def content_lines(lines: list[Line], sigma: float = 1.5) -> list[str]:
    """The lines in content regions, by a threshold on the smoothed text-to-tag ratios.

    The threshold is the standard deviation of the smoothed ratios, so texts of
    even ratios, short ones too, are content throughout. Lines below it that
    follow each other are a region; it is left out if at least half of its
    characters stand in links or navigation. Lists, tables and headings without
    links always stay.
    """
    lines = [line for line in lines if line.text or not line.tags]
    full = [k for k, line in enumerate(lines) if line.text]
    if not full:
        return []
    ratio = np.array([len(lines[k].text) / max(1, lines[k].tags) for k in full], float)
    reach = np.arange(-4, 5)
    kernel = np.exp(-(reach**2) / (2 * sigma**2))
    # "same" would pad a short row of ratios to the kernel's length.
    around = lambda x: np.convolve(x, kernel)[len(reach) // 2 : len(reach) // 2 + len(x)]
    smooth = around(ratio) / around(np.ones(len(ratio)))
    low = smooth < smooth.std()
    gone: set[int] = set()
    begin = 0
    for k in range(len(full) + 1):
        if k == len(full) or not low[k]:
            region = [lines[x] for x in full[begin:k]]
            if region and 2 * sum(line.linked for line in region) >= sum(len(line.text) for line in region):
                gone.update(full[begin:k])
            begin = k + 1
    return [line.text for k, line in enumerate(lines) if k not in gone]


def from_html(text: str) -> str:
    """HTML to lines of text; headings and code bear marks."""
    return re.sub(r"\n{3,}", "\n\n", "\n".join(content_lines(_parsed(text).lines))).strip()


def _argument(s: str, i: int) -> tuple[str, int]:
    """What a command at i is about: a group in braces, a command, or one character; and where it ends."""
    while i < len(s) and s[i] in " \t":
        i += 1
    if i < len(s) and s[i] == "{":
        depth, j = 0, i
        while j < len(s):
            depth += (s[j] == "{") - (s[j] == "}")
            j += 2 if s[j] == "\\" else 1
            if not depth:
                return s[i + 1 : j - 1], j
        return s[i + 1 :], len(s)
    m = re.compile(r"\\[A-Za-z]+|.", re.S).match(s, i)
    return (m.group(), m.end()) if m else ("", i)


def formula(source: str) -> str:
    """A LaTeX formula in plain characters; fractions, roots and exponents keep what belongs together in brackets."""
    try:
        return re.sub(r"[ \t]+", " ", _formula(source)).strip()
    except RecursionError:
        return re.sub(r"[{}]", "", source)


def _formula(s: str) -> str:
    out, i = [], 0
    while i < len(s):
        ch = s[i]
        if ch == "\\":
            m = re.compile(r"\\([A-Za-z]+)\*?").match(s, i)
            if not m:
                out.append({"\\": "\n", "{": "{", "}": "}", "%": "%", "&": "&", "_": "_", "#": "#", "$": "$"}.get(s[i + 1 : i + 2], ""))
                i += 2
                continue
            name, i = m.group(1), m.end()
            if name in ("frac", "dfrac", "tfrac"):
                above, i = _argument(s, i)
                below, i = _argument(s, i)
                out.append(f"({_formula(above)})/({_formula(below)})")
            elif name == "sqrt":
                m = re.compile(r"\[([^\]]*)\]").match(s, i)
                root, i = (m.group(1), m.end()) if m else ("", i)
                inner, i = _argument(s, i)
                inner = _formula(inner)
                out.append(f"{root}√" + (inner if len(inner) == 1 else f"({inner})"))
            elif name in ("text", "mathrm", "mathbf", "mathit", "mathcal", "mathbb", "operatorname", "overline", "vec", "hat", "bar"):
                inner, i = _argument(s, i)
                out.append(_formula(inner))
            elif name in ("begin", "end"):
                i = _argument(s, i)[1]
            elif name not in ("left", "right", "displaystyle", "limits", "big", "Big"):
                out.append(SIGNS.get(name, name))
        elif ch in "_^":
            inner, i = _argument(s, i + 1)
            inner = _formula(inner)
            out.append(ch + (inner if inner.isalnum() or len(inner) == 1 else f"({inner})"))
        else:
            out.append("" if ch in "{}" else " " if ch == "&" else ch)
            i += 1
    return "".join(out)


def _until_same(text: str, *steps: tuple[str, object]) -> str:
    """The replacements over and over, as nested ones come to the surface."""
    while True:
        before = text
        for pattern, by in steps:
            text = re.sub(pattern, by, text)
        if text == before:
            return text


def _section(m: re.Match) -> str:
    level = {"chapter": 1, "title": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}.get(m.group(1))
    return (chr(ord(_HEAD) + level) if level else "") + m.group(2) + "\n"


def from_latex(text: str) -> str:
    """LaTeX to text; formulas become plain characters."""
    s = re.sub(r"(?<!\\)%[^\n]*\n(?=\s*\\)", "", text)
    s = re.sub(r"\\begin\{(equation|align|gather|displaymath|math|eqnarray)(\*?)\}(.*?)\\end\{\1\2\}", lambda m: "\n" + formula(m.group(3)) + "\n", s, flags=re.S)
    s = re.sub(_math, lambda m: formula(m.group().strip("$") if m.group()[0] == "$" else m.group()[2:-2]), s, flags=re.S)
    s = re.sub(r"[ \t]*\\(?:begin|end)\{[^{}\n]*\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?", "", s)
    s = re.sub(r"^[ \t]*\\item\b(?:\[([^\]\n]*)\])?[ \t]*", lambda m: f"- {m.group(1)} " if m.group(1) else "- ", s, flags=re.M)
    s = re.sub(r"[ \t]*\\(?:label|includegraphics|bibliography|bibliographystyle|usepackage|documentclass)(?:\[[^\]\n]*\])?\{[^{}\n]*\}", "", s)
    s = re.sub(r"[ ~]?\\(?:ref|eqref|pageref)\{([^{}\n]*)\}", r" (\1)", s)
    s = re.sub(r"[ ~]?\\cite[a-z]?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}", r" [\1]", s)
    s = re.sub(r"\\href\{[^{}\n]*\}\{([^{}\n]*)\}", r"\1", s)
    s = _until_same(
        s,
        (r"\\((?:sub)*section|paragraph|chapter|title|caption)\*?\{([^{}\n]*)\}", _section),
        (r"\\(?:emph|text[a-z]{2}|underline|url|footnote)\{([^{}]*)\}", r"\1"),
        (r"\{\\(?:it|bf|em|tt|sc|rm|small|large)\b[ \t]*([^{}]*)\}", r"\1"),
    )
    return re.sub(r"\\(?:par|noindent|maketitle|newpage|hline|centering)\b(?![\\/:.\w])[ \t]*", "", s)


def from_wiki(text: str) -> str:
    """Wiki text to text; infoboxes and tables become `name: value` and `a | b` rows."""
    s = re.sub(r"^(={2,6})[ \t]*([^=\n].*?)[ \t]*\1[ \t]*$", lambda m: f"\n{chr(ord(_HEAD) + len(m.group(1)))}{m.group(2)}\n", text, flags=re.M)
    s = _until_same(s, (r"\{\{([^{}]*)\}\}", _template))
    s = re.sub(r"^\{\|[^\n]*$|^\|\}[ \t]*$|^\|-[^\n]*$", "", s, flags=re.M)
    s = re.sub(r"^\|\+[ \t]*", "", s, flags=re.M)
    if re.search(r"^\{\|", text, re.M):
        s = re.sub(r"^[!|][ \t]*(.*)$", lambda m: re.sub(r"[ \t]*(?:\|\||!!)[ \t]*", " | ", m.group(1)), s, flags=re.M)
    s = re.sub(r"\[\[(?:Category|Kategorie|Catégorie|Categoría|Категория|分类|File|Image|Datei|Fichier):[^\[\]\n]*\]\]", "", s)
    s = re.sub(r"\[\[(?:[^\[\]\n|]*\|)?([^\[\]\n|]*)\]\]", r"\1", s)
    s = re.sub(r"\[https?://[^\s\]]+[ \t]*([^\]\n]*)\]", r"\1", s)
    s = re.sub(r"^([*#]+)[ \t]*(?=\S)", "- ", s, flags=re.M) if re.search(r"\[\[|''|^==", text, re.M) else s
    return re.sub(r"'{2,5}([^'\n]+)'{2,5}", r"\1", s)


def _template(m: re.Match) -> str:
    head, *fields = (p.strip() for p in m.group(1).split("|"))
    shown = [f"{a.strip()}: {b.strip()}" if b else a.strip() for a, _, b in (f.partition("=") for f in fields)]
    return "\n".join(shown) if "\n" in m.group(1) else ", ".join([head, *shown]) if shown else ""


def from_markdown(text: str) -> str:
    """Markdown to text; code has been taken out before."""
    out = []
    for line in text.split("\n"):
        if re.fullmatch(r"(?:={3,}|-{3,})[ \t]*", line) and out and out[-1].strip():
            out[-1] = chr(ord(_HEAD) + (1 if line[0] == "=" else 2)) + _marks.sub("", out[-1])
            out.append("")
            continue
        if re.fullmatch(r"[ \t]*\|?(?:[ \t]*:?-{2,}:?[ \t]*\|)+(?:[ \t]*:?-{2,}:?[ \t]*)?", line):
            continue
        line = re.sub(r"^ {0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*$", lambda m: chr(ord(_HEAD) + len(m.group(1))) + m.group(2), line)
        line = re.sub(r"^(?: {0,3}>[ \t]?)+", "", line)
        line = re.sub(r"^([ \t]*)[*+•][ \t]+", r"\1- ", line)
        line = re.sub(r"^\[([^\]\n]+)\]:[ \t]+\S+.*$", r"\1", line)
        line = re.sub(r"!?\[([^\]\[\n]*)\]\([^)\s]*(?:[ \t]+\"[^\"\n]*\")?\)", r"\1", line)
        line = re.sub(r"\*\*(?=\S)([^*\n]+?)(?<=\S)\*\*|(?<!\w)__(?=\w)([^_\n]+?)__(?!\w)|~~(?=\S)([^~\n]+?)(?<=\S)~~", lambda m: next(x for x in m.groups() if x), line)
        line = re.sub(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?![\w*])|(?<![\w_\\/.])_(?=[^\W_])([^_\n]+?)_(?![\w/.])", lambda m: m.group(1) or m.group(2), line)
        out.append(re.sub(r"(?<!`)`([^`\n]+)`(?!`)", r"\1", line))
    return "\n".join(out)


_fence = re.compile(r"^ {0,3}(`{3,}|~{3,})[^\n`]*\n(.*?)(?:^ {0,3}\1[`~]*[ \t]*(?:\n|\Z)|\Z)", re.M | re.S)
_verbatim = re.compile(r"\\begin\{(verbatim|lstlisting)\}(?:\[[^\]\n]*\])?\n?(.*?)\n?\\end\{\1\}", re.S)


@dataclass
class Clean:
    """A text without markup, the kinds that it had, and its headings and code by line (0-based); level is 0 for code."""

    text: str | None
    kinds: list[str]
    structure: list[tuple[int, str, int]]


def converted(text: str | None) -> Clean:
    """The clean text. Texts without markup, null and empty ones come back as they are; converting ends when nothing is left or nothing changes."""
    found = kinds_of(text)
    if not found:
        return Clean(text, [], [])
    code: list[str] = []

    def taken(m: re.Match, indent: str) -> str:
        lines = []
        for line in m.group(2).removesuffix("\n").split("\n"):
            code.append(indent + line)
            lines.append(f"{_OPEN}{len(code) - 1}{_CLOSE}")
        return "\n".join(lines) + "\n"

    text = _marks.sub("\ufffd", text)
    text = _verbatim.sub(lambda m: "\n" + taken(m, ""), _fence.sub(lambda m: taken(m, "    "), text))
    while kinds := kinds_of(text):
        before = text
        if "html" in kinds:
            text = from_html(text)
            # Lines of preformatted text bear a mark; they are code from here on.
            text = re.sub(f"^{_CLOSE}(.*)$", lambda m: (code.append(m.group(1)), f"{_OPEN}{len(code) - 1}{_CLOSE}")[1], text, flags=re.M)
        elif "entity" in kinds:
            text = html.unescape(text).replace("\xa0", " ")
        if "latex" in kinds:
            text = from_latex(text)
        if "wiki" in kinds:
            text = from_wiki(text)
        if "markdown" in kinds:
            text = from_markdown(text)
        text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", text)).strip("\n")
        if text == before or len(text) > 2 * len(before) + 100:
            break
    text, structure = text.strip("\n"), []
    lines = text.split("\n")
    for k, line in enumerate(lines):
        if m := re.match(f"([{chr(ord(_HEAD) + 1)}-{chr(ord(_HEAD) + 6)}])", line):
            structure.append((k, "heading", ord(m.group(1)) - ord(_HEAD)))
        elif re.fullmatch(f"{_OPEN}\\d+{_CLOSE}", line):
            structure.append((k, "code", 0))
        lines[k] = _marks.sub("", re.sub(f"{_OPEN}(\\d+){_CLOSE}", lambda m: code[int(m.group(1))], line))
    return Clean("\n".join(lines), found, structure)


def clean(text: str | None) -> str | None:
    """The clean text alone."""
    return converted(text).text


#: No markup is without one of these; tested in the JVM before rows go to Python.
SUSPECT = r"(?m)\|\}|[<&`\[{\\$~>*]|==|--|''|__|_\S|^ {0,3}#"


def find_markup(df: DataFrame, columns: tuple[str, ...] = ("text", "heading"), key_cols: tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    """The rows in which a column has markup.

    Columns: the keys, kinds array<string> (over all columns, sorted), each
    column's clean text under its own name, and structure, an array of (line,
    kind, level) for the first column: its headings with their level, and lines
    of code. Nulls stay null and, like empty texts, are not cases; repeated rows
    come out each; an empty table gives none. Texts are read whole, there is no
    shuffle, and rows without any sign of markup never leave the JVM.
    """
    from pyspark.sql import types as T

    maybe = F.lit(False)
    for c in columns:
        maybe = maybe | F.coalesce(df[c].rlike(SUSPECT), F.lit(False))
    k = len(key_cols)
    item = T.StructType([T.StructField("line", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("level", T.IntegerType())])
    arrow_item = pa.list_(pa.struct([("line", pa.int32()), ("kind", pa.string()), ("level", pa.int32())]))
    schema = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in key_cols), T.StructField("kinds", T.ArrayType(T.StringType())), *(T.StructField(c, T.StringType()) for c in columns), T.StructField("structure", T.ArrayType(item))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, made = [], []
            for i, row in enumerate(zip(*(batch.column(k + j).to_pylist() for j in range(len(columns))))):
                own = [converted(t) for t in row]
                if any(c.kinds for c in own):
                    rows.append(i)
                    made.append(own)
            take = pa.array(rows, pa.int32())
            arrays = [*(batch.column(j).take(take) for j in range(k)), pa.array([sorted({x for c in own for x in c.kinds}) for own in made], pa.list_(pa.string()))]
            arrays += [pa.array([own[j].text for own in made], pa.string()) for j in range(len(columns))]
            arrays.append(pa.array([[dict(zip(("line", "kind", "level"), x)) for x in own[0].structure] for own in made], arrow_item))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return spread(df.select(*(df[c] for c in key_cols), *(df[c] for c in columns)).where(maybe)).mapInArrow(run, schema)
