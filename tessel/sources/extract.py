"""Text out of file bytes: plain text, Markdown, DOCX, and PDF where a parser is installed."""

from __future__ import annotations

import io
import re
import zipfile
from dataclasses import dataclass
from pathlib import PurePosixPath
from xml.etree import ElementTree

# Names in the DOCX format.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class ExtractionError(ValueError):
    """A file that its parser cannot read."""


@dataclass(frozen=True)
class Segment:
    """A stretch of a document under one heading or on one page."""

    text: str
    heading: str = ""
    page: int | None = None


def decode_text(data: bytes) -> str:
    """UTF-8 with or without a mark; UTF-16 if it has one; else Latin-1, which never fails."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        try:
            return data.decode("utf-16")
        except UnicodeDecodeError:
            pass
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def extract(data: bytes, path: str) -> list[Segment] | None:
    """A file's segments; None for endings that are not supported. ExtractionError if the parser fails."""
    suffix = PurePosixPath(path).suffix.lower()
    try:
        if suffix in (".txt", ".md", ".markdown"):
            text = decode_text(data)
            return [Segment(text)] if text.strip() else []
        if suffix == ".docx":
            return docx_segments(data)
        if suffix == ".pdf":
            return pdf_segments(data)
    except ExtractionError:
        raise
    except Exception as e:
        raise ExtractionError(f"{path}: {e}") from e
    return None


def document_text(segments: list[Segment]) -> str:
    """Segments joined by a blank line."""
    return "\n\n".join(s.text for s in segments)


def _runs(node: ElementTree.Element) -> str:
    out = []
    for x in node.iter():
        if x.tag == _W + "t":
            out.append(x.text or "")
        elif x.tag in (_W + "tab",):
            out.append("\t")
        elif x.tag in (_W + "br", _W + "cr"):
            out.append("\n")
    return "".join(out)


def docx_segments(data: bytes) -> list[Segment]:
    """Sections by their headings: the heading is the chain of titles above, joined by " / "; its own line is part of the text.

    Table rows become `a | b` lines. Sections without text are left out.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
        names = _style_names(z)
    body = root.find(_W + "body")
    chain: list[tuple[int, str]] = []
    lines: list[str] = []
    out: list[Segment] = []

    def close() -> None:
        text = "\n".join(lines).strip()
        if text:
            out.append(Segment(text, " / ".join(t for _, t in chain)))
        lines.clear()

    for node in body if body is not None else ():
        if node.tag == _W + "p":
            text = _runs(node).strip()
            level = _level(node, names)
            if level is not None and text:
                close()
                while chain and chain[-1][0] >= level:
                    chain.pop()
                chain.append((level, text))
            if text:
                lines.append(text)
        elif node.tag == _W + "tbl":
            for row in node.iter(_W + "tr"):
                lines.append(" | ".join(" ".join(_runs(p).strip() for p in cell.iter(_W + "p")).strip() for cell in row.findall(_W + "tc")))
    close()
    return out


def _style_names(z: zipfile.ZipFile) -> dict[str, str]:
    if "word/styles.xml" not in z.namelist():
        return {}
    styles = ElementTree.fromstring(z.read("word/styles.xml"))
    return {s.get(_W + "styleId", ""): (n.get(_W + "val", "") if (n := s.find(_W + "name")) is not None else "") for s in styles.iter(_W + "style")}


def _level(paragraph: ElementTree.Element, names: dict[str, str]) -> int | None:
    style = paragraph.find(f"{_W}pPr/{_W}pStyle")
    if style is None:
        return None
    value = style.get(_W + "val", "")
    name = names.get(value, value).lower().replace(" ", "")
    if name == "title":
        return 0
    m = re.fullmatch(r"heading([1-9])", name)
    return int(m.group(1)) if m else None


def pdf_segments(data: bytes) -> list[Segment]:
    """Pages with text, by their real numbers; a page where outline entries begin has their chain as heading."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ExtractionError("no PDF parser is installed") from e
    reader = PdfReader(io.BytesIO(data))
    chains: dict[int, str] = {}

    def walk(entries, above: tuple[str, ...]) -> None:
        last = above
        for e in entries:
            if isinstance(e, list):
                walk(e, last)
            else:
                last = (*above, e.title)
                chains.setdefault(reader.get_destination_page_number(e), " / ".join(last))

    walk(reader.outline, ())
    texts = [(p.extract_text() or "").strip() for p in reader.pages]
    return [Segment(t, chains.get(i, ""), i + 1) for i, t in enumerate(texts) if t]
