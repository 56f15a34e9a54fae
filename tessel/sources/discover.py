"""Finding files, with ignore rules."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from pathlib import Path

# Endings that can be extracted, and what is never looked at.
SUPPORTED = (".txt", ".md", ".markdown", ".docx", ".pdf")
HOME, IGNORE_FILE = ".tessel", ".tesselignore"


def _regex(pattern: str) -> str:
    """A pattern of an ignore file as a regular expression on paths from the root."""
    anchored = "/" in pattern.rstrip("/")
    body = pattern.strip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            out, i = out + "/.*", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and "]" in body[i + 2 :]:
            end = body.index("]", i + 2)
            out, i = out + "[" + body[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        elif body[i] == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + re.escape(body[i]), i + 1
    return ("" if anchored else "(?:.*/)?") + out + ("/.*" if pattern.endswith("/") else "(?:/.*)?")


@dataclass(frozen=True)
class IgnoreRules:
    """Ordered rules; the last one that matches decides, and ! takes a path back in."""

    rules: tuple[tuple[bool, re.Pattern], ...]

    @classmethod
    def of(cls, lines: list[str]) -> IgnoreRules:
        rules = []
        for line in lines:
            text = line.rstrip("\n")
            text = text if text.endswith("\\ ") else text.rstrip()
            if not text or text.startswith("#"):
                continue
            keep = text.startswith("!")
            text = text[1:] if keep or text.startswith("\\") else text
            rules.append((not keep, re.compile(_regex(text))))
        return cls(tuple(rules))

    def ignores(self, path: str) -> bool:
        out = False
        for ignore, pattern in self.rules:
            if pattern.fullmatch(path):
                out = ignore
        return out


def rules_for(root: Path, ignore_files: tuple[str, ...] = ()) -> IgnoreRules:
    """The engine's folder, then the root's ignore file, then the configured ones; ignore files themselves stay out."""
    lines = [f"{HOME}/**"]
    for name in (IGNORE_FILE, *ignore_files):
        lines.append("/" + name)
        if (root / name).is_file():
            lines += (root / name).read_text("utf-8", "replace").splitlines()
    return IgnoreRules.of(lines)


def discover(root: str | os.PathLike, ignore_files: tuple[str, ...] = ()) -> list[tuple[str, float, int]]:
    """(path from the root, mtime, size) of all files that no rule ignores, sorted by path.

    FileNotFoundError if the root is missing. Names that begin with a dot are
    files like others.
    """
    base = Path(root)
    if not base.is_dir():
        raise FileNotFoundError(str(root))
    rules = rules_for(base, ignore_files)
    out = []
    for folder, _, names in os.walk(base):
        for name in names:
            at = Path(folder, name)
            path = at.relative_to(base).as_posix()
            if at.is_file() and not rules.ignores(path):
                stat = at.stat()
                out.append((path, stat.st_mtime, stat.st_size))
    return sorted(out, key=lambda x: x[0].split("/"))


def supported(path: str) -> bool:
    return Path(path).suffix.lower() in SUPPORTED
