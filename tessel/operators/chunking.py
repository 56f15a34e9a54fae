"""Recursive splitting of texts into overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.functions.text import chunk_digest

# Separators from the strongest, and the sizes of the default configuration.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", "，", " ", "")
SIZE, OVERLAP = 1024, 128


class Splitter(Protocol):
    def split(self, text: str) -> list[str]:
        """The text in pieces; none for an empty text."""


class RecursiveSplitter:
    """Pieces of at most `size` code points, made of whole parts as long as a separator allows.

    The text is cut at the strongest separator that it has; parts that are
    still too long are cut at the next one. A separator stays at the end of its
    part, nothing is stripped. Neighbouring parts are joined while they fit;
    the next piece begins with as many of the last parts as fit into `overlap`.
    Parts are joined with parts of the same cut only: a part that is cut itself
    ends the piece before it, and the piece after it begins anew.
    """

    def __init__(self, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS):
        if size <= 0:
            raise ValueError("size must be positive")
        if not 0 <= overlap < size:
            raise ValueError("overlap must be from 0 to below size")
        self.size, self.overlap, self.separators = size, overlap, separators

    def split(self, text: str) -> list[str]:
        return self._cut(text, 0) if text else []

    def _cut(self, text: str, level: int) -> list[str]:
        last = len(self.separators) - 1
        while level < last and self.separators[level] not in text:
            level += 1
        sep = self.separators[level]
        parts = [p + sep for p in text.split(sep)] if sep else list(text)
        if sep:
            parts[-1] = parts[-1][: -len(sep)]
        pieces: list[str] = []
        small: list[str] = []
        for part in parts:
            if len(part) < self.size:
                small.append(part)
                continue
            pieces += self._joined(small)
            small = []
            pieces += self._cut(part, level + 1) if level < last else [part]
        return pieces + self._joined(small)

    def _joined(self, parts: list[str]) -> list[str]:
        """Parts put together to pieces, each beginning with what the overlap allows of the one before."""
        pieces: list[str] = []
        window: list[str] = []
        length = 0
        for part in filter(None, parts):
            if window and length + len(part) > self.size:
                pieces.append("".join(window))
                while window and (length > self.overlap or length + len(part) > self.size):
                    length -= len(window.pop(0))
            window.append(part)
            length += len(part)
        return pieces + ["".join(window)] if window else pieces


def split_segments(segments: list[tuple[str, str, int | None]], splitter: Splitter) -> list[tuple[int, str, str, int | None]]:
    """(seq, text, heading, page) of a document's segments (text, heading, page).

    Each segment is split on its own, so no piece crosses a heading; seq counts
    through the document.
    """
    pieces = ((p, heading, page) for text, heading, page in segments for p in splitter.split(text))
    return [(seq, *piece) for seq, piece in enumerate(pieces)]


def split_documents(df: DataFrame, text_col: str = "text", key_col: str = "doc_id", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, seq, digest, text): every text's chunks. Null and empty texts have none."""
    kind = df.schema[key_col].dataType.simpleString()
    splitter = RecursiveSplitter(size, overlap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows, seqs, texts = [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    own = splitter.split(text) if text else []
                    rows += [i] * len(own)
                    seqs += range(len(own))
                    texts += own
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int32())), pa.array(seqs, pa.int32()), pa.array(texts, pa.string())], names=[key_col, "seq", "text"])

    out = df.select(df[key_col], df[text_col]).where(F.char_length(df[text_col]) > 0).mapInArrow(run, f"`{key_col}` {kind}, seq int, text string")
    return out.select(key_col, "seq", chunk_digest("text").alias("digest"), "text")
