"""Splitting oversized texts at natural boundaries.

Method: dynamic programming over boundary positions. A cut costs its kind's
penalty (a paragraph end is cheap, the middle of a word dear) plus the square of
how far its piece is from the even share; the sum is minimised subject to the
largest length and the stated overlap between consecutive pieces.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.operators.sizes import fits_broadcast
from tessel.runtime import materialize

SIZE, OVERLAP = 1024, 128

#: Kinds of boundary, from the most natural; a cut is made after the match. With the penalty of a cut there.
BOUNDARIES = (
    (re.compile(r"\n[^\S\n]*\n\s*"), 0.0),
    (re.compile(r"\n\s*"), 0.05),
    (re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[”’」』）]*\s*"), 0.1),
    (re.compile(r"[;:]\s+|[；：]\s*"), 0.25),
    (re.compile(r",\s+|[，、]\s*|\s[–—-]\s"), 0.4),
    (re.compile(r"\s+"), 0.7),
)
INSIDE = 3.0
#: Weaker kinds are looked at only where the stronger ones leave a gap of this share of the room in a piece.
GAP = 0.25
#: Boundaries of one kind that follow each other closer than this part of such a gap count as one.
CLOSE = 12
EVEN = 1.0


def boundaries(text: str, room: int) -> list[tuple[int, float]]:
    """Positions at which a cut is allowed, with penalties, no gap being over `room`."""
    gaps = [(0, len(text))]
    found: dict[int, float] = {}
    limit = max(1, int(room * GAP))
    near = max(1, limit // CLOSE)
    for pattern, penalty in BOUNDARIES:
        still = []
        for start, stop in gaps:
            at, last = start, start - near
            for m in pattern.finditer(text, start, stop):
                if m.end() >= stop:
                    break
                if m.end() - last >= near:
                    found.setdefault(m.end(), penalty)
                    last = m.end()
                if m.end() - at > limit:
                    still.append((at, m.end()))
                at = m.end()
            if stop - at > limit:
                still.append((at, stop))
        gaps = still
        if not gaps:
            break
    for start, stop in gaps:
        for at in range(start + limit, stop, limit):
            if 0xDC00 > ord(text[at]) or ord(text[at]) > 0xDFFF:
                found.setdefault(at, INSIDE)
    return sorted(found.items())


def cuts(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[int]:
    """The best positions to cut; none if the text fits."""
    n = len(text)
    if n <= size:
        return []
    room = size - overlap
    spots = [(0, 0.0), *boundaries(text, room), (n, 0.0)]
    at = [p for p, _ in spots]
    count = -(-(n - overlap) // room)
    share = (n - overlap) / count
    best: list[float] = [0.0]
    back = [0]
    for j in range(1, len(spots)):
        end, penalty = spots[j]
        low, choice = float("inf"), -1
        for i in range(bisect_left(at, end - room), j):
            length = end - at[i]
            if i and length > room:
                continue
            cost = best[i] + EVEN * ((length - share) / room) ** 2
            if cost < low:
                low, choice = cost, i
        # Only the first piece has no overlap before it, so it may be longer.
        if end <= size:
            cost = EVEN * ((end - overlap - share) / room) ** 2
            if cost < low:
                low, choice = cost, 0
        best.append(low + penalty + (0.01 if j < len(spots) - 1 else 0))
        back.append(choice)
    out, j = [], len(spots) - 1
    while j:
        j = back[j]
        out.append(at[j])
    return sorted(out)[1:]


def pieces(text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """The text in pieces of at most `size` code points, consecutive ones sharing exactly `overlap`.

    A text that fits is one piece; null and empty texts give none. Without the
    overlaps the pieces join to the text.
    """
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap from 0 to below size")
    if not text:
        return []
    edges = [0, *cuts(text, size, overlap), len(text)]
    return [text[max(0, a - overlap if k else 0) : b] for k, (a, b) in enumerate(zip(edges, edges[1:]))]


def split_oversized(
    df: DataFrame,
    text_col: str = "text",
    key_cols: tuple[str, ...] = ("chunk_id",),
    size: int = SIZE,
    overlap: int = OVERLAP,
) -> DataFrame:
    """The rows whose text is longer than `size`, one row per piece.

    Columns: the keys, piece int (0-based), of int (the row's number of pieces)
    and `text_col`. Rows that fit, null texts and empty tables give no rows;
    repeated rows are split each. The filter runs in the JVM, so only long
    texts reach Python; there is no shuffle.
    """
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap from 0 to below size")
    keys = [df[c] for c in key_cols]
    schema = T.StructType(
        [*(T.StructField(c, df.schema[c].dataType) for c in key_cols), T.StructField("piece", T.IntegerType()), T.StructField("of", T.IntegerType()), T.StructField(text_col, T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, number, of, out = [], [], [], []
                for i, text in enumerate(part.column(len(key_cols)).to_pylist()):
                    cut = pieces(text, size, overlap)
                    row += [i] * len(cut)
                    number += range(len(cut))
                    of += [len(cut)] * len(cut)
                    out += cut
                take = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k).take(take) for k in range(len(key_cols))), pa.array(number, pa.int32()), pa.array(of, pa.int32()), pa.array(out, pa.string())],
                    names=[*key_cols, "piece", "of", text_col],
                )

    return df.select(*keys, df[text_col]).where(F.char_length(df[text_col]) > size).mapInArrow(run, schema)


def resequenced(
    df: DataFrame,
    text_col: str = "text",
    heading_col: str = "heading",
    content_col: str = "content_digest",
    seq_col: str = "seq",
    size: int = SIZE,
    overlap: int = OVERLAP,
    span: int = 4096,
) -> DataFrame:
    """All texts in pieces within `size`, with their heading and a gapless 0-based seq per content.

    Columns: content, seq int, source_seq, piece int, heading, text. Pieces are
    ordered by the old seq (nulls first), then by position. Rows with null or
    empty text give no piece, so seq stays gapless; a null content is a content
    of its own; rows that repeat content and seq are numbered in the order of
    heading and text. Other columns are dropped.

    A content may hold any share of the rows: the numbers are running sums in
    two steps, over spans of `span` old seqs and then over the spans' totals, so
    no task sorts a whole content. The pieces are made once and written to the
    shared folder; totals are counted from there without their texts.
    """
    names = {text_col: "text", heading_col: "heading", content_col: "content", seq_col: "source_seq"}
    rows = df.select(*(df[c].alias(n) for c, n in names.items())).where(F.char_length(F.col("text")) > 0)
    whole = rows.select("content", "source_seq", "heading", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                row, number, out = [], [], []
                for i, text in enumerate(part.column(3).to_pylist()):
                    cut = pieces(text, size, overlap)
                    row += [i] * len(cut)
                    number += range(len(cut))
                    out += cut
                take = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(take) for k in range(3)), pa.array(number, pa.int32()), pa.array(out, pa.string())], names=["content", "source_seq", "heading", "piece", "text"])

    schema = T.StructType([*whole.schema.fields[:3], T.StructField("piece", T.IntegerType()), T.StructField("text", T.StringType())])
    cut = materialize(whole.mapInArrow(run, schema)).withColumn("_span", F.floor(F.coalesce("source_seq", F.lit(-1)) / span))
    totals = materialize(cut.groupBy("content", "_span").agg(F.count(F.lit(1)).alias("_n")))
    before = totals.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("content").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("content", "_span").orderBy(F.asc_nulls_first("source_seq"), "heading", "piece", "text")
    numbered = cut.withColumn("_at", F.row_number().over(inside) - 1).alias("c")
    same = F.col("c.content").eqNullSafe(F.col("b.content")) & (F.col("c._span") == F.col("b._span"))
    return numbered.join(fits_broadcast(before).alias("b"), same).select(
        F.col("c.content").alias(content_col),
        (F.col("_before") + F.col("_at")).cast("int").alias(seq_col),
        F.col("source_seq"),
        F.col("piece"),
        F.col("heading").alias(heading_col),
        F.col("text").alias(text_col),
    )
