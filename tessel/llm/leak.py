"""Evaluation passages inside a corpus.

Method: the test items' normalised word n-grams are a hash set sent to all
executors; a document's word windows are looked up in it, each hit fixes an
alignment of document and item, and the alignment is verified word by word.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.runtime import spread

SEED = 3
RUN = 12
REPLACED = 0.1
BLOCK_WORDS = 2_000_000

_word = re.compile(r"[^\W_]+")
_plain = re.compile(r"[­​-‏⁠﻿]")


def words_of(text: str) -> list[str]:
    """Words without case, punctuation and invisible characters."""
    return _word.findall(unicodedata.normalize("NFKC", _plain.sub("", text)).casefold())


class Items:
    """Test items, with the hash set of their n-grams.

    Words get numbers, so that a document word that no item has rules out every
    window over it with one lookup.
    """

    def __init__(self, items: list[tuple[object, str | None]], seed: int = SEED):
        self.source, self.seed, self.ids, self.words, self.number = items, seed, [], [], {}
        self.grams: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for key, text in items:
            numbers = [self.number.setdefault(w, len(self.number)) for w in words_of(text or "")]
            k = len(self.ids)
            self.ids.append(key)
            self.words.append(numbers)
            for i in range(len(numbers) - seed + 1):
                self.grams[tuple(numbers[i : i + seed])].append((k, i))

    def runs(self, text: str, run: int, replaced: float) -> dict[int, list[tuple[int, int]]]:
        """By item index, the word ranges of the document that repeat at least `run` of its words in a row.

        Words may differ one at a time: never two neighbours, and at most the
        share `replaced` of the range.
        """
        get = self.number.get
        doc = [get(w, -1) for w in words_of(text)]
        diagonals = set()
        if len(doc) < run:
            return {}
        windows = zip(*(doc[i:] for i in range(self.seed)))
        grams = self.grams
        for i, gram in enumerate(windows):
            if -1 not in gram and gram in grams:
                diagonals.update((k, j - i) for k, j in grams[gram])
        found: dict[int, list[tuple[int, int]]] = {}
        for k, shift in diagonals:
            item = self.words[k]
            low, high = max(0, -shift), min(len(doc), len(item) - shift)
            if high - low < run:
                continue
            same = [doc[i] == item[i + shift] for i in range(low, high)]
            for a, b in stretches(same, run, replaced):
                found.setdefault(k, []).append((low + a, low + b))
        return found


def stretches(same: list[bool], run: int, replaced: float) -> Iterator[tuple[int, int]]:
    """Longest ranges that begin and end with a match and in which no two neighbours differ."""
    n, at = len(same), 0
    while at < n:
        if not same[at]:
            at += 1
            continue
        last = end = at
        while end < n and (same[end] or (end + 1 < n and same[end + 1])):
            last = end if same[end] else last
            end += 1
        if last + 1 - at >= run:
            differ = [i for i in range(at, last + 1) if not same[i]]
            # A range with too many replacements may hold a part with few.
            yield from _within(at, last + 1, differ, run, replaced)
        at = end + 1


def _within(start: int, stop: int, differ: list[int], run: int, replaced: float) -> Iterator[tuple[int, int]]:
    if stop - start < run:
        return
    if len(differ) <= replaced * (stop - start):
        yield start, stop
        return
    best = None
    edges = [start - 1, *differ, stop]
    for i in range(len(edges)):
        for j in range(len(edges) - 1, i, -1):
            a, b = edges[i] + 1, edges[j]
            if b - a < run or best and b - a <= best[1] - best[0]:
                break
            if j - i - 1 <= replaced * (b - a):
                best = (a, b)
    if best:
        yield best


#: The items that this worker has made, by the broadcast that they came in: a worker runs many tasks.
_made: dict[int, Items] = {}


def _items_of(sent) -> Items:
    known = _made.get(id(sent.value))
    # Broadcast values stay with the worker, so a value at the same place is the same one while its own items are kept.
    if known is None or known.source is not sent.value:
        _made.clear()
        known = _made[id(sent.value)] = Items(sent.value)
    return known


def _blocks(items: DataFrame, item_key: str, item_text: str) -> list[list[tuple[object, str]]]:
    """The items in blocks of at most BLOCK_WORDS words; one empty block if there are none."""
    wanted = items.select(items[item_key], items[item_text]).where(items[item_text].isNotNull()).distinct()
    blocks: list[list[tuple[object, str]]] = [[]]
    size = 0
    for key, text in wanted.toLocalIterator():
        n = len(text.split()) + 1
        if blocks[-1] and size + n > BLOCK_WORDS:
            blocks.append([])
            size = 0
        blocks[-1].append((key, text))
        size += n
    return [sorted(block, key=lambda x: (str(x[0]), x[1])) for block in blocks]


def leaked(
    corpus: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    key_col: str = "doc_id",
    item_key: str = "item_id",
    item_text: str = "text",
    run: int = RUN,
    replaced: float = REPLACED,
) -> DataFrame:
    """One row per document and test item of which it holds a passage.

    Columns: the two keys, the number of words of the longest passage, and the
    passages' word ranges as array<struct<start, stop>>. Passages have at least
    `run` words of the item in a row; case, punctuation and white space do not
    count, single words may be replaced (see Items.runs). Null and empty texts
    on either side, items shorter than `run` words and empty tables give no
    rows; repeated documents give a row each, repeated item rows one between
    them. Other columns are ignored.

    The items are broadcast in blocks of at most BLOCK_WORDS words, so what is
    sent has a fixed bound however many items there are; each block scans the
    corpus once, without a shuffle.
    """
    spark = corpus.sparkSession
    kind, item_kind = corpus.schema[key_col].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"`{key_col}` {kind}, `{item_key}` {item_kind}, words int, passages array<struct<start:int,stop:int>>"
    out_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    source = spread(corpus.select(corpus[key_col], corpus[text_col]).where(corpus[text_col].isNotNull()))

    def scan(block: list[tuple[object, str]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _items_of(sent)
            for batch in batches:
                keys, ids, words, passages = [], [], [], []
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for k, ranges in known.runs(text, run, replaced).items():
                        keys.append(key)
                        ids.append(known.ids[k])
                        words.append(max(b - a for a, b in ranges))
                        passages.append([{"start": a, "stop": b} for a, b in sorted(ranges)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, batch.schema.field(0).type), pa.array(ids, item_type), pa.array(words, pa.int32()), pa.array(passages, out_type)],
                    names=[key_col, item_key, "words", "passages"],
                )

        return source.mapInArrow(run_batches, schema)

    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(items.schema[item_key].dataType)
    blocks = _blocks(items, item_key, item_text)
    return reduce(lambda x, y: x.unionByName(y), map(scan, blocks))


def cleaned(corpus: DataFrame, items: DataFrame, text_col: str = "text", item_key: str = "item_id", item_text: str = "text", run: int = RUN, replaced: float = REPLACED) -> DataFrame:
    """The corpus with the passages of the items cut out of the texts, in the scan that finds them.

    Every document stays, with columns as before; texts without a passage,
    null and empty ones stay as they are. The cut takes the characters from the
    first to the last word of a passage. With several blocks of items the
    blocks cut one after another. There is no shuffle.
    """
    at = corpus.columns.index(text_col)
    out = spread(corpus)
    for block in _blocks(items, item_key, item_text):
        sent = corpus.sparkSession.sparkContext.broadcast(block)

        def run_batches(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = _items_of(sent)
            for batch in batches:
                texts = []
                for text in batch.column(at).to_pylist():
                    ranges = [r for own in known.runs(text, run, replaced).values() for r in own] if text else []
                    texts.append(_cut(text, ranges) if ranges else text)
                yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

        out = out.mapInArrow(run_batches, corpus.schema)
    return out


def _cut(text: str, ranges: list[tuple[int, int]]) -> str:
    spans, count = [], 0
    for m in re.finditer(r"\S+", text):
        n = len(words_of(m.group()))
        spans += [(m.start(), m.end())] * n
        count += n
    out, at = [], 0
    for a, b in sorted(ranges):
        if a < count and b <= count:
            start, stop = spans[a][0], spans[b - 1][1]
            if start > at:
                out.append(text[at:start])
            at = max(at, stop)
    return "".join(out) + text[at:]
