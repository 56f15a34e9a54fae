"""Corpus encoding with a public byte-level BPE vocabulary.

Method: the distinct words of a batch are visited in sorted order, which is the
depth-first order of their trie. Each trie node (a prefix) holds one state, the
last token of the prefix's encoding, so a prefix shared by many words is encoded
once. A state follows from earlier ones: the encoding of a prefix p ends in the
only token t for which p = q + t and the encoding of q may be followed by t,
that is, BPE leaves the last token of q and t apart when they stand alone.
"""

from __future__ import annotations

import base64
import functools
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessel.runtime import spread

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the word pattern published with the vocabulary.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Fixed value: the characters of the Unicode property White_Space, as a class.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

CACHED_PIECES, CACHED_LENGTH = 400_000, 48
NEVER = 1 << 60


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and number."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class TrieEncoder:
    """Encodes words by last-token states over their shared prefixes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = WORD_PATTERN):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        lengths: dict[bytes, set[int]] = {}
        for t in ranks:
            lengths.setdefault(t[-2:], set()).add(len(t))
        #: By its last bytes, how long a token can be, from the longest.
        self.lengths = {e: tuple(sorted(n, reverse=True)) for e, n in lengths.items()}
        # No word reaches over the edge of such a piece, so pieces are split into words one by one and remembered.
        self.pieces = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
        self.find = regex.compile(pattern).findall
        self.pairs: dict[tuple[int, int], bool] = {}
        self.edges: dict[int, tuple | None] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def _edges(self, token: int) -> tuple[list[tuple[bytes, int, int]], list[tuple[bytes, int, int]]] | None:
        """The parts that stand at the token's right and at its left edge while BPE builds it.

        Each with the rank of the merge that makes it and of the merge that ends
        it; None if BPE never builds this token.
        """
        piece = self.bytes_of[token]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        left, right = [(parts[0], -1)], [(parts[-1], -1)]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], NEVER))
            joined = parts[best] + parts[best + 1]
            rank = self.ranks.get(joined, NEVER)
            if rank == NEVER:
                return None
            if best == 0:
                left.append((joined, rank))
            if best == len(parts) - 2:
                right.append((joined, rank))
            parts[best : best + 2] = [joined]

        def spans(edge: list[tuple[bytes, int]]) -> list[tuple[bytes, int, int]]:
            return [(t, r, after) for (t, r), after in zip(edge, [*(r for _, r in edge[1:]), NEVER])]

        return spans(right), spans(left)

    def _apart(self, left: int, right: int) -> bool:
        """Whether BPE leaves these two neighbours apart.

        They grow together if some part at the left one's right edge and some
        part at the right one's left edge exist at the same time and their merge
        comes first. Of equal merges the leftmost comes first.
        """
        known = self.pairs.get((left, right))
        if known is None:
            ranks, known = self.ranks, True
            for a, made_a, ended_a in self.edges[left][0]:
                for b, made_b, ended_b in self.edges[right][1]:
                    rank = ranks.get(a + b)
                    if rank is not None and rank < ended_a and rank <= ended_b and rank >= made_a and rank >= made_b:
                        known = False
            self.pairs[left, right] = known
        return known

    def _reachable(self, token: int) -> bool:
        if token not in self.edges:
            self.edges[token] = self._edges(token)
        return self.edges[token] is not None

    def encode_words(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Token ids of each distinct word, shared prefixes computed once."""
        ranks, lengths = self.ranks, self.lengths
        found: dict[str, tuple[int, ...]] = {}
        before = b""
        states: list[int] = [-1]
        for raw, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            shared, limit = 0, min(len(before), len(raw))
            while shared < limit and before[shared] == raw[shared]:
                shared += 1
            del states[shared + 1 :]
            for end in range(shared + 1, len(raw) + 1):
                for length in (*lengths.get(raw[max(0, end - 2) : end], ()), 1):
                    start = end - length
                    if start < 0:
                        continue
                    token = ranks.get(raw[start:end])
                    if token is not None and self._reachable(token) and (start == 0 or self._apart(states[start], token)):
                        states.append(token)
                        break
            before = raw
            ids, at = [], len(raw)
            while at:
                ids.append(states[at])
                at -= len(self.bytes_of[states[at]])
            found[word] = tuple(reversed(ids))
        return found

    def encode_batch(self, texts: list[str | None]) -> pa.ListArray:
        """One list of ids per text; an empty list for null and empty texts."""
        split = [self.pieces(t) if t else [] for t in texts]
        if len(self.known) > CACHED_PIECES:
            self.known.clear()
        if len(self.words) > CACHED_PIECES:
            self.words.clear()
        known = self.known
        fresh = {p: self.find(p) for p in set().union(*split).difference(known)}
        words = self.words
        words.update(self.encode_words(set().union(*fresh.values()).difference(words)))
        for p, found in fresh.items():
            known[p] = tuple(chain.from_iterable(map(words.__getitem__, found)))
        flat, offsets = array("i"), array("i", [0])
        for doc in split:
            flat.extend(chain.from_iterable(map(known.__getitem__, doc)))
            offsets.append(len(flat))
        for p in fresh:
            if len(p) > CACHED_LENGTH:
                del known[p]
                for w in fresh[p]:
                    if len(w) > CACHED_LENGTH:
                        words.pop(w, None)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


@functools.lru_cache(maxsize=2)
def _encoder(data: bytes, pattern: str) -> TrieEncoder:
    return TrieEncoder(load_ranks(data), pattern)


def encode_corpus(
    df: DataFrame,
    text_col: str = "text",
    key_col: str = "doc_id",
    vocabulary: str = DEFAULT_VOCABULARY,
    pattern: str = WORD_PATTERN,
) -> DataFrame:
    """Rows of (key, ids): the token ids of each text, without special tokens.

    Null and empty texts give an empty list. A repeated or null key gives a row
    each time, an empty table an empty result; strings that look like special
    tokens are ordinary text. Other columns are not read. There is no shuffle:
    tasks share no state, and each keeps a bounded cache of encoded words.
    The vocabulary file (under 1 MB) is read by the driver and broadcast.
    """
    with open(vocabulary, "rb") as f:
        data = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(data.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), encoder.encode_batch(part.column(1).to_pylist())], names=[key_col, "ids"])

    kind = df.schema[key_col].dataType.simpleString()
    return spread(df.select(df[key_col], df[text_col])).mapInArrow(run, f"`{key_col}` {kind}, ids array<int>")
