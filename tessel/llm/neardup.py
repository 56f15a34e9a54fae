"""Near-duplicate texts by a parity-sketch join.

Two texts of n and m words (counted with repetition) share at least the part t
of the longer one exactly if the symmetric difference of their word bags is at
most n + m - 2 t max(n, m). A parity sketch XORs the words' hashes into the bits
or the segments of a sketch; words that both texts have cancel out, so the
Hamming distance of two sketches never exceeds the symmetric difference.

* Candidates: words are dealt onto a circle by their hashes; from each of a few
  evenly spaced marks, the XOR of the words that follow, as many as together
  tell enough to be rare, is a segment's parity, on which sketches are joined.
  How many marks the text's size band has, and on how many circles, follows the
  chance MISS that a pair at the threshold may have to agree in no segment; how
  many words a segment has follows the number of texts. Short texts are joined
  on what remains after every deletion that the threshold allows.
* Filter: the Hamming distance of 512-bit parity sketches.
* Verification: the exact word bags.

Words that many texts have make segments alike by chance, so they are on a
circle the more rarely the less they tell; what a word tells is measured over
all texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.operators.sizes import fits_broadcast
from tessel.runtime import materialize, spread

THRESHOLD = 0.75
#: The chance that a pair at the threshold is missed, where its texts differ in words taken evenly from them, and what the number of segments is raised by, because the words on a circle are not quite evenly taken.
MISS, MARGIN = 0.01, 1.25
#: A circle has one mark for so many words, rounded down to a power of two, and at most MOST_MARKS; a text is on at most MOST_CIRCLES.
WORDS_A_MARK, MOST_MARKS, MOST_CIRCLES = 8, 16, 256
#: A segment never has more words than this; where these tell too little, there are more candidates, not fewer pairs.
SEGMENT_WORDS = 8
#: A pair whose shorter text has at most so many words is found for certain.
SHORT = 7
#: A word that tells FULL bits or more is on every circle, others with the square of their share. Texts with less than PLENTY times what a segment needs on such a circle are also dealt whole, those with less than half of that only so.
FULL, PLENTY = 8.0, 5
#: Words in fewer than 2^-RARE of the texts count as if in that many; words in no more texts than FEW_TEXTS tell FULL bits at least, any word LEAST_BITS.
RARE, FEW_TEXTS, LEAST_BITS = 12.0, 64, 0.5
#: A segment has enough words if fewer than 2^-SLACK texts are expected to have an equal one by chance.
SLACK = 1.0
#: A key that more than so many texts are expected to share is joined in blocks.
HOT = 2000
#: One text in so many is looked at to find such keys.
SAMPLED = 64
#: The table of word frequencies that is broadcast never has more rows than this; by definition it has at most 2^RARE for each word of a mean text. What it has no room for are the rarest.
FREQUENT_WORDS = 1 << 20
PARITY_BITS = 512
PARITY = [f"s{k}" for k in range(PARITY_BITS // 64)]

_edge = re.compile(r"^[\W_]+|[\W_]+$")
_U = np.uint64
_GOLD, _MIX = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


def words_of(text: str | None) -> list[str]:
    """The pieces between white space, lower-cased, without outer characters that are neither letters nor digits."""
    return [w for w in (_edge.sub("", p) for p in (text or "").lower().split()) if w]


class _Words:
    """Hashes of pieces, remembered up to a bound; 0 stands for a piece without letters and digits."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, text: str) -> list[int]:
        known, out = self.known, []
        if len(known) > 500_000:
            known.clear()
        for p in text.lower().split():
            h = known.get(p)
            if h is None:
                w = _edge.sub("", p)
                h = xxhash.xxh3_64_intdigest(w) | 1 if w else 0
                if len(p) < 64:
                    known[p] = h
            if h:
                out.append(h)
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _MIX
    return x ^ (x >> _U(29))


def _bag_keys(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums for each text that do not depend on the order of its words."""
    if not len(flat):
        zero = np.zeros(len(starts) - 1, np.int64)
        return zero, zero
    empty = starts[:-1] == starts[1:]
    at = np.minimum(starts[:-1], len(flat) - 1)
    out = []
    for values in (flat * _GOLD, _mixed(flat)):
        total = np.add.reduceat(values, at)
        total[empty] = 0
        out.append(total.view(np.int64))
    return out[0], out[1]


def _flat(texts: list[str | None], words: _Words) -> tuple[np.ndarray, np.ndarray]:
    flat, starts = [], [0]
    for t in texts:
        if t:
            flat += words.of(t)
        starts.append(len(flat))
    return np.array(flat, np.uint64), np.array(starts, np.int64)


def band_of(n: int | np.ndarray) -> np.ndarray:
    """The size band of a word count: its binary logarithm, rounded down."""
    return np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)


def _counts(texts: DataFrame) -> DataFrame:
    """(kind, word, n): in how many texts a word is, how many texts a band has (word: band), all words.

    Texts with equal word bags count once for each task, so a group of copies
    does not make its words look common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = _Words(), set()
        totals: Counter = Counter()
        found = np.zeros(0, np.uint64)
        number = np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                flat, starts = _flat(batch.slice(at, 1000).column(0).to_pylist(), words)
                n = np.diff(starts)
                a, b = _bag_keys(flat, starts)
                fresh = np.zeros(len(n), bool)
                for i, key in enumerate(zip(a.tolist(), b.tolist())):
                    if n[i] and key not in seen:
                        seen.add(key)
                        fresh[i] = True
                for band, k in zip(*np.unique(band_of(n[fresh]), return_counts=True)):
                    totals["band", int(band)] += int(k)
                totals["words", 0] += int(n[fresh].sum())
                owner = np.repeat(np.arange(len(n)), n)
                keep = fresh[owner]
                order = np.lexsort((flat[keep], owner[keep]))
                w, o = flat[keep][order], owner[keep][order]
                first = np.ones(len(w), bool)
                first[1:] = (w[1:] != w[:-1]) | (o[1:] != o[:-1])
                new, k = np.unique(w[first], return_counts=True)
                found, inverse = np.unique(np.concatenate([found, new]), return_inverse=True)
                number = np.bincount(inverse, np.concatenate([number, k]), len(found)).astype(np.int64)
        rows = [("word", found.view(np.int64), number)]
        for (kind, w), k in totals.items():
            rows.append((kind, np.array([w]), np.array([k])))
        for kind, w, k in rows:
            for at in range(0, len(w), 50_000):
                part = w[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(part)), pa.array(part, pa.int64()), pa.array(k[at : at + 50_000], pa.int64())], names=["kind", "word", "n"])

    return texts.mapInArrow(run, "kind string, word long, n long").groupBy("kind", "word").agg(F.sum("n").alias("n"))


class Plan:
    """What words tell, and the bits that a segment must hold."""

    def __init__(self, counts: list[tuple[str, int, int]], threshold: float = THRESHOLD):
        self.threshold = threshold
        texts = max(1, sum(n for kind, _, n in counts if kind == "band"))
        frequent = sorted((w, n) for kind, w, n in counts if kind == "word")
        words, n = np.array([w for w, _ in frequent], np.int64).view(np.uint64), np.array([n for _, n in frequent], float)
        bits = np.clip(-np.log2(np.maximum(1, n) / texts), LEAST_BITS, RARE)
        bits = np.where(n <= FEW_TEXTS, np.maximum(bits, FULL), bits).astype(np.float32)
        order = np.argsort(words)
        self.words, self.bits = words[order], bits[order]
        self.need = math.log2(max(2, texts)) + SLACK

    def information(self, flat: np.ndarray) -> np.ndarray:
        """Bits that each word tells."""
        if not len(self.words):
            return np.full(len(flat), RARE, np.float32)
        at = np.minimum(np.searchsorted(self.words, flat), len(self.words) - 1)
        return np.where(self.words[at] == flat, self.bits[at], np.float32(RARE))


def _numbered(flat: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bags as sets: the k-th time that a text has a word gets a hash of its own. With the words and their texts, sorted."""
    order = np.lexsort((flat, owner))
    w, o = flat[order], owner[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (o[1:] != o[:-1])
    at = np.arange(len(w))
    times = at - np.maximum.accumulate(np.where(new, at, 0))
    return _mixed(w + times.astype(np.uint64) * _GOLD), w, o


def segments_needed(words: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """How many segments of so many words a text needs, to miss a pair at the threshold with a chance of MISS.

    Two texts of n words that share t n of them have (2 - t) n in all; a segment
    is the same in both if its words, taken evenly from these, are shared ones.
    """
    same = (threshold / (2 - threshold)) ** np.maximum(words, 1)
    return np.ceil(MARGIN * math.log(MISS) / np.log1p(-same)).astype(np.int64)


def _segments(tokens: np.ndarray, value: np.ndarray, owner: np.ndarray, info: np.ndarray, often: np.ndarray, n: np.ndarray, plan: Plan) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Parities of the segments, and the texts that they belong to. often: how often each word is on a circle, as a share of 2^32."""
    texts = len(n)
    if texts > 1 << 14:
        raise ValueError("at most 16,384 texts at a time")
    keys: list[np.ndarray] = []
    texts_of: list[np.ndarray] = []
    marks = np.minimum(1 << band_of(np.maximum(n // WORDS_A_MARK, 1)), MOST_MARKS)
    # The shorter text of a pair may have half as many marks; then it is on circles that the longer one needs too.
    lower = (marks > 1) & (plan.threshold * n < marks * WORDS_A_MARK)
    circles = np.full(texts, 1)
    steps = np.arange(SEGMENT_WORDS)
    for circle in range(MOST_CIRCLES):
        seed = np.uint64((circle + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        own = circle < np.where(lower, 2 * circles, circles)
        if not own.any():
            break
        place = _mixed(tokens + seed)
        on = np.flatnonzero(((place & _U(0xFFFFFFFF)) < often) & own[owner])
        if not len(on):
            continue
        at = (owner[on].astype(np.uint64) << _U(50)) | (place[on] >> _U(14))
        order = np.argsort(at)
        at, on = at[order], on[order]
        held = np.bincount(owner[on], minlength=texts)
        begin = np.concatenate([[0], np.cumsum(held)[:-1]])
        here = np.where(circle < circles, marks, marks // 2) * (own & (held > 0))
        who = np.repeat(np.arange(texts), here)
        mark = np.arange(len(who)) - np.repeat(np.cumsum(here) - here, here)
        spot = (who.astype(np.uint64) << _U(50)) + (mark.astype(np.uint64) << _U(50)) // here[who].astype(np.uint64)
        first = np.searchsorted(at, spot) - begin[who]
        there = steps < held[who][:, None]
        row = on[begin[who][:, None] + (first[:, None] + steps) % held[who][:, None]]
        told = np.where(there, info[row], 0)
        # A segment ends with the word that makes it rare enough.
        before = np.cumsum(told, 1) - told
        taken = there & (before < plan.need)
        keys.append(_mixed(np.bitwise_xor.reduce(np.where(taken, value[row], _U(0)), axis=1)))
        texts_of.append(who)
        if not circle:
            length = np.bincount(who, taken.sum(1), texts) / np.maximum(here, 1)
            circles = np.ceil(segments_needed(length, plan.threshold) / marks).astype(np.int64)
    return keys, texts_of


def _remainders(values: np.ndarray, threshold: float) -> np.ndarray:
    """Keys of a short text: what is left of it after each deletion of as many words as the threshold allows, or fewer."""
    whole = int(np.bitwise_xor.reduce(values))
    allowed = len(values) - math.ceil(threshold * len(values))
    gone = [0]
    for k in range(1, allowed + 1):
        gone += [int(np.bitwise_xor.reduce(np.array(c))) for c in combinations(values, k)]
    return _mixed(np.array([whole ^ g for g in gone], np.uint64) + _MIX)


def sketch(flat: np.ndarray, starts: np.ndarray, plan: Plan) -> tuple[np.ndarray, list[np.ndarray]]:
    """Parity sketches, and each text's join keys."""
    n = np.diff(starts)
    texts = len(n)
    owner = np.repeat(np.arange(texts), n)
    tokens, plain, owner = _numbered(flat, owner)
    parity = np.zeros((texts, PARITY_BITS // 64), np.uint64)
    bit = tokens % _U(PARITY_BITS)
    np.bitwise_xor.at(parity, (owner, (bit >> _U(6)).astype(np.int64)), _U(1) << (bit & _U(63)))

    info = plan.information(plain)
    value = _mixed(tokens + _GOLD)
    share = np.minimum(1, (info / FULL) ** 2)
    held = np.bincount(owner, info * share, texts) / plan.need
    part = np.flatnonzero(((n > SHORT) & (held >= PLENTY / 2))[owner])
    whole = np.flatnonzero(((n > SHORT) & (held < PLENTY))[owner])
    keys, texts_of = _segments(tokens[part], value[part], owner[part], info[part], (share[part] * 0xFFFFFFFF).astype(np.uint64), n, plan)
    more, owners = _segments(tokens[whole] + _MIX, value[whole], owner[whole], info[whole], np.full(len(whole), 1 << 32, np.uint64), n, plan)
    keys, texts_of = keys + more, texts_of + owners
    begin = np.concatenate([[0], np.cumsum(n)])
    for k in np.flatnonzero((n > 0) & (n * plan.threshold <= SHORT)):
        own = _remainders(value[begin[k] : begin[k + 1]], plan.threshold)
        keys.append(own)
        texts_of.append(np.full(len(own), k))
    if not keys:
        return parity, [np.zeros(0, np.int64)] * texts
    owner, key = np.concatenate(texts_of), np.concatenate(keys).view(np.int64)
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    owner, key = owner[new], key[new]
    return parity, np.split(key, np.cumsum(np.bincount(owner, minlength=texts))[:-1])


def _sketches(texts: DataFrame, plan: Plan) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(plan)
    names = ["id", "n", "k1", "k2", *PARITY, "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                flat, starts = _flat(part.column(1).to_pylist(), words)
                n = np.diff(starts)
                a, b = _bag_keys(flat, starts)
                parity, keys = sketch(flat, starts, sent.value)
                offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64), pa.int64()))
                arrays = [part.column(0), pa.array(n.astype(np.int32)), pa.array(a), pa.array(b), *(pa.array(np.ascontiguousarray(parity[:, k]).view(np.int64)) for k in range(len(PARITY))), listed]
                yield pa.RecordBatch.from_arrays(arrays, names=names).filter(pa.array(n > 0))

    kind = texts.schema["id"].dataType.simpleString()
    parity = ", ".join(f"{s} long" for s in PARITY)
    return texts.mapInArrow(run, f"id {kind}, n int, k1 long, k2 long, {parity}, keys array<long>")


def _overlaps(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs with two texts, those kept whose word bags overlap enough."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            kept, alike = [], []
            bags: dict[str, dict[int, int]] = {}
            for i, (a, b) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                x, y = (bags.get(t) or bags.setdefault(t, Counter(words.of(t))) for t in (a, b))
                longer = max(x.total(), y.total())
                shared = sum(min(n, y[w]) for w, n in x.items() if w in y)
                if shared >= threshold * longer:
                    kept.append(i)
                    alike.append(shared / longer)
            take = pa.array(kept, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(alike, pa.float64())], names=["a", "b", "similarity"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}, similarity double")


def _candidates(reps: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: pairs with a common key whose sizes allow the threshold."""
    keyed = reps.select(F.explode("keys").alias("key"), "id", "n")
    # The sample is by text, so its share of a key's texts is near SAMPLED whatever the key.
    some = reps.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(SAMPLED)) == 0).select(F.explode("keys").alias("key"))
    hot = materialize(some.groupBy("key").agg((F.count(F.lit(1)) * SAMPLED).alias("size")).where(F.col("size") > HOT))
    a, b = keyed.alias("a"), keyed.alias("b")
    close = (F.col("a.id") < F.col("b.id")) & (F.least("a.n", "b.n") >= F.lit(threshold) * F.greatest("a.n", "b.n"))
    if hot.isEmpty():
        return a.join(b, (F.col("a.key") == F.col("b.key")) & close).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    blocks = keyed.join(fits_broadcast(hot), "key", "left").withColumn("blocks", F.ceil(F.coalesce("size", F.lit(1)) / HOT).cast("int"))
    one = blocks.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).select("key", "block", "id", "n").alias("a")
    every = blocks.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "n").alias("b")
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.block") == F.col("b.block"))
    return one.join(every, same & close).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def near_duplicates(df: DataFrame, text_col: str = "text", key_col: str = "chunk_id", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(links, members): the similar pairs of class representatives, and each text's class.

    links: a, b (a < b), similarity, for representatives of different word bags
    that share at least `threshold` of the longer one's words. members: id, rep,
    where rep is the smallest key with the same word bag. Null, empty and
    wordless texts take no part; rows that repeat a key count as one text each,
    linked under that key; an empty table gives empty results; other columns
    are ignored. Texts are read whole.

    Copies are collapsed before the join, so a group of copies of any size adds
    one text to it. What is sent to all tasks is the plan, with at most
    FREQUENT_WORDS words. A pair at the threshold is missed with a chance of about
    MISS at every number of texts if its texts differ in words taken evenly from
    them, a closer pair more rarely; pairs with a text of at most SHORT words are
    found for certain. Where all differing words are rare ones the chance is higher.
    Keys that a sample of the texts shows to be shared by more than HOT are
    joined in blocks, each text of the one side with all of the other, so no
    task takes the square of such a group.
    """
    spark = df.sparkSession
    texts = df.select(df[key_col].alias("id"), df[text_col].alias("text")).where(F.col("id").isNotNull() & (F.char_length("text") > 0))
    least = max(2, int(texts.count() * 2.0**-RARE))
    texts = spread(texts)
    counts = _counts(texts.select("text")).where((F.col("kind") != "word") | (F.col("n") >= least))
    counts = counts.orderBy(F.col("kind") == "word", F.desc("n"), "word").limit(FREQUENT_WORDS + 100)
    plan = Plan([(r["kind"], r["word"], r["n"]) for r in counts.toLocalIterator()], threshold)

    sketches = materialize(_sketches(texts, plan))
    bags = sketches.groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"))
    copied = sketches.select("id", "k1", "k2", "n").join(bags.where(F.col("size") > 1), ["k1", "k2", "n"]).select("id", "rep")
    others = materialize(copied.where(F.col("id") != F.col("rep")).distinct())
    members = sketches.select("id").distinct().join(others, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))

    reps = sketches.join(fits_broadcast(others.select("id")), "id", "left_anti")
    candidates = _candidates(reps, threshold)

    # Folded sketches never differ in more bits than whole ones; a quarter as wide, they spare most candidates the wide joins.
    folded = {f"f{k}": reduce(lambda x, y: x.bitwiseXOR(y), (F.col(s) for s in PARITY[k::2])) for k in range(2)}
    bound = F.col("n_a") + F.col("n_b") - 2 * F.ceil(F.lit(threshold) * F.greatest("n_a", "n_b"))

    def side(name: str, parts: dict[str, Column]) -> DataFrame:
        return reps.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), *(c.alias(f"{s}_{name}") for s, c in parts.items()))

    def passing(pairs: DataFrame, parts: dict[str, Column]) -> DataFrame:
        apart: Column = sum((F.bit_count(F.col(f"{s}_a").bitwiseXOR(F.col(f"{s}_b"))) for s in parts), F.lit(0))
        return pairs.join(side("a", parts), "a").join(side("b", parts), "b").where(apart <= bound).select("a", "b")

    likely = materialize(passing(passing(candidates, folded), {s: F.col(s) for s in PARITY}))

    ids = likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id"))).distinct()
    wanted = texts.join(ids, "id", "left_semi")
    both = likely.join(wanted.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(wanted.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return _overlaps(both, threshold), members


def all_pairs(links: DataFrame, members: DataFrame, key_col: str = "chunk_id") -> DataFrame:
    """Every pair of similar texts, copies included, the smaller key first."""
    a, b = members.select(F.col("id").alias("x"), F.col("rep").alias("a")), members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    across = links.select("a", "b").distinct().join(a, "a").join(b, "b").select(F.least("x", "y").alias("l"), F.greatest("x", "y").alias("r"))
    same = a.join(b, (F.col("a") == F.col("b")) & (F.col("x") < F.col("y"))).select(F.col("x").alias("l"), F.col("y").alias("r"))
    return across.unionByName(same).distinct().select(F.col("l").alias(f"{key_col}_a"), F.col("r").alias(f"{key_col}_b"))


def classes(links: DataFrame, members: DataFrame, key_col: str = "chunk_id", rounds: int = 100) -> DataFrame:
    """One row per text: its key, class_id (the smallest key that links lead to) and links (of its representative).

    Labels spread over the links, each round taking the smallest label around
    and then that label's own label, until nothing changes. Each round's labels
    are written to the shared folder; only texts with links take part.
    """
    edges = materialize(links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct())
    labels = edges.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("label"))
    labels = materialize(labels)
    for _ in range(rounds):
        around = edges.join(labels.select(F.col("x").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("near"))
        stepped = labels.join(around, "x").select("x", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        root = labels.select(F.col("x").alias("label"), F.col("label").alias("root"))
        jumped = materialize(stepped.join(root, "label", "left").select("x", "old", F.least("label", F.coalesce("root", "label")).alias("label")))
        changed = jumped.where(F.col("old") != F.col("label")).limit(1).count()
        labels = jumped.select("x", "label")
        if not changed:
            break
    else:
        raise RuntimeError(f"classes still change after {rounds} rounds")
    degree = edges.groupBy("x").agg(F.count(F.lit(1)).alias("links"))
    out = members.join(labels.join(degree, "x"), F.col("rep") == F.col("x"), "left")
    return out.select(F.col("id").alias(key_col), F.coalesce("label", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
