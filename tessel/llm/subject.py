"""Subject areas of documents.

Method: one-versus-rest linear classifiers over hashed word n-grams of
sentences. A training sentence has its document's labels as weak labels: hand
labels where there are any, else what the document's folder, source and section
headings say; how much each of these cues says for each subject is estimated
over all hand-labelled documents. Thresholds are calibrated per subject on
held-out documents. A document is on a subject that enough of its sentences
are on.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.operators.sizes import fits_broadcast
from tessel.runtime import bounded_sample, materialize, spread

BITS = 17
SENTENCES = 3
#: Labelled documents that a classifier is fitted on; those with the smallest hash of their key.
FIT_DOCUMENTS = 2500
#: Documents without a hand label that cues label, beside these; no document of more characters is fitted on.
WEAK_DOCUMENTS, FIT_CHARACTERS = 500, 200_000
#: A cue counts if so many labelled documents have it, and for a subject if it is off the usual share by so many standard deviations; its share is drawn to the usual one as if by PRIOR documents.
SUPPORT, DEVIATIONS, PRIOR = 20, 4.0, 20
#: The cues that most labelled documents have, at most.
MOST_CUES = 4096
#: A classifier for more subjects would not fit into a broadcast.
MOST_SUBJECTS = 1000

_sentence = re.compile(r"(?<=[.!?…])[\"”’»)\]]*\s+|(?<=[。！？])|\n+")
_token = re.compile(r"[一-鿿]|[^\W\d_一-鿿]+")


def sentences(text: str) -> list[str]:
    """The sentences and headings of a text."""
    return [s for s in _sentence.split(text) if s and not s.isspace()]


class Features:
    """Hashed uni- and bigrams; words' hashes are remembered up to a bound."""

    def __init__(self, bits: int = BITS):
        self.mask = np.uint64((1 << bits) - 1)
        self.known: dict[str, int] = {}

    def of(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers of all sentences in a row, and where each sentence begins."""
        known = self.known
        if len(known) > 300_000:
            known.clear()
        flat: list[int] = []
        starts = [0]
        for part in parts:
            for w in _token.findall(part.lower()):
                h = known.get(w)
                if h is None:
                    h = known[w] = zlib.crc32(w.encode("utf-8", "replace")) + 1
                flat.append(h)
            flat.append(0)
            starts.append(len(flat))
        one = np.array(flat, np.uint64)
        mixed = (one * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)
        two = ((one[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + one[1:] * np.uint64(0x165667B19E3779F9)) >> np.uint64(24)) if len(one) else one
        both = np.zeros(2 * len(one), np.int64)
        both[0::2] = np.where(one > 0, (mixed & self.mask).astype(np.int64), -1)
        both[1::2] = -1
        if len(one):
            both[1:-1:2] = np.where((one[:-1] > 0) & (one[1:] > 0), (two & self.mask).astype(np.int64), -1)
        return both, np.array(starts, np.int64) * 2


@dataclass
class Subjects:
    """Fitted classifiers: weights[feature, subject], bias and threshold by subject."""

    names: list[str]
    weights: np.ndarray
    bias: np.ndarray
    thresholds: np.ndarray
    bits: int = BITS

    def scores(self, parts: list[str], features: Features) -> np.ndarray:
        numbers, starts = features.of(parts)
        if not parts:
            return np.zeros((0, len(self.names)), np.float32)
        # The last row of the weights is zero, for the ends of sentences.
        return np.add.reduceat(self.weights[numbers], starts[:-1], axis=0) + self.bias


def _fit(rows: np.ndarray, numbers: np.ndarray, targets: np.ndarray, width: int, rounds: int = 60, decay: float = 2e-5) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression of all subjects at once, by Adam over all rows; vectorised over the sparse entries."""
    order = np.argsort(numbers, kind="stable")
    used, begin = np.unique(numbers[order], return_index=True)
    dense = np.searchsorted(used, numbers)
    n, k = targets.shape
    starts = np.searchsorted(rows, np.arange(n))
    rate = np.clip(targets.mean(0), 1e-4, 1 - 1e-4)
    bias = np.log(rate / (1 - rate)).astype(np.float32)
    w = np.zeros((len(used), k), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    by_feature = rows[order]
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-(np.add.reduceat(w[dense], starts, axis=0) + bias)))
        miss = (p - targets).astype(np.float32)
        grad = np.add.reduceat(miss[by_feature], begin, axis=0) / n + decay * w
        bias -= 0.5 * miss.mean(0)
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
    weights = np.zeros((width + 1, k), np.float32)
    weights[used] = w
    return weights, bias


def train(texts: list[str], labels: list[dict[str, float] | set[str]], names: list[str], bits: int = BITS, least: int = SENTENCES, hand: int | None = None) -> Subjects:
    """Classifiers from documents with their subjects (none: on none of them), or how likely each is.

    The first `hand` documents are labelled by hand; only these calibrate thresholds.
    """
    features = Features(bits)
    width = 1 << bits
    parts, owner = [], []
    for d, text in enumerate(texts):
        own = sentences(text)
        parts += own
        owner += [d] * len(own)
    truth = np.array([[own.get(s, 0.0) if isinstance(own, dict) else s in own for s in names] for own in labels], np.float32).reshape(len(texts), len(names))
    if not parts:
        return Subjects(names, np.zeros((width + 1, len(names)), np.float32), np.full(len(names), -9, np.float32), np.full(len(names), 0.0, np.float32), bits)
    doc = np.array(owner)
    numbers, starts = features.of(parts)
    rows = np.repeat(np.arange(len(parts)), np.diff(starts))
    keep = numbers >= 0
    rows, numbers = rows[keep], numbers[keep]
    # Features seen in a single document tell nothing.
    seen = np.unique(numbers * len(texts) + doc[rows]) // len(texts)
    often = np.bincount(seen, minlength=width) > 1
    keep = often[numbers]
    rows, numbers = rows[keep], numbers[keep]
    empty = np.setdiff1d(np.arange(len(parts)), rows)
    rows, numbers = np.concatenate([rows, empty]), np.concatenate([numbers, np.full(len(empty), width)])
    order = np.argsort(rows, kind="stable")
    rows, numbers = rows[order], numbers[order]

    held = (np.arange(len(texts)) % 5 == 4) & (np.arange(len(texts)) < (len(texts) if hand is None else hand))
    if held.all() or not held.any():
        held[:] = False
    learn = ~held[doc]

    def fit(targets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        number = np.cumsum(which) - 1
        inside = which[rows]
        w, b = _fit(number[rows[inside]], numbers[inside], targets[which], width)
        w[width] = 0
        return w, b

    targets = truth[doc]
    everything = np.ones(len(parts), bool)

    def score(w: np.ndarray, b: np.ndarray) -> np.ndarray:
        begin = np.searchsorted(rows, np.arange(len(parts)))
        return np.add.reduceat(w[numbers], begin, axis=0) + b

    # Not every sentence of a labelled document is on its subject: keep the label where the first fit agrees.
    first = score(*fit(targets, learn))
    sharp = targets * (first > np.log(0.35 / 0.65))
    second = score(*fit(sharp, learn))
    thresholds = np.zeros(len(names), np.float32)
    if held.any():
        at = doc[held[doc]]
        tried = np.arange(-1.5, 2.01, 0.25)
        for s in range(len(names)):
            quality = []
            for cut in tried:
                on = np.bincount(at, second[held[doc], s] > cut, minlength=len(texts))[held] >= least
                right = (on & (truth[held, s] > 0)).sum()
                quality.append(2 * right / max(1, on.sum() + truth[held, s].sum()))
            # Many thresholds do about equally well; their middle is the steadiest.
            thresholds[s] = np.median(tried[np.array(quality) >= max(quality) - 0.01])
    weights, bias = fit(targets * (score(*fit(targets, everything)) > np.log(0.35 / 0.65)), everything)
    return Subjects(names, weights, bias, thresholds, bits)


def _names(subjects: DataFrame) -> dict[str, str]:
    """Subjects by their plain form, as they are written."""
    rows = subjects.select("subject").where(F.col("subject").isNotNull()).distinct().limit(MOST_SUBJECTS + 1).collect()
    if len(rows) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects")
    return {r[0].strip().lower(): r[0] for r in sorted(rows, reverse=True)}


def cues(documents: DataFrame, text_col: str, path_col: str | None, source_col: str | None) -> Column:
    """What may tell a document's subject beside its sentences: folder and source without their numbers, and the words of its headings."""

    def step(name: str | None, mark: str) -> Column:
        if name is None or name not in documents.columns:
            return F.array().cast("array<string>")
        plain = F.regexp_replace(F.element_at(F.split(documents[name], "/"), 1), r"[-\d]+$", "")
        return F.when(F.length(plain) > 0, F.array(F.concat(F.lit(mark), plain))).otherwise(F.array().cast("array<string>"))

    lines = F.regexp_extract_all(documents[text_col], F.lit(r"(?m)^([^\n.!?…:;,]{1,60})$"), F.lit(1))
    words = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(F.lower(x), F.lit(r"([\p{L}]{3,})"), F.lit(1))))
    return F.array_distinct(F.concat(step(path_col, "path:"), step(source_col, "source:"), F.transform(words, lambda w: F.concat(F.lit("head:"), w))))


def telling(pairs: list[tuple[str, str, int, int]], usual: dict[str, float]) -> dict[str, dict[str, float]]:
    """What each cue adds to the log-odds of each subject, from (cue, subject, documents with both, documents with the cue)."""
    out: dict[str, dict[str, float]] = {}
    odds = lambda p: np.log(p / (1 - p))
    counted = {(c, s): n for c, s, n, _ in pairs}
    for cue, total in {(c, n) for c, _, _, n in pairs}:
        for subject, share in usual.items():
            share = min(max(share, 1e-3), 1 - 1e-3)
            n = counted.get((cue, subject), 0)
            if abs(n - total * share) > DEVIATIONS * np.sqrt(total * share * (1 - share)):
                out.setdefault(cue, {})[subject] = float(odds((n + PRIOR * share) / (total + PRIOR)) - odds(share))
    return out


def fit_subjects(
    documents: DataFrame,
    labels: DataFrame,
    subjects: DataFrame,
    text_col: str = "text",
    key_col: str = "doc_id",
    path_col: str | None = "path",
    source_col: str | None = "source",
    fit_documents: int = FIT_DOCUMENTS,
    weak_documents: int = WEAK_DOCUMENTS,
) -> Subjects:
    """Classifiers fitted on at most `fit_documents` hand-labelled documents and `weak_documents` that cues label.

    Labels are compared without case and outer white space; unknown ones are
    ignored, a null one says that the reader saw no subject. Cues are judged
    over all hand-labelled documents at every size (see telling); a document
    with a telling one gets each subject's odds as its weak label. Samples are
    drawn by key, so no text is shuffled. Each subject is fitted in a task of
    its own.
    """
    spark = documents.sparkSession
    names = sorted(_names(subjects))
    clean = F.lower(F.trim("subject"))
    known = labels.select(F.col(key_col).alias("_k"), clean.alias("_s")).where(F.col("_s").isNull() | F.col("_s").isin(names))
    known = materialize(known.where(F.col("_k").isNotNull()).groupBy("_k").agg(F.collect_set("_s").alias("_labels")))
    length = F.char_length(documents[text_col])
    docs = documents.where(length > 0).select(documents[key_col].alias("_k"), cues(documents, text_col, path_col, source_col).alias("_cues"), (length <= FIT_CHARACTERS).alias("_fits"))
    hand = materialize(docs.join(fits_broadcast(known), "_k"))

    def texts_of(keys: DataFrame) -> DataFrame:
        whole = documents.where((length > 0) & (length <= FIT_CHARACTERS)).select(documents[key_col].alias("_k"), documents[text_col].alias("_t"))
        return whole.join(F.broadcast(keys.distinct()), "_k")

    able = hand.where("_fits").select("_k", "_labels")
    chosen = bounded_sample(able, "_k", fit_documents)
    sample = sorted(texts_of(chosen).collect(), key=lambda r: str(r["_k"]))
    texts, sets = [r["_t"] for r in sample], [dict.fromkeys(r["_labels"], 1.0) for r in sample]

    # Counted over all hand-labelled documents.
    total = max(1, hand.count())
    counts = {r["_s"]: r["n"] for r in hand.select(F.explode("_labels").alias("_s")).groupBy("_s").agg(F.count(F.lit(1)).alias("n")).collect()}
    usual = {s: counts.get(s, 0) / total for s in names}
    support = hand.select(F.explode("_cues").alias("_c")).groupBy("_c").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") >= SUPPORT).orderBy(F.desc("total"), "_c").limit(MOST_CUES)
    both = hand.select("_labels", F.explode("_cues").alias("_c")).join(F.broadcast(support), "_c").select("_c", "total", F.explode_outer("_labels").alias("_s")).groupBy("_c", "_s").agg(F.count(F.lit(1)).alias("n"), F.first("total").alias("total"))
    told = telling([(r["_c"], r["_s"], r["n"], r["total"]) for r in both.collect()], usual)
    hinted = docs.where("_fits").where(F.arrays_overlap("_cues", F.array(*[F.lit(c) for c in told]) if told else F.array().cast("array<string>"))).join(fits_broadcast(known.select("_k")), "_k", "left_anti")
    weak = bounded_sample(hinted, "_k", weak_documents) if told else hinted.limit(0)
    for r in sorted(texts_of(weak).collect(), key=lambda r: str(r["_k"])) if told else ():
        texts.append(r["_t"])
        odds = {s: np.log(max(usual[s], 1e-3) / (1 - min(usual[s], 1 - 1e-3))) + sum(told[c].get(s, 0.0) for c in r["_cues"] if c in told) for s in names}
        sets.append({s: float(1 / (1 + np.exp(-x))) for s, x in odds.items()})
    return _fitted(spark, texts, sets, names, len(sample))


def _fitted(spark: SparkSession, texts: list[str], sets: list[dict[str, float]], names: list[str], hand: int) -> Subjects:
    """train(), with a task for each subject; what is sent to the tasks is the bounded sample."""
    if not names:
        return train(texts, sets, names)
    sent = spark.sparkContext.broadcast((texts, sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                own = train(*sent.value, [names[k]], hand=hand)
                used = np.flatnonzero(own.weights[:, 0]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k]), pa.array([used.tobytes()], pa.binary()), pa.array([own.weights[used, 0].tobytes()], pa.binary()), pa.array([float(own.bias[0])]), pa.array([float(own.thresholds[0])])], names=["k", "used", "w", "b", "t"]
                )

    out = Subjects(names, np.zeros(((1 << BITS) + 1, len(names)), np.float32), np.zeros(len(names), np.float32), np.zeros(len(names), np.float32))
    for r in spark.range(0, len(names), 1, len(names)).mapInArrow(run, "k long, used binary, w binary, b double, t double").collect():
        out.weights[np.frombuffer(r["used"], np.int32), r["k"]] = np.frombuffer(r["w"], np.float32)
        out.bias[r["k"]], out.thresholds[r["k"]] = r["b"], r["t"]
    sent.unpersist()
    return out


def assign_subjects(documents: DataFrame, model: Subjects, subjects: DataFrame | None = None, text_col: str = "text", key_col: str = "doc_id", least: int = SENTENCES) -> DataFrame:
    """One row per document and subject that at least `least` of its sentences are on.

    Columns: key, subject, sentences int. Null, empty and wordless texts get no
    row; repeated documents a row each. Subjects are written as in `subjects`
    if given. Whole texts are read; there is no shuffle. The model (a fixed
    2^17 rows of weights) is broadcast.
    """
    spelling = _names(subjects) if subjects is not None else {}
    sent = documents.sparkSession.sparkContext.broadcast(model)
    shown = [spelling.get(s, s) for s in model.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, features = sent.value, Features(sent.value.bits)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                parts: list[str] = []
                owner: list[int] = []
                for i, text in enumerate(part.column(1).to_pylist()):
                    own = sentences(text)
                    parts += own
                    owner += [i] * len(own)
                on = fitted.scores(parts, features) > fitted.thresholds
                counts = np.zeros((part.num_rows, len(shown)), np.int32)
                np.add.at(counts, np.array(owner, np.int64), on)
                rows, which = np.nonzero(counts >= least)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows)), pa.array([shown[s] for s in which], pa.string()), pa.array(counts[rows, which], pa.int32())],
                    names=[key_col, "subject", "sentences"],
                )

    kind = documents.schema[key_col].dataType.simpleString()
    return spread(documents.select(documents[key_col], documents[text_col]).where(F.char_length(documents[text_col]) > 0)).mapInArrow(run, f"`{key_col}` {kind}, subject string, sentences int")
