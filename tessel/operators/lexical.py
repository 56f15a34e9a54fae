"""Lexical retrieval: tokenizers, the inverted index, and BM25.

A strategy gives the index's terms as one Column expression and turns a query
into phrases (lists of terms). Everything else is joins and aggregates over the
postings, for many queries at once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.functions.text import fold, folded_letters
from tessel.operators.sizes import fits_broadcast
from tessel.runtime import materialize, spread

# BM25's parameters, and the weight of terms that most documents have.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6

_fold_table = str.maketrans(*folded_letters())


@dataclass(frozen=True)
class Strategy:
    """A tokenizer with its way of reading queries.

    match is "any" (phrases are alternatives) or "all" (a document must have
    every phrase). index_form names the terms in the index: strategies that
    share it can take turns on the same index.
    """

    name: str
    index_form: str
    match: str = "any"

    def terms(self, c: Column | str) -> Column:
        """The document's terms in order, with repetitions; empty for null."""
        if self.index_form == "unicode61":
            found = F.regexp_extract_all(fold(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
        elif self.index_form == "trigram":
            # A look-ahead at every character; substring() would count from the start each time.
            found = F.regexp_extract_all(F.lower(c), F.lit(r"(?s)(?=(.{3}))."), F.lit(1))
        else:
            # Chinese characters one by one, other letters and numbers in runs.
            found = F.regexp_extract_all(fold(c), F.lit(r"([\x{4e00}-\x{9fff}]|[\p{L}\p{N}&&[^\x{4e00}-\x{9fff}]]+)"), F.lit(1))
        return F.coalesce(found, F.array().cast("array<string>"))

    def phrases(self, query: str) -> list[list[str]]:
        """The query's phrases, repeated ones as often as they occur."""
        if self.index_form == "trigram":
            low = query.lower()
            return [[low[i : i + 3]] for i in range(len(low) - 2)]
        runs = [query] if self.index_form == "han" else re.findall(r"\w+", query)
        out = []
        for run in runs:
            low = run.lower().translate(_fold_table)
            words = re.findall(r"[一-鿿]|[^\W_一-鿿]+", low) if self.index_form == "han" else re.findall(r"[^\W_]+", low)
            out += [[w] for w in words] if self.index_form == "han" else [words] if words else []
        return out


UNICODE61 = Strategy("unicode61", "unicode61")
TRIGRAM = Strategy("trigram", "trigram")
HAN = Strategy("han", "han", "all")
STRATEGIES = {s.name: s for s in (UNICODE61, TRIGRAM, HAN)}


def strategy(name: str) -> Strategy:
    try:
        return STRATEGIES[name]
    except KeyError:
        raise ValueError(f"unknown tokenizer {name!r}; there are {', '.join(STRATEGIES)}") from None


def token_stream(df: DataFrame, text_col: str, key_cols: list[str], how: Strategy = UNICODE61) -> DataFrame:
    """(keys, position 0-based, term): what the index sees."""
    return df.select(*key_cols, F.posexplode(how.terms(df[text_col])).alias("position", "term"))


def distinct_terms(df: DataFrame, text_col: str, key_cols: list[str], how: Strategy = UNICODE61) -> DataFrame:
    """(keys, term, first, times): distinct terms in the order in which they are first seen."""
    return token_stream(df, text_col, key_cols, how).groupBy(*key_cols, "term").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("times"))


@dataclass
class InvertedIndex:
    """postings(term, key, tf, positions) and lengths(key, length); postings that are kept have each key's length too.

    stats(documents, mean) is one row; collection has the same two numbers where
    they are known already.
    """

    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame
    how: Strategy
    collection: tuple[int, float] | None = None
    tokens: DataFrame | None = None


def invert(df: DataFrame, text_col: str = "text", key_col: str = "chunk_id", how: Strategy = UNICODE61, positions: bool = True) -> InvertedIndex:
    """The inverted index of a table with one row per key.

    Rows with null or empty text count as documents of length 0. `positions`
    can be left out where no query has phrases of several terms.
    """
    docs = spread(df.select(df[key_col].alias("key"), df[text_col].alias("text"))).select("key", how.terms(F.col("text")).alias("terms"))
    lengths = docs.select("key", F.size("terms").alias("length"))
    # Ranges of (term, key) are what the groups need and what a kept index is sorted by: one shuffle, and a frequent term is spread over tasks.
    tokens = docs.select("key", F.size("terms").alias("length"), F.posexplode("terms").alias("position", "term"))
    tokens = (tokens if positions else tokens.drop("position")).repartitionByRange("term", "key")
    return InvertedIndex(_postings(tokens), lengths, _stats(lengths), how, tokens=tokens)


def _postings(tokens: DataFrame) -> DataFrame:
    places = [F.sort_array(F.collect_list("position")).alias("positions")] if "position" in tokens.columns else []
    return tokens.groupBy("term", "key", "length").agg(F.count(F.lit(1)).alias("tf"), *places)


def _stats(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count(F.lit(1)).alias("documents"), (F.sum("length").cast("double") / F.count(F.lit(1))).alias("mean"))


def keep(index: InvertedIndex) -> InvertedIndex:
    """The index written to the shared folder, by term, so that a question reads the row groups of its terms.

    What is written are the terms one by one; those asked for are counted when
    they are read, which spares grouping all the others.
    """
    lengths = materialize(index.lengths)
    stats = _stats(lengths)
    row = stats.collect()[0]
    tokens = materialize(index.tokens.sortWithinPartitions("term", "key"))
    return InvertedIndex(_postings(tokens), lengths, stats, index.how, (row["documents"], row["mean"] or 0.0), tokens)


def query_terms(queries: list[tuple[int, str]], how: Strategy) -> list[str]:
    """All terms that the queries ask for."""
    return sorted({w for _, text in queries for words in how.phrases(text) for w in words})


def query_phrases(spark: SparkSession, queries: list[tuple[int, str]], how: Strategy) -> DataFrame:
    """(query_id, phrase, words, times): the queries' phrases; times is how often a query has one."""
    counted: dict[tuple[int, tuple[str, ...]], int] = {}
    for q, text in queries:
        for words in how.phrases(text):
            counted[q, tuple(words)] = counted.get((q, tuple(words)), 0) + 1
    rows = [(q, " ".join(w), list(w), n) for (q, w), n in counted.items()]
    return spark.createDataFrame(rows, "query_id long, phrase string, words array<string>, times int")


#: Up to so many terms are looked for by value, which prunes row groups; more of them by a join.
MOST_LITERALS = 5000


def phrase_matches(index: InvertedIndex, phrases: DataFrame, terms: list[str] | None = None, several: bool = True) -> DataFrame:
    """(phrase, key, length, tf): how often each phrase occurs in each document that has it.

    A phrase's first term fixes where it would begin; for each further term the
    positions are shifted back and intersected. `terms` are all terms asked for,
    where the caller has them; `several` is whether any phrase has more than one.
    """
    wanted = phrases.select("phrase", "words").distinct()
    asked = wanted.select("phrase", F.size("words").alias("n"), F.posexplode("words").alias("at", "term"))
    own = index.postings
    if terms is not None and len(terms) <= MOST_LITERALS:
        own = own.where(F.col("term").isin(terms))
    if "length" not in own.columns:
        own = own.join(index.lengths, "key")
    hit = own.join(fits_broadcast(asked), "term")
    single = hit.where(F.col("n") == 1).select("phrase", "key", "length", F.col("tf").cast("long").alias("tf"))
    if "positions" not in own.columns or not several:
        return single
    parts = hit.where(F.col("n") > 1).select("phrase", "n", "key", "length", "at", F.explode("positions").alias("p")).select("phrase", "n", "key", "length", "at", (F.col("p") - F.col("at")).alias("begin"))
    whole = parts.groupBy("phrase", "key", "length", "begin", "n").agg(F.countDistinct("at").alias("k")).where(F.col("k") == F.col("n"))
    return single.unionByName(whole.groupBy("phrase", "key", "length").agg(F.count(F.lit(1)).alias("tf")))


def bm25(index: InvertedIndex, queries: list[tuple[int, str]], order: str = "relevance") -> DataFrame:
    """(query_id, key, score) of all matching documents.

    order "relevance" gives larger scores to better matches; "reference" gives
    the negated scores, smaller for better ones. Empty documents count toward
    the collection; a phrase that a query repeats counts each time. A blank
    query, or one without terms, has no matches.
    """
    if order not in ("relevance", "reference"):
        raise ValueError(f"order must be relevance or reference, not {order!r}")
    spark = index.postings.sparkSession
    phrases = query_phrases(spark, queries, index.how)
    found = phrase_matches(index, phrases, query_terms(queries, index.how), any(len(w) > 1 for _, text in queries for w in index.how.phrases(text)))
    frequency = found.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    counted = found.join(fits_broadcast(frequency), "phrase")
    if index.collection:
        n, mean = (F.lit(x) for x in index.collection)
    else:
        n, mean = F.col("documents"), F.col("mean")
        counted = counted.crossJoin(F.broadcast(index.stats))
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))
    scored = counted.select("phrase", "key", (F.when(idf > 0, idf).otherwise(LEAST_IDF) * weight).alias("s"))
    both = scored.join(fits_broadcast(phrases.select("query_id", "phrase", "times")), "phrase")
    total = both.groupBy("query_id", "key").agg(F.sum(F.col("s") * F.col("times")).alias("score"), F.count(F.lit(1)).alias("matched"))
    if index.how.match == "all":
        asked = phrases.groupBy("query_id").agg(F.count(F.lit(1)).alias("asked"))
        total = total.join(fits_broadcast(asked), "query_id").where(F.col("matched") == F.col("asked"))
    return total.select("query_id", "key", (F.col("score") if order == "relevance" else -F.col("score")).alias("score"))


def best_of(scores: DataFrame, k: int, by: Column, per: str = "query_id", tie: str = "key") -> DataFrame:
    """The first k rows of each query, with their position; ties by key. k of 0 or less gives none."""
    window = Window.partitionBy(per).orderBy(by, tie)
    return scores.withColumn("position", F.row_number().over(window)).where(F.col("position") <= max(0, k))


def sparse_search(index: InvertedIndex, queries: list[tuple[int, str]], k: int, order: str = "relevance") -> DataFrame:
    """(query_id, key, score, position): the k first matches of each query.

    With order "reference" the k with the largest (weakest) raw scores come
    first, which is how the described engine sorts.
    """
    return best_of(bm25(index, queries, order), k, F.desc("score"))
