"""Retrieval quality: recall, precision and reciprocal rank at k, by class of query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def query_metrics(retrieved: DataFrame, relevant: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """One row per asked query from retrieved(query_id, key, position), relevant(query_id, key) and asked(query_id, bucket).

    recall: share of the relevant keys within the first k; precision: relevant
    ones among the first k, over k; mrr: 1 over the first relevant position, 0
    without one; zero_hit: nothing was retrieved. A query without relevant keys
    has recall 0.
    """
    top = retrieved.where(F.col("position") <= k)
    hits = top.join(relevant.distinct(), ["query_id", "key"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.min("position").alias("first"))
    wanted = relevant.distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"))
    any_ = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("got"))
    rows = asked.join(hits, "query_id", "left").join(wanted, "query_id", "left").join(any_, "query_id", "left")
    h = F.coalesce("hits", F.lit(0))
    return rows.select(
        "query_id",
        "bucket",
        F.when(F.col("wanted") > 0, h / F.col("wanted")).otherwise(0.0).alias("recall"),
        (h / F.lit(k)).alias("precision"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.col("got").isNull().cast("double").alias("zero_hit"),
    )


def by_bucket(metrics: DataFrame) -> DataFrame:
    """Averages by bucket, and over all queries as bucket "all"."""
    names = ("recall", "precision", "mrr", "zero_hit")
    rolled = metrics.rollup("bucket").agg(F.grouping("bucket").alias("g"), F.count(F.lit(1)).alias("queries"), *(F.avg(n).alias(n) for n in names))
    return rolled.select(F.when(F.col("g") == 1, "all").otherwise(F.col("bucket")).alias("bucket"), "queries", *names)


def probes(labeled: DataFrame, lengths: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(probe, keys): all substrings of the given lengths of labeled(text, key) query texts, with the keys of their queries.

    Substrings with white space are left out; a probe of several queries has
    all their keys, sorted.
    """
    text = F.col("text")

    def grams(n: int):
        begins = F.sequence(F.lit(1), F.char_length(text) - n + 1)
        return F.when(F.char_length(text) >= n, F.transform(begins, lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    rows = labeled.select("key", F.explode(F.array_distinct(F.flatten(F.array(*map(grams, lengths))))).alias("probe")).where(~F.col("probe").rlike(r"(?U)\s"))
    return rows.groupBy("probe").agg(F.sort_array(F.collect_set("key")).alias("keys"))
