"""Hybrid search and its explanation, for many queries at once.

Both start from the same candidates: the pools of the sources, prepared and
fused. Text is joined to the final rows only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.functions.vectors import similarity_of_distance
from tessel.operators.dense import dense_search
from tessel.operators.lexical import InvertedIndex, sparse_search
from tessel.operators.ranking import LEXICAL, SEMANTIC, fuse, prepare, ranked
from tessel.plans.retrieval import POOL_FACTOR, TOP_K, RetrievalPlan

POOL_SCHEMA = "query_id long, source string, key long, raw double"


@dataclass(frozen=True)
class Query:
    """A question with its vector."""

    query_id: int
    text: str
    vector: list[float]


@dataclass
class Candidates:
    """prepared: the pools' rows with what each contributes; fused: one row per key; enabled: the sources asked."""

    prepared: DataFrame
    fused: DataFrame
    enabled: list[str]


def candidates(vectors: DataFrame, index: InvertedIndex, queries: list[Query], plan: RetrievalPlan, top_k: int = TOP_K, order: str = "relevance", key_type: str = "long", digits: int | None = None) -> Candidates:
    """The pools of 4 top_k rows per source and query, prepared and fused.

    Blank queries and top_k of 0 or less have no candidates. ValueError if the
    plan gives every source weight 0. A source of weight 0 is not read.
    `digits` rounds raw scores, where engines that add in another order are to
    agree on ties.
    """
    spark = vectors.sparkSession
    asked = [q for q in queries if q.text.strip()] if top_k > 0 else []
    enabled = plan.fusion.enabled() if asked else []
    pools = spark.createDataFrame([], POOL_SCHEMA.replace("key long", f"key {key_type}"))
    size = POOL_FACTOR * top_k
    raw = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    if SEMANTIC in enabled:
        near = dense_search(vectors, [(q.query_id, q.vector) for q in asked], size)
        pools = pools.unionByName(near.select("query_id", F.lit(SEMANTIC).alias("source"), "key", raw(similarity_of_distance("distance")).alias("raw")))
    if LEXICAL in enabled:
        found = sparse_search(index, [(q.query_id, q.text) for q in asked], size, order)
        pools = pools.unionByName(found.select("query_id", F.lit(LEXICAL).alias("source"), "key", raw(F.col("score")).alias("raw")))
    prepared = prepare(pools, plan.norm)
    prepared = prepared.withColumn("contribution", plan.fusion.contribution())
    return Candidates(prepared, fuse(prepared, plan.fusion), enabled)


def search(found: Candidates, top_k: int = TOP_K, digits: int | None = None) -> DataFrame:
    """(query_id, key, combined, rank): the best top_k of each query; scores of 0 and below are no results."""
    return ranked(found.fused, digits).where(F.col("rank") <= max(0, top_k)).select("query_id", "key", "combined", "rank")


def hydrate(hits: DataFrame, chunks: DataFrame, files: DataFrame, key_col: str = "chunk_id") -> DataFrame:
    """Hits with their chunk and the paths that hold it.

    refs is the sorted array of (path, status); primary the smallest fresh path,
    else the smallest; stale whether any ref is. A chunk without a path is not
    a result.
    """
    text = hits.join(chunks.withColumnRenamed(key_col, "key"), "key")
    paths = files.join(text.select("content_digest").distinct(), "content_digest", "left_semi")
    return text.join(content_refs(paths), "content_digest")


def content_refs(files: DataFrame) -> DataFrame:
    """(content_digest, refs, primary, stale), paths compared step by step."""
    steps = F.split("path", "/")
    refs = files.groupBy("content_digest").agg(
        F.sort_array(F.collect_set(F.struct(steps.alias("steps"), "path", "status"))).alias("r"),
        F.min(F.when(F.col("status") == "fresh", F.struct(steps.alias("steps"), "path"))).alias("fresh"),
        F.min(F.struct(steps.alias("steps"), "path")).alias("any"),
        F.bool_or(F.col("status") == "stale").alias("stale"),
    )
    plain = F.transform("r", lambda x: F.struct(x["path"].alias("path"), x["status"].alias("status")))
    return refs.select("content_digest", plain.alias("refs"), F.coalesce("fresh.path", "any.path").alias("primary"), "stale")


def explain(found: Candidates, wanted: DataFrame, top_k: int = TOP_K, digits: int | None = None) -> DataFrame:
    """One row for each wanted (query_id, key) and source.

    Columns: query_id, key, source, status, pool_size, raw_score,
    prepared_score, pool_rank, place (1-based, ties by key), contribution (what the
    source adds to combined), combined (0 if nowhere found), rank (over all
    positive scores), in_results. status is, in this order, disabled (the source
    was not asked), empty (it found nothing), not_retrieved (not this key), else
    matched.
    """
    sources = F.explode(F.array(F.lit(SEMANTIC), F.lit(LEXICAL))).alias("source")
    rows = wanted.select("query_id", "key").distinct().select("query_id", "key", sources)
    sizes = found.prepared.groupBy("query_id", "source").agg(F.max("pool_size").alias("size"))
    own = found.prepared.select("query_id", "key", "source", "raw", "prepared", "pool_rank", "place", "contribution")
    place = ranked(found.fused, digits).select("query_id", "key", "rank")
    total = found.fused.select("query_id", "key", "combined")
    out = rows.join(F.broadcast(sizes), ["query_id", "source"], "left").join(own, ["query_id", "key", "source"], "left")
    out = out.join(total, ["query_id", "key"], "left").join(place, ["query_id", "key"], "left")
    status = F.when(~F.col("source").isin(found.enabled or [""]), "disabled").when(F.col("size").isNull(), "empty").when(F.col("raw").isNull(), "not_retrieved").otherwise("matched")
    return out.select(
        "query_id",
        "key",
        "source",
        status.alias("status"),
        F.coalesce("size", F.lit(0)).cast("long").alias("pool_size"),
        F.col("raw").alias("raw_score"),
        F.col("prepared").alias("prepared_score"),
        "pool_rank",
        "place",
        F.coalesce("contribution", F.lit(0.0)).alias("contribution"),
        F.coalesce("combined", F.lit(0.0)).alias("combined"),
        "rank",
        F.coalesce(F.col("rank") <= top_k, F.lit(False)).alias("in_results"),
    )
