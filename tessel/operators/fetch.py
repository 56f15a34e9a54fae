"""Fetching chunks by digest, and their context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.functions.text import DIGEST_PREFIX, digest_prefix
from tessel.operators.search import content_refs


def chunks_by_prefix(chunks: DataFrame, files: DataFrame, prefix: str) -> DataFrame:
    """Chunks whose digest begins with the prefix and that some path holds, with refs, primary and stale.

    The prefix reaches the Parquet scan. Several rows mean that the prefix, or
    even a full digest (equal text in two contents), is ambiguous.
    """
    hit = chunks.where(F.col("digest").startswith(DIGEST_PREFIX + digest_prefix(prefix)))
    return hit.join(content_refs(files.join(hit.select("content_digest").distinct(), "content_digest", "left_semi")), "content_digest")


def neighbors(anchors: DataFrame, chunks: DataFrame, radius: int) -> DataFrame:
    """(anchor, chunk_id, distance): chunks of the anchor's content and heading at most `radius` seqs away, not itself.

    An equi-join on content, heading and exact seq: the anchors are multiplied
    by the offsets, so a content of any size costs rows in proportion.
    ValueError for a negative radius.
    """
    if radius < 0:
        raise ValueError("radius must not be negative")
    offsets = F.explode(F.array(*[F.lit(o) for o in range(-radius, radius + 1) if o] or [F.lit(None).cast("int")]))
    asked = anchors.select(F.col("chunk_id").alias("anchor"), "content_digest", F.coalesce("heading", F.lit("")).alias("h"), "seq", offsets.alias("distance"))
    asked = asked.where(F.col("distance").isNotNull()).withColumn("seq", F.col("seq") + F.col("distance"))
    own = chunks.select("chunk_id", "content_digest", F.coalesce("heading", F.lit("")).alias("h"), "seq")
    return asked.join(own, ["content_digest", "h", "seq"]).select("anchor", "chunk_id", "distance")
