"""Vector search over chunk_vectors."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions.vectors import is_usable, l2_norm, l2_normalize, similarity_of_distance
from tessel.operators.dense import dense_search
from tessel.queries.registry import register
from tessel.runtime import table

WIDTH, ASKED = 64, 8

USABLE = "len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) > 0 AND isfinite(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))"
VECTORS_SQL = f"v AS (SELECT chunk_id, embedding::DOUBLE[] AS e FROM chunk_vectors WHERE {USABLE})"
#: Every usable vector whose id is divisible by EVERY is asked for.
EVERY = 50
EVERY_SQL = f"q AS (SELECT chunk_id AS query_id, e AS qe FROM v WHERE chunk_id % {EVERY} = 0)"
#: For hybrid questions, the vectors of the first usable chunks go with the texts.
ASKED_SQL = f"q AS (SELECT row_number() OVER (ORDER BY chunk_id) AS query_id, e AS qe FROM (SELECT * FROM v ORDER BY chunk_id LIMIT {ASKED}))"


def asked_vectors(spark: SparkSession, folder: str, n: int = ASKED) -> list[list[float]]:
    """The vectors of the n first usable chunks."""
    rows = table(spark, folder, "chunk_vectors").where(is_usable("embedding", WIDTH)).orderBy("chunk_id").limit(n)
    return [[float(x) for x in r["embedding"]] for r in rows.collect()]


def every_vector(spark: SparkSession, folder: str) -> list[tuple[int, list[float]]]:
    """The stated set of queries, against which all vectors are compared in blocks."""
    rows = table(spark, folder, "chunk_vectors").where(is_usable("embedding", WIDTH) & (F.col("chunk_id") % EVERY == 0)).select("chunk_id", F.col("embedding").cast("array<double>").alias("v"))
    return sorted((r["chunk_id"], r["v"]) for r in rows.toLocalIterator())


@register(f"""
WITH {VECTORS_SQL}, {EVERY_SQL},
d AS (SELECT query_id, chunk_id, list_distance(e, qe) AS distance FROM v CROSS JOIN q)
SELECT query_id, chunk_id, round(distance, 6) AS distance, position FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), chunk_id) AS position FROM d) WHERE position <= 20
""")
def knn_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors of several query vectors."""
    near = dense_search(table(spark, folder, "chunk_vectors"), every_vector(spark, folder), 20)
    return near.select("query_id", F.col("key").alias("chunk_id"), F.round("distance", 6).alias("distance"), "position")


@register(f"""
WITH {VECTORS_SQL}, {EVERY_SQL},
d AS (SELECT query_id, chunk_id, list_distance(e, qe) AS distance FROM v CROSS JOIN q)
SELECT query_id, chunk_id, round(1 - distance * distance / 2, 6) AS score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), chunk_id) AS position FROM d) WHERE position <= 40
""")
def cosine_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Distances as similarities, for pools of 40."""
    near = dense_search(table(spark, folder, "chunk_vectors"), every_vector(spark, folder), 40)
    return near.select("query_id", F.col("key").alias("chunk_id"), F.round(similarity_of_distance("distance"), 6).alias("score"))


@register(f"""
WITH v AS (SELECT chunk_id, embedding::DOUBLE[] AS e, {USABLE} AS usable FROM chunk_vectors WHERE len(embedding) = 64)
SELECT chunk_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS norm,
  round(list_sum(list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y))))), 6) AS unit_sum FROM v WHERE usable
""")
def l2_normalized(spark: SparkSession, folder: str) -> DataFrame:
    """Vector lengths, and the sum of each unit vector's numbers."""
    good = table(spark, folder, "chunk_vectors").where(is_usable("embedding", WIDTH))
    unit = F.aggregate(l2_normalize("embedding"), F.lit(0.0), lambda a, x: a + x)
    return good.select("chunk_id", F.round(l2_norm("embedding"), 6).alias("norm"), F.round(unit, 6).alias("unit_sum"))
