"""One ranking from several differently-scaled scores.

Method: ideal-point ranking. Winsorised scores are vector-normalised; an item's
weighted distances to the ideal point (the best of every source) and to the
anti-ideal point give its relative closeness, by which items are sorted.

What a source contributes is its scores' standing, not their size: only a
source that matched something takes part, the direction of its numbers is taken
from its pool ranks, and its standings are winsorised and normalised to a vector
of length one. All sources have the same weight, so that each has the same say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TAIL = 0.05


def _finite(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def ideal_point_ranking(
    df: DataFrame,
    query_col: str = "query_id",
    item_col: str = "chunk_id",
    source_col: str = "source",
    raw_col: str = "raw_score",
    prepared_col: str = "prepared_score",
    rank_col: str = "pool_rank",
    status_col: str = "status",
    tail: float = TAIL,
) -> DataFrame:
    """One row per query and item that some source matched.

    Columns: query, item, closeness double (1 is the ideal point), sources int
    (how many matched it), position int (1-based, gapless within the query;
    ties by item).

    An item's rank within a source is its pool_rank; where that is missing, the
    place of its raw score (or, without one, its prepared score) among the
    others'. Non-finite scores count as missing; an item with nothing but its
    matched status stands last in the source. Repeated rows count once: of an
    item's rows in a source the best rank holds. Rows with another status, or
    with a null query, item or source, do not take part. An item that a source
    did not match stands at the source's anti-ideal value. Empty tables give no
    rows. A pool, which is one source's answer to one query, is sorted in one
    task, and so are the items of one query at the end; pools are cut at a few
    times the wanted results by the search that makes them.
    """
    rows = df.where(F.col(status_col) == "matched").select(
        F.col(query_col).alias("q"),
        F.col(item_col).alias("i"),
        F.col(source_col).alias("s"),
        _finite(F.col(raw_col).cast("double")).alias("raw"),
        _finite(F.col(prepared_col).cast("double")).alias("prepared"),
        F.col(rank_col).cast("double").alias("rank"),
    )
    rows = rows.where(F.col("q").isNotNull() & F.col("i").isNotNull() & F.col("s").isNotNull())
    one = rows.groupBy("q", "s", "i").agg(F.max("raw").alias("raw"), F.max("prepared").alias("prepared"), F.min("rank").alias("rank"))

    # Does a larger raw score stand for a better or a worse rank? The known ranks tell.
    pool = Window.partitionBy("q", "s")
    both = F.when(F.col("raw").isNotNull(), F.col("rank"))
    together = F.corr("raw", both).over(pool)
    sign = F.when(~F.isnan(together) & (together > 0), -1.0).otherwise(1.0)
    directed = one.withColumn("score", F.coalesce(F.col("raw") * sign, F.col("prepared")))
    place = F.row_number().over(pool.orderBy(F.desc_nulls_last("score"), F.asc_nulls_last("rank"), "i"))
    n = F.count(F.lit(1)).over(pool)
    placed = directed.withColumn("n", n).withColumn("place", F.coalesce("rank", place.cast("double")))
    # Standing: 1 for the best, falling evenly to 1/n for the last.
    standing = placed.withColumn("standing", (F.col("n") - F.least("place", "n") + 1) / F.col("n"))
    return _closeness(standing, query_col, item_col, tail)


def _closeness(standing: DataFrame, query_col: str, item_col: str, tail: float) -> DataFrame:
    bounds = standing.groupBy("q", "s").agg(F.percentile("standing", F.array(F.lit(tail / 2), F.lit(1 - tail / 2))).alias("b"), F.count(F.lit(1)).alias("m"))
    clipped = standing.join(bounds, ["q", "s"]).withColumn("v", F.least(F.greatest("standing", F.col("b")[0]), F.col("b")[1]))
    pool = Window.partitionBy("q", "s")
    # Unmatched items stand at zero, which is each source's anti-ideal value; matched ones lie above.
    unit = clipped.withColumn("v", F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(pool))).withColumn("best", F.max("v").over(pool))
    sources = unit.groupBy("q", "s").agg(F.max("best").alias("best")).groupBy("q").agg(F.sum(F.col("best") * F.col("best")).alias("far"))
    items = unit.groupBy("q", "i").agg(
        F.sum(F.pow(F.col("best") - F.col("v"), 2) - F.pow("best", 2)).alias("nearer"), F.sum(F.pow("v", 2)).alias("from_worst"), F.count(F.lit(1)).alias("sources"), F.sum("standing").alias("total")
    )
    # A source that did not match the item adds the whole distance of its ideal point.
    ideal = F.sqrt(F.greatest(F.lit(0.0), F.col("far") + F.col("nearer")))
    worst = F.sqrt("from_worst")
    scored = items.join(sources, "q").withColumn("closeness", F.round(worst / (ideal + worst), 12))
    order = Window.partitionBy("q").orderBy(F.desc("closeness"), F.desc("total"), "i")
    return scored.select(
        F.col("q").alias(query_col), F.col("i").alias(item_col), "closeness", F.col("sources").cast("int").alias("sources"), F.row_number().over(order).alias("position")
    )
