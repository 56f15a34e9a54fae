"""Normalization and fusion of score pools.

A pool has the columns query_id, source, key, raw: one row for each key that a
source found. Larger raw scores are better.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEMANTIC, LEXICAL = "semantic", "lexical"
# Defaults of the engine.
SEMANTIC_WEIGHT, LEXICAL_WEIGHT, TEMPERATURE, RRF_K = 0.7, 0.3, 1.0, 60


def _pool():
    return Window.partitionBy("query_id", "source")


class Norm(Protocol):
    name: str

    def prepared(self) -> Column:
        """The prepared score of a pool's row, by windows over the pool."""


class Fusion(Protocol):
    name: str

    def enabled(self) -> list[str]:
        """The sources worth asking."""

    def contribution(self) -> Column:
        """What a row with `prepared` and `place` adds to its key's score."""


@dataclass(frozen=True)
class MinMax:
    """Scores from 0 to 1 within the pool; all 1 where they are equal."""

    name: str = "minmax"

    def prepared(self) -> Column:
        low, high = F.min("raw").over(_pool()), F.max("raw").over(_pool())
        return F.when(high == low, 1.0).otherwise((F.col("raw") - low) / (high - low))


@dataclass(frozen=True)
class Softmax:
    """Shares of the pool that grow exponentially with the score over the temperature."""

    temperature: float = TEMPERATURE
    name: str = "softmax"

    def __post_init__(self):
        if not self.temperature > 0:
            raise ValueError("temperature must be positive")

    def prepared(self) -> Column:
        top = F.max("raw").over(_pool())
        e = F.exp((F.col("raw") - top) / self.temperature)
        return e / F.sum(e).over(_pool())


@dataclass(frozen=True)
class Linear:
    """Weighted sum of the prepared scores; a source of weight 0 is not asked, an unknown one weighs 0."""

    weights: tuple[tuple[str, float], ...] = ((SEMANTIC, SEMANTIC_WEIGHT), (LEXICAL, LEXICAL_WEIGHT))
    name: str = "linear"

    def enabled(self) -> list[str]:
        on = [s for s, w in self.weights if w != 0]
        if not on:
            raise ValueError("all sources have weight 0")
        return on

    def contribution(self) -> Column:
        weight = F.lit(0.0)
        for s, w in self.weights:
            weight = F.when(F.col("source") == s, F.lit(float(w))).otherwise(weight)
        return weight * F.col("prepared")

    def formula(self, values: dict[str, float | None]) -> str:
        """The sum as text, for one key."""
        shown = [f"{s} × {w:g}" for s, w in self.weights]
        got = [f"{values.get(s) or 0.0:.4f} × {w:g}" for s, w in self.weights]
        return f"{' + '.join(shown)} = {' + '.join(got)}"


@dataclass(frozen=True)
class ReciprocalRank:
    """Sum of 1 / (k + place) over the sources."""

    k: int = RRF_K
    sources: tuple[str, ...] = (SEMANTIC, LEXICAL)
    name: str = "rrf"

    def enabled(self) -> list[str]:
        return list(self.sources)

    def contribution(self) -> Column:
        return 1.0 / (self.k + F.col("place"))

    def formula(self, places: dict[str, int | None]) -> str:
        """The sum as text, for one key."""
        shown = [f"1 ÷ (k + {s}_rank)" for s in self.sources]
        got = [f"1 ÷ ({self.k} + {places[s]})" if places.get(s) else "0" for s in self.sources]
        missing = [s for s in self.sources if not places.get(s)]
        return f"{' + '.join(shown)} = {' + '.join(got)}" + (f" ({', '.join(missing)} has no rank)" if missing else "")


def prepare(pools: DataFrame, norm: Norm | None) -> DataFrame:
    """The pools with pool_size, place (row number), pool_rank (equal scores share the first) and prepared (raw without a norm)."""
    order = _pool().orderBy(F.desc("raw"))
    return pools.select(
        "*",
        F.count(F.lit(1)).over(_pool()).alias("pool_size"),
        F.row_number().over(_pool().orderBy(F.desc("raw"), "key")).alias("place"),
        F.rank().over(order).alias("pool_rank"),
        (norm.prepared() if norm else F.col("raw").cast("double")).alias("prepared"),
    )


def fuse(prepared: DataFrame, fusion: Fusion) -> DataFrame:
    """(query_id, key, combined, semantic_place, lexical_place): contributions summed by key, with one shuffle."""
    rows = prepared.withColumn("c", fusion.contribution())
    place = lambda s: F.max(F.when(F.col("source") == s, F.col("place"))).alias(f"{s}_place")
    return rows.groupBy("query_id", "key").agg(F.sum("c").alias("combined"), place(SEMANTIC), place(LEXICAL))


def ranked(fused: DataFrame, digits: int | None = None) -> DataFrame:
    """Positive scores only, with rank: larger first, then by place in the semantic and in the lexical pool, then by key."""
    score = F.col("combined") if digits is None else F.round("combined", digits)
    order = Window.partitionBy("query_id").orderBy(score.desc(), F.asc_nulls_last("semantic_place"), F.asc_nulls_last("lexical_place"), "key")
    return fused.where(F.col("combined") > 0).withColumn("rank", F.row_number().over(order))
