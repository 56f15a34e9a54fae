"""Broadcasting only what is known to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 32 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().longValue())


def fits_broadcast(df: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """The table with a broadcast hint if its estimated size is at most `most` bytes, else as it is: then Spark and AQE choose the join."""
    try:
        return F.broadcast(df) if estimated_bytes(df) <= most else df
    except Exception:
        return df
