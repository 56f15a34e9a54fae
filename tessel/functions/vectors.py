"""Vector functions, as Column expressions for single values and numpy for batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessel.functions.text import col


def l2_norm(c: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(c), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalize(c: Column | str) -> Column:
    """The unit vector; a zero vector stays as it is."""
    n = l2_norm(c)
    return F.when(n == 0, F.transform(col(c), lambda x: x.cast("double"))).otherwise(F.transform(col(c), lambda x: x.cast("double") / n))


def l2_distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def similarity_of_distance(d: Column | str) -> Column:
    """1 - d²/2: the cosine of unit vectors, and a falling function of distance for others."""
    return 1 - col(d) * col(d) / 2


def is_usable(c: Column | str, width: int) -> Column:
    """Whether a vector has the width, only finite numbers, and is not zero."""
    squares = F.aggregate(col(c), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.coalesce((F.size(col(c)) == width) & ~F.isnan(squares) & (squares > 0) & (squares < float("inf")), F.lit(False))


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, float64 matrix) of the usable vectors of a batch."""
    rows = np.nonzero(np.asarray(column.value_lengths().fill_null(0)) == width)[0]
    flat = column.take(pa.array(rows)).flatten()
    numbers = np.asarray(flat.cast(pa.float64()).fill_null(float("nan"))).reshape(-1, width)
    with np.errstate(all="ignore"):
        squares = (numbers * numbers).sum(1)
    good = np.isfinite(squares) & (squares > 0)
    return rows[good], numbers[good]
