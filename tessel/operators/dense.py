"""Exact nearest neighbours of query vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions.vectors import matrix

#: Queries answered in one scan of the vectors.
BLOCK = 4096


def dense_search(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int, vector_col: str = "embedding", key_col: str = "chunk_id") -> DataFrame:
    """(query_id, key, distance, position): each query's k nearest vectors by Euclidean distance.

    Exact: every usable vector is compared, in matrix products over Arrow
    batches; each batch keeps its k nearest, so that only those are shuffled.
    Vectors of another width, with missing or non-finite numbers, and zero
    vectors take no part. ValueError if the queries differ in width. Ties go to
    the smaller key; k of 0 or less gives no rows. Queries are broadcast in
    blocks of BLOCK, each of which scans the vectors once.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key_col].dataType.simpleString()
    schema = f"query_id long, key {kind}, distance double"
    widths = {len(v) for _, v in queries}
    if len(widths) > 1:
        raise ValueError(f"query vectors of different widths: {sorted(widths)}")
    if k <= 0 or not queries:
        return spark.createDataFrame([], schema + ", position int")
    width = widths.pop()
    source = vectors.select(vectors[key_col], vectors[vector_col]).where(F.size(vectors[vector_col]) == width)

    def scan(block: list[tuple[int, list[float]]]) -> DataFrame:
        sent = spark.sparkContext.broadcast((np.array([q for q, _ in block], np.int64), np.array([v for _, v in block], np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, asked = sent.value
            squares = (asked * asked).sum(1)
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    rows, m = matrix(part.column(1), width)
                    if not len(rows):
                        continue
                    rough = squares[:, None] + (m * m).sum(1)[None, :] - 2 * asked @ m.T
                    n = min(len(rows), k)
                    # A little more than the k-th distance, so that ties and rounding lose nothing.
                    limit = np.partition(rough, n - 1, axis=1)[:, n - 1] * (1 + 1e-9) + 1e-9
                    q, r = np.nonzero(rough <= limit[:, None])
                    distance = np.sqrt(((asked[q] - m[r]) ** 2).sum(1))
                    yield pa.RecordBatch.from_arrays([pa.array(names[q]), part.column(0).take(pa.array(rows[r])), pa.array(distance)], names=["query_id", "key", "distance"])

        return source.mapInArrow(run, schema)

    out = scan(queries[:BLOCK])
    for at in range(BLOCK, len(queries), BLOCK):
        out = out.unionByName(scan(queries[at : at + BLOCK]))
    window = Window.partitionBy("query_id").orderBy("distance", "key")
    return out.withColumn("position", F.row_number().over(window)).where(F.col("position") <= k)
