"""Following a folder of observations: each path's newest state, kept by a stream.

Late and repeated observations are no problem for the state, because newest
means observed last, not arrived last. Each micro-batch is one commit that
carries the batch's number; a batch that is replayed after a failure finds its
number in the table and does nothing, so every batch counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tessel.operators.sizes import fits_broadcast
from tessel.runtime import materialize
from tessel.sources.versioned import VersionedTable

OBSERVATION = T.StructType(
    [T.StructField("scan_id", T.LongType()), T.StructField("path", T.StringType()), T.StructField("mtime", T.DoubleType()), T.StructField("size", T.LongType()), T.StructField("observed_at", T.TimestampType()), T.StructField("arrived_at", T.TimestampType())]
)
STATE = T.StructType([T.StructField("path", T.StringType()), T.StructField("mtime", T.DoubleType()), T.StructField("size", T.LongType()), T.StructField("observed_at", T.TimestampType())])
STREAM = "observations"


def newest(observations: DataFrame) -> DataFrame:
    """One row per path: what was observed last, gone paths with null mtime and size."""
    order = F.struct("observed_at", F.coalesce("mtime", F.lit(-1.0)), F.coalesce("size", F.lit(-1)))
    rows = observations.where(F.col("path").isNotNull() & F.col("observed_at").isNotNull())
    return rows.groupBy("path").agg(F.max_by(F.struct("mtime", "size", "observed_at"), order).alias("s")).select("path", "s.*")


def follow(spark: SparkSession, folder: str, state: VersionedTable, checkpoint: str, once: bool = False, schema: T.StructType = OBSERVATION, vectors: int = 32) -> StreamingQuery:
    """Start the stream from Parquet files in `folder` to the state table; with `once` it ends when all files are in.

    A batch reads the state's rows of its own paths and commits those that
    change: their old positions as a deletion vector, the new rows as a file.
    After `vectors` such vectors the files that they are about are rewritten.
    """

    def merge(batch: DataFrame, number: int) -> None:
        if state.processed(STREAM) > number:
            return
        came = materialize(newest(batch.select("path", "mtime", "size", "observed_at")))
        old = state.read().join(fits_broadcast(came.select("path")), "path", "left_semi").select(*came.columns)
        now = materialize(newest(came.unionByName(old)).exceptAll(old))
        state.replace(now, ["path"], now, processed={STREAM: number + 1})
        if len(state.state().deletions) >= vectors:
            state.compact()

    rows = spark.readStream.schema(schema).parquet(folder)
    writer = rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
