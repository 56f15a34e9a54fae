"""Which paths the next run has to process, from the diff of two table versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.runtime import scratch
from tessel.sources.versioned import CHANGE, VersionedTable, process_changes

STATE = T.StructType([T.StructField("path", T.StringType()), T.StructField("mtime", T.DoubleType()), T.StructField("size", T.LongType())])
WORK = T.StructType([T.StructField("path", T.StringType())])


def disk_state(scans: DataFrame) -> DataFrame:
    """The paths on disk with mtime and size, by each path's newest observation.

    Newest is the greatest observed_at, whenever it arrived; of equal ones the
    last to arrive, then the greatest scan. Observations without a path or time
    are ignored; repeated ones do not matter. A path whose newest observation
    has neither mtime nor size is gone.
    """
    seen = scans.where(F.col("path").isNotNull() & F.col("observed_at").isNotNull())
    order = F.struct("observed_at", F.coalesce("arrived_at", "observed_at"), F.coalesce("scan_id", F.lit(-1)), F.coalesce("mtime", F.lit(-1.0)), F.coalesce("size", F.lit(-1)))
    newest = seen.groupBy("path").agg(F.max_by(F.struct("mtime", "size"), order).alias("s"))
    return newest.select("path", F.col("s.mtime").cast("double").alias("mtime"), F.col("s.size").cast("long").alias("size")).where(F.col("mtime").isNotNull() | F.col("size").isNotNull())


def last_success(runs: DataFrame) -> int:
    """The number of the last run that ended well; 0 if none did. Null outcomes and runs without an end did not."""
    return runs.where((F.lower("outcome") == "ok") & F.col("finished_at").isNotNull()).agg(F.max("run_id")).collect()[0][0] or 0


def adopt(disk: VersionedTable, work: VersionedTable, files: DataFrame, run: int = 0) -> None:
    """Begin with an index that exists: what it has processed is version 1 of the disk, taken in by version 1 of the work.

    Stale rows are not part of it: an earlier run has left them unfinished.
    """
    done = files.where(F.col("path").isNotNull() & (F.coalesce("status", F.lit("stale")) != "stale"))
    disk.commit(done.select("path", F.col("mtime").cast("double").alias("mtime"), F.col("size").cast("long").alias("size")), expect=0, note={"run": run})
    work.commit(processed={"disk": 1}, expect=0, note={"run": run})


def next_run(disk: VersionedTable, work: VersionedTable, scans: DataFrame) -> DataFrame:
    """(path): what this run has to process; its commit to `work` has it, together with the disk's version that it covers.

    The disk's table takes in what differs from its newest version: positions of
    records that changed or went, as a deletion vector, and the new records.
    What the manifests since the processed version add is to be done. A run
    that fails before its commit leaves the processed version as it was, so
    the next one has the same paths and those that came meanwhile.
    """
    disk.merge(disk_state(scans))
    version = process_changes(disk, "disk", work, lambda delta: delta.where(F.col(CHANGE) == "insert").select("path").distinct())
    if version is None:
        return work.read(0)
    return work.changes(version - 1, version).select("path")


def to_process(scans: DataFrame, files: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """(path): on disk and new, changed, or left unfinished, each once.

    From tables that are not versioned yet: the index's record of what has been
    processed is adopted as the state after the last successful run of `runs`,
    then the next run is made. New paths, paths with another mtime or size and
    stale ones come out; records that only go are paths gone from disk, which
    are no cases. Null paths are ignored; empty tables are fine.
    """
    spark = scans.sparkSession
    folder = scratch(spark, "paths")
    disk, work = VersionedTable(spark, f"{folder}/disk", STATE), VersionedTable(spark, f"{folder}/work", WORK)
    adopt(disk, work, files, last_success(runs) if runs is not None else 0)
    return next_run(disk, work, scans)
