"""Change detection: the disk's listing against the index's files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.sources.discover import SUPPORTED

NEW, CHANGED, UNCHANGED, MISSING, SKIPPED, RENAMED = "new", "changed", "unchanged", "missing", "skipped", "renamed"


def is_supported(path: Column) -> Column:
    """Whether the path's ending is one that can be extracted."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(list(SUPPORTED))


def classify(disk: DataFrame, files: DataFrame) -> DataFrame:
    """(path, bucket, was_stale) from disk(path, mtime, size) and files(path, mtime, size, status).

    new: supported, not in the index; changed: mtime or size differs, or the
    row is stale; unchanged; missing: in the index but nowhere on disk; skipped:
    on disk, not in the index, and not supported. A file in the index whose
    ending is no longer supported counts as skipped too, not as missing.
    """
    d = disk.select("path", F.col("mtime").alias("m"), F.col("size").alias("s"), F.lit(True).alias("on_disk"))
    f = files.select("path", F.col("mtime").alias("fm"), F.col("size").alias("fs"), "status")
    same = F.col("m").eqNullSafe(F.col("fm")) & F.col("s").eqNullSafe(F.col("fs"))
    bucket = (
        F.when(F.col("on_disk").isNull(), MISSING)
        .when(~is_supported(F.col("path")), SKIPPED)
        .when(F.col("status").isNull(), NEW)
        .when(same & (F.col("status") == "fresh"), UNCHANGED)
        .otherwise(CHANGED)
    )
    return d.join(f, "path", "full_outer").select("path", bucket.alias("bucket"), F.coalesce(F.col("status") == "stale", F.lit(False)).alias("was_stale"))


def rename_pairs(new: DataFrame, missing: DataFrame) -> DataFrame:
    """(content_digest, old_path, new_path): missing and new paths of equal content, paired in the order of their paths.

    Each path is in one pair at most; a new path without digest (it could not
    be read) is in none.
    """
    nth = Window.partitionBy("content_digest").orderBy("path")
    number = lambda df, name: df.where(F.col("content_digest").isNotNull()).select("content_digest", F.col("path").alias(name), F.row_number().over(nth).alias("nth"))
    return number(missing, "old_path").join(number(new, "new_path"), ["content_digest", "nth"]).select("content_digest", "old_path", "new_path")


def with_renames(buckets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(path, bucket, old_path): renamed files leave new and missing."""
    kept = buckets.join(pairs.select(F.col("old_path").alias("path")).unionByName(pairs.select(F.col("new_path").alias("path"))), "path", "left_anti")
    return kept.select("path", "bucket", F.lit(None).cast("string").alias("old_path")).unionByName(pairs.select(F.col("new_path").alias("path"), F.lit(RENAMED).alias("bucket"), "old_path"))


def summary(buckets: DataFrame) -> DataFrame:
    """One row: counts, pending (what a run would do) and dirty (changed or missing exist)."""
    n = lambda b: F.count(F.when(F.col("bucket") == b, 1))
    counts = [n(b).alias(b) for b in (NEW, CHANGED, UNCHANGED, MISSING, RENAMED, SKIPPED)]
    return buckets.agg(*counts, (n(NEW) + n(CHANGED) + n(MISSING) + n(RENAMED)).alias("pending"), ((n(CHANGED) + n(MISSING)) > 0).alias("dirty"))
