"""From a folder of files to a new version of the index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions.text import chunk_digest, digest
from tessel.operators import detect as D
from tessel.operators.chunking import RecursiveSplitter, split_segments
from tessel.operators.embed import Embedder, embed
from tessel.runtime import materialize
from tessel.schema import FILES
from tessel.sources.discover import discover
from tessel.sources.extract import ExtractionError, Segment, extract
from tessel.sources.index import Index

DISK = "path string, mtime double, size long"


@dataclass(frozen=True)
class Summary:
    """What a run did. failed has (path, reason)."""

    new: int
    changed: int
    renamed: int
    removed: int
    reused: int
    embedded_chunks: int
    failed: list[tuple[str, str]]


def listing(spark: SparkSession, root: str, ignore_files: tuple[str, ...] = ()) -> DataFrame:
    """The folder's files as a table; listed by one walker, so that mtimes are comparable."""
    return spark.createDataFrame(discover(root, ignore_files), DISK)


def read_contents(paths: DataFrame, root: str) -> DataFrame:
    """(path, data, error): file bytes, read by the tasks. A file that cannot be read has an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    data, error = Path(root, path).read_bytes(), None
                except OSError as e:
                    data, error = None, str(e)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([data], pa.binary()), pa.array([error], pa.string())], names=["path", "data", "error"])

    return paths.select("path").mapInArrow(run, "path string, data binary, error string")


def extract_chunks(contents: DataFrame, size: int, overlap: int) -> DataFrame:
    """(content_digest, path, error, seq, text, heading, page): the pieces of each content; one row without seq if there are none.

    Headings are hard borders; seq counts through the content.
    """
    splitter = RecursiveSplitter(size, overlap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, path, data in zip(*(batch.column(c).to_pylist() for c in ("content_digest", "path", "data"))):
                error, pieces = None, []
                try:
                    segments: list[Segment] | None = extract(data, path)
                    pieces = split_segments([(s.text, s.heading, s.page) for s in segments or []], splitter)
                except ExtractionError as e:
                    error = str(e)
                rows = pieces or [(None, None, None, None)]
                n = len(rows)
                seq, text, heading, page = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * n), pa.array([path] * n), pa.array([error] * n, pa.string()), pa.array(seq, pa.int32()), pa.array(text, pa.string()), pa.array(heading, pa.string()), pa.array(page, pa.int32())],
                    names=["content_digest", "path", "error", "seq", "text", "heading", "page"],
                )

    return contents.select("content_digest", "path", "data").mapInArrow(run, "content_digest string, path string, error string, seq int, text string, heading string, page int")


def detect(index: Index | None, spark: SparkSession, root: str, ignore_files: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(disk, buckets, renames). Only new files are hashed, and only if some are missing."""
    disk = listing(spark, root, ignore_files)
    files = index.read("files") if index is not None and index.exists() else spark.createDataFrame([], FILES)
    buckets = D.classify(disk, files)
    buckets = materialize(buckets)
    missing = buckets.where(F.col("bucket") == D.MISSING)
    pairs = spark.createDataFrame([], "content_digest string, old_path string, new_path string")
    if not missing.isEmpty():
        new = read_contents(buckets.where(F.col("bucket") == D.NEW), root).where(F.col("data").isNotNull())
        pairs = materialize(D.rename_pairs(new.select("path", digest("data").alias("content_digest")), missing.join(files.select("path", "content_digest"), "path")))
    return disk, D.with_renames(buckets, pairs), pairs


def sync(index: Index, root: str, embedder: Embedder, size: int = 1024, overlap: int = 128, ignore_files: tuple[str, ...] = ()) -> Summary:
    """Bring the index up to date in one commit.

    Renamed files are re-pointed without reading them again. New and changed
    ones are read, and contents that the index knows, or that come twice, are
    neither split nor embedded again. Files that cannot be read or parsed are
    reported, and stale if the index has them; all others go in. The commit is
    the whole run: a run that fails leaves the index as it was.
    """
    spark = index.spark
    disk, buckets, pairs = detect(index, spark, root, ignore_files)
    files, known = index.read("files"), index.read("chunks").select("content_digest").distinct()
    work = buckets.where(F.col("bucket").isin(D.NEW, D.CHANGED)).select("path", "bucket")
    read = materialize(read_contents(work, root).withColumn("content_digest", digest("data")))
    good = read.where(F.col("error").isNull())
    fresh = good.join(known, "content_digest", "left_anti").dropDuplicates(["content_digest"])
    pieces = materialize(extract_chunks(fresh, size, overlap))
    bad = pieces.where(F.col("error").isNotNull()).select("content_digest", F.col("error").alias("why")).distinct()
    chunks = pieces.where(F.col("seq").isNotNull()).select("content_digest", "seq", chunk_digest("text").alias("digest"), "text", "heading", "page")
    vectors = materialize(embed(chunks.select("content_digest", "seq", "text"), embedder).drop("text"))

    rejected = good.join(bad, "content_digest").select("path", F.col("why").alias("error")).unionByName(read.where(F.col("error").isNotNull()).select("path", "error"))
    rejected = materialize(rejected)
    place = disk.select("path", "mtime", "size")
    done = good.join(rejected.select("path"), "path", "left_anti").select("path", "content_digest").join(place, "path")
    moved = pairs.select(F.col("new_path").alias("path"), "content_digest").join(place, "path")
    stale = files.join(rejected.select("path"), "path", "left_semi").withColumn("status", F.lit("stale"))
    names = [f.name for f in FILES]
    rows = done.unionByName(moved).withColumn("status", F.lit("fresh")).select(*names).unionByName(stale.select(*names))
    gone = buckets.where(F.col("bucket") == D.MISSING).select("path").unionByName(pairs.select(F.col("old_path").alias("path")))
    index.replace_files(materialize(rows), chunks, vectors, removed=gone)

    counts = {r["bucket"]: r["count"] for r in buckets.groupBy("bucket").count().collect()}
    failed = [(r["path"], r["error"]) for r in rejected.orderBy("path").collect()]
    return Summary(counts.get(D.NEW, 0), counts.get(D.CHANGED, 0), counts.get(D.RENAMED, 0), counts.get(D.MISSING, 0), good.count() - fresh.count(), vectors.count(), failed)
