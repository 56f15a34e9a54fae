"""Index maintenance: change detection, renames, references, orphans, lookups."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.operators import detect as D
from tessel.operators.fetch import chunks_by_prefix, neighbors
from tessel.operators.search import content_refs
from tessel.queries.registry import register
from tessel.runtime import table

_NEWEST = """
newest AS (SELECT path, mtime, size, content_digest FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY observed_at DESC, arrived_at DESC, scan_id DESC) AS r FROM scans) WHERE r = 1),
disk AS (SELECT * FROM newest WHERE mtime IS NOT NULL),
b AS (SELECT coalesce(d.path, f.path) AS path, CASE WHEN d.path IS NULL THEN 'missing'
   WHEN NOT lower(regexp_extract(d.path, '(\\.[^./]+)$', 1)) IN ('.txt', '.md', '.markdown', '.docx', '.pdf') THEN 'skipped' WHEN f.path IS NULL THEN 'new'
   WHEN f.mtime IS NOT DISTINCT FROM d.mtime AND f.size IS NOT DISTINCT FROM d.size AND f.status = 'fresh' THEN 'unchanged' ELSE 'changed' END AS bucket,
   coalesce(f.status = 'stale', false) AS was_stale, d.content_digest AS dd, f.content_digest AS fd
  FROM disk d FULL OUTER JOIN files f ON f.path = d.path)"""
_PAIRS = """
o AS (SELECT fd AS content_digest, path AS old_path, row_number() OVER (PARTITION BY fd ORDER BY path) AS nth FROM b WHERE bucket = 'missing'),
n AS (SELECT dd AS content_digest, path AS new_path, row_number() OVER (PARTITION BY dd ORDER BY path) AS nth FROM b WHERE bucket = 'new' AND dd IS NOT NULL),
pairs AS (SELECT content_digest, old_path, new_path FROM o JOIN n USING (content_digest, nth))"""


def newest_observations(scans: DataFrame) -> DataFrame:
    """(path, mtime, size, content_digest) of each path's newest observation, gone ones included."""
    order = F.struct("observed_at", "arrived_at", "scan_id")
    newest = scans.groupBy("path").agg(F.max_by(F.struct("mtime", "size", "content_digest"), order).alias("s"))
    return newest.select("path", "s.*")


def _buckets(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    disk = newest_observations(table(spark, folder, "scans")).where(F.col("mtime").isNotNull())
    files = table(spark, folder, "files")
    return disk, files, D.classify(disk, files)


def _pairs(disk: DataFrame, files: DataFrame, buckets: DataFrame) -> DataFrame:
    new = buckets.where(F.col("bucket") == D.NEW).join(disk.select("path", "content_digest"), "path")
    missing = buckets.where(F.col("bucket") == D.MISSING).join(files.select("path", "content_digest"), "path")
    return D.rename_pairs(new, missing)


@register(f"WITH {_NEWEST} SELECT path, bucket, was_stale FROM b")
def classify_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Every path's bucket."""
    return _buckets(spark, folder)[2]


@register(f"WITH {_NEWEST}, {_PAIRS} SELECT content_digest, old_path, new_path FROM pairs")
def rename_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Missing and new paths of equal content."""
    return _pairs(*_buckets(spark, folder))


@register(f"""WITH {_NEWEST}, {_PAIRS}
SELECT count(CASE WHEN bucket = 'new' AND NOT rn THEN 1 END) AS new, count(CASE WHEN bucket = 'changed' THEN 1 END) AS changed, count(CASE WHEN bucket = 'unchanged' THEN 1 END) AS unchanged,
 count(CASE WHEN bucket = 'missing' AND NOT ro THEN 1 END) AS missing, count(CASE WHEN rn THEN 1 END) AS renamed, count(CASE WHEN bucket = 'skipped' THEN 1 END) AS skipped,
 count(CASE WHEN (bucket = 'new' AND NOT rn) OR bucket = 'changed' OR (bucket = 'missing' AND NOT ro) OR rn THEN 1 END) AS pending,
 count(CASE WHEN bucket = 'changed' OR (bucket = 'missing' AND NOT ro) THEN 1 END) > 0 AS dirty
FROM (SELECT *, path IN (SELECT new_path FROM pairs) AS rn, path IN (SELECT old_path FROM pairs) AS ro FROM b)""")
def survey_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of all buckets after pairing renames."""
    disk, files, buckets = _buckets(spark, folder)
    return D.summary(D.with_renames(buckets, _pairs(disk, files, buckets)))


@register("""SELECT content_digest, len(list(DISTINCT path || ':' || status)) AS refs, bool_or(status = 'stale') AS stale,
 coalesce(min(CASE WHEN status = 'fresh' THEN {'steps': string_split(path, '/'), 'path': path} END).path, min({'steps': string_split(path, '/'), 'path': path}).path) AS primary_path FROM files GROUP BY content_digest""")
def refs_primary(spark: SparkSession, folder: str) -> DataFrame:
    """Each content's paths: how many, whether any is stale, and the primary one."""
    refs = content_refs(table(spark, folder, "files"))
    return refs.select("content_digest", F.size("refs").cast("long").alias("refs"), "stale", F.col("primary").alias("primary_path"))


@register(f"""WITH {_NEWEST}, live AS (SELECT DISTINCT fd FROM b WHERE bucket <> 'missing' AND fd IS NOT NULL)
SELECT content_digest, count(*) AS chunks, sum(length(text)) AS characters FROM chunks WHERE content_digest NOT IN (SELECT fd FROM live) GROUP BY content_digest""")
def orphan_gc(spark: SparkSession, folder: str) -> DataFrame:
    """Contents whose last path is gone, with what would be collected."""
    _, files, buckets = _buckets(spark, folder)
    live = files.join(buckets.where(F.col("bucket") != D.MISSING).select("path"), "path", "left_semi").select("content_digest").distinct()
    dead = table(spark, folder, "chunks").join(live, "content_digest", "left_anti")
    return dead.groupBy("content_digest").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.char_length("text").cast("long")).alias("characters"))


@register(f"""WITH {_NEWEST}, {_PAIRS}, kept AS (SELECT * FROM files WHERE path NOT IN (SELECT old_path FROM pairs)),
done AS (SELECT p.new_path AS path, p.content_digest, d.mtime, d.size, 'fresh' AS status FROM pairs p JOIN disk d ON d.path = p.new_path)
SELECT path, content_digest, mtime, size, status FROM done UNION ALL SELECT path, content_digest, mtime, size, status FROM kept WHERE path NOT IN (SELECT path FROM done)""")
def upsert_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files table after re-pointing renamed paths: old rows go, new ones replace those of equal path."""
    disk, files, buckets = _buckets(spark, folder)
    pairs = _pairs(disk, files, buckets)
    done = pairs.join(disk.select(F.col("path").alias("new_path"), "mtime", "size"), "new_path").select(F.col("new_path").alias("path"), "content_digest", "mtime", "size", F.lit("fresh").alias("status"))
    kept = files.join(pairs.select(F.col("old_path").alias("path")), "path", "left_anti").join(done.select("path"), "path", "left_anti")
    return kept.select("path", "content_digest", "mtime", "size", "status").unionByName(done)


@register(f"WITH {_NEWEST} SELECT path, content_digest, CASE WHEN path IN (SELECT path FROM b WHERE bucket IN ('changed', 'missing')) THEN 'stale' ELSE status END AS status FROM files")
def mark_stale(spark: SparkSession, folder: str) -> DataFrame:
    """The files table with changed and missing paths marked stale."""
    _, files, buckets = _buckets(spark, folder)
    b = buckets.where(F.col("bucket").isin(D.CHANGED, D.MISSING)).select("path", F.lit(True).alias("is_stale"))
    return files.join(b, "path", "left").select("path", "content_digest", F.when(F.col("is_stale"), "stale").otherwise(F.col("status")).alias("status"))


PREFIX = "a1"


@register(f"""WITH fr AS (SELECT content_digest, count(DISTINCT path || ':' || status) AS refs FROM files GROUP BY content_digest)
SELECT chunk_id, digest, refs FROM chunks JOIN fr USING (content_digest) WHERE starts_with(digest, 'sha256:{PREFIX}')""")
def prefix_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks by the beginning of their digest, with their number of paths."""
    found = chunks_by_prefix(table(spark, folder, "chunks"), table(spark, folder, "files"), PREFIX)
    return found.select("chunk_id", "digest", F.size("refs").cast("long").alias("refs"))


@register("""SELECT a.chunk_id AS anchor, b.chunk_id, b.seq - a.seq AS distance FROM chunks a JOIN chunks b
 ON a.content_digest = b.content_digest AND coalesce(a.heading, '') = coalesce(b.heading, '') AND b.seq BETWEEN a.seq - 2 AND a.seq + 2 AND a.seq <> b.seq""")
def neighbor_window(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk's neighbours within two, never across headings."""
    chunks = table(spark, folder, "chunks")
    return neighbors(chunks, chunks, 2)


@register("SELECT f.path, f.content_digest, f.mtime, f.size, f.status, coalesce(c.n, 0) AS chunks FROM files f LEFT JOIN (SELECT content_digest, count(*) AS n FROM chunks GROUP BY content_digest) c USING (content_digest)")
def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """All files with the number of their chunks."""
    n = table(spark, folder, "chunks").groupBy("content_digest").agg(F.count(F.lit(1)).alias("chunks"))
    return table(spark, folder, "files").join(n, "content_digest", "left").select("path", "content_digest", "mtime", "size", "status", F.coalesce("chunks", F.lit(0)).alias("chunks")).orderBy("path")


@register("SELECT content_digest, chunk_id, digest, seq FROM (SELECT *, row_number() OVER (PARTITION BY content_digest ORDER BY seq, chunk_id) AS r FROM chunks) WHERE r = 1")
def first_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Each content's first chunk, by a grouped minimum rather than a sort of whole contents."""
    first = table(spark, folder, "chunks").groupBy("content_digest").agg(F.min_by(F.struct("chunk_id", "digest", "seq"), F.struct("seq", "chunk_id")).alias("c"))
    return first.select("content_digest", "c.*")


@register("SELECT v.chunk_id, v.content_digest, v.seq FROM chunk_vectors v ANTI JOIN (SELECT DISTINCT content_digest FROM files) f ON v.content_digest = f.content_digest")
def orphan_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors whose content no path holds."""
    live = table(spark, folder, "files").select("content_digest").distinct()
    return table(spark, folder, "chunk_vectors").join(live, "content_digest", "left_anti").select("chunk_id", "content_digest", "seq")


@register("SELECT v.chunk_id, v.content_digest, v.seq FROM chunk_vectors v ANTI JOIN (SELECT DISTINCT content_digest FROM files WHERE status = 'fresh') f ON v.content_digest = f.content_digest")
def orphan_vectors_stale(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors that would be collected if all stale paths went."""
    live = table(spark, folder, "files").where(F.col("status") == "fresh").select("content_digest").distinct()
    return table(spark, folder, "chunk_vectors").join(live, "content_digest", "left_anti").select("chunk_id", "content_digest", "seq")


@register("""WITH o AS (SELECT content_digest, path AS old_path, row_number() OVER (PARTITION BY content_digest ORDER BY path) AS nth FROM files),
n AS (SELECT content_digest, 'moved/' || reverse(path) AS new_path, row_number() OVER (PARTITION BY content_digest ORDER BY 'moved/' || reverse(path)) AS nth FROM files)
SELECT content_digest, old_path, new_path FROM o JOIN n USING (content_digest, nth)""")
def rename_pairs_moved(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs after every file has got another name: contents that several paths hold are paired in the order of their paths."""
    old = table(spark, folder, "files").select("path", "content_digest")
    return D.rename_pairs(old.select(F.concat(F.lit("moved/"), F.reverse("path")).alias("path"), "content_digest"), old)


@register("SELECT DISTINCT f.path, f.content_digest, f.status FROM files f JOIN scans s ON s.path = f.path WHERE s.scan_id = (SELECT max(scan_id) FROM scans)")
def file_by_path(spark: SparkSession, folder: str) -> DataFrame:
    """The index's records of the paths that the last walk saw."""
    scans = table(spark, folder, "scans")
    last = scans.agg(F.max("scan_id").alias("scan_id"))
    seen = scans.join(F.broadcast(last), "scan_id").select("path").distinct()
    return table(spark, folder, "files").join(seen, "path", "left_semi").select("path", "content_digest", "status")


@register("SELECT s.content_digest, count(DISTINCT s.path) AS paths, bool_or(c.content_digest IS NOT NULL) AS known FROM scans s LEFT JOIN (SELECT DISTINCT content_digest FROM chunks) c ON c.content_digest = s.content_digest WHERE s.content_digest IS NOT NULL GROUP BY s.content_digest")
def content_by_digest(spark: SparkSession, folder: str) -> DataFrame:
    """Contents that walks have read, and whether the index has chunks of them."""
    known = table(spark, folder, "chunks").select("content_digest", F.lit(True).alias("k")).distinct()
    read = table(spark, folder, "scans").where(F.col("content_digest").isNotNull()).select("content_digest", "path").distinct()
    paths = read.groupBy("content_digest").agg(F.count(F.lit(1)).alias("paths"))
    return paths.join(known, "content_digest", "left").select("content_digest", "paths", F.coalesce("k", F.lit(False)).alias("known"))
