"""Processing of new and changed records only."""

from pyspark.sql import DataFrame, SparkSession

from tessel.operators.incremental import to_process
from tessel.queries.registry import register
from tessel.runtime import table


@register("""
SELECT n.path FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY observed_at DESC, arrived_at DESC, scan_id DESC) AS r FROM scans) n
LEFT JOIN files f ON n.path = f.path
WHERE r = 1 AND n.mtime IS NOT NULL
  AND (f.path IS NULL OR f.mtime IS DISTINCT FROM n.mtime OR f.size IS DISTINCT FROM n.size OR f.status = 'stale')
""")
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Paths that the next run has to process."""
    return to_process(table(spark, folder, "scans"), table(spark, folder, "files"), table(spark, folder, "sync_runs"))
