"""Session helpers: shared folder, lineage cuts, partition counts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made_here: list[str] = []


@atexit.register
def _drop_local() -> None:
    for path in _made_here:
        shutil.rmtree(path, ignore_errors=True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as named in spark.checkpoint.dir.

    Only where that setting is absent (tests, a single machine) is a temporary
    folder made and set as the checkpoint folder.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tessel-")
    _made_here.append(made)
    sc.setCheckpointDir(f"file://{made}")
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder, which goes when the Python process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    try:
        fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(hadoop_path)
        fs.deleteOnExit(hadoop_path)
    except Exception:  # a file system without delete-on-exit keeps the folder
        pass
    return path


def materialize(df: DataFrame) -> DataFrame:
    """df written once as a table in the shared folder, and read again.

    Cuts the lineage: lost executors re-read the files. Columnar, so later
    readers prune columns. The files go when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{scratch(spark, 'table')}/rows"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of `folder`."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bounded_sample(df: DataFrame, key: str, most: int, total: int | None = None) -> DataFrame:
    """At most `most` rows, those with the smallest hash of the key: the same rows whatever the partitions.

    Rows far from the smallest hashes are filtered out first, so that what the
    tasks send to the driver is bounded by about twice the sample, not by a
    sample for each partition.
    """
    total = df.count() if total is None else total
    spread = 1 << 30
    mark = F.pmod(F.xxhash64(key), F.lit(spread))
    if total > 2 * most:
        df = df.where(mark < int(spread * (1.5 * most + 50) / total))
    return df.orderBy(mark, key).limit(most)


def spread(rows: DataFrame) -> DataFrame:
    """A scan's rows on all cores, where the files give fewer partitions than there are cores.

    For costly work on tables of a file or two. Larger tables have more
    partitions than cores and are left as they are, without a shuffle.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return rows
    return rows.repartition(cores)
