"""Session helpers shared by all operators: checkpoint folder, written stages, sizing."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of scanned files that one shuffle bucket of block rows should stand for.
BUCKET_BYTES = 4 << 20
#: Buckets that share a task, about.
BUCKETS_A_TASK = 2


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it.

    Only where ``spark.checkpoint.dir`` is unset and the master is a local one (tests, a laptop) a temporary folder is used; on a
    cluster that is an error, as each executor would write to a disk of its own.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def stage(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The table outlives lost executors; nothing is kept in executor memory.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def unsent(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is sorted and merged, so neither side goes to the driver to be broadcast.

    The optimizer takes the size of rows that are cut from texts, and of rows of a stage, from the compressed files that they come from. A text
    gives many times its own size, so it would broadcast what the driver can't hold.
    """
    return df.hint("merge")


def scanned_bytes(df: DataFrame) -> int:
    """Size of ``df``'s input as the optimizer knows it (the files' size for a plain scan)."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _measured_bytes(df: DataFrame) -> int:
    """Size of ``df``'s rows by a pass over them, for input whose size the optimizer doesn't know (rows from an RDD, say)."""
    text = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    row = sum(text, F.lit(8 * len(df.columns)).cast("bigint"))
    return int(df.select(row.alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


def buckets_for(df: DataFrame, bytes_each: int = BUCKET_BYTES) -> int:
    """How many hash buckets keep each bucket of ``df``'s rows small enough for one task."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = scanned_bytes(df)
    if size > 1 << 50:
        size = _measured_bytes(df)
    return max(least, math.ceil(size / bytes_each))


def by_bucket(df: DataFrame, buckets: int, *keys: str):
    """``df`` grouped by ``keys``, in as many tasks as so many buckets need; adaptive execution doesn't put them together again."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, math.ceil(buckets / BUCKETS_A_TASK)), *keys).groupBy(*keys)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out if the scan has fewer partitions than the cluster has cores.

    One Parquet file with one row group is one task; tables of a real size never come here. Streams stay as they are.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, 4) else df


def given_back() -> None:
    """In a Python worker: memory of arrays that are no longer used goes back to the system. Workers outlive their tasks and would keep it, beside the heap of their executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
