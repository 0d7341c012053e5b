"""k-mers of records that arrive as a stream: new ones, and counts by time with late records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.letters import from_number
from ..operators.kmers import counted_in_batches
from ..runtime import shared_dir

#: Fixed value: the state store that keeps its keys on disk, not in the executors' heap.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def new_kmers(records: DataFrame, k: int, both_strands: bool = True) -> DataFrame:
    """Each canonical k-mer (k <= 31) of a stream of ``seq`` when it comes first: c.

    The k-mers passed on so far are the state, dealt to the shuffle partitions by k-mer; a batch is compared with the state
    of its own k-mers only. A k-mer that is frequent in a batch leaves its task once. Null, empty and short
    texts give none, repeated records nothing new. Also takes a table, and is then its set of k-mers.
    """
    rows = counted_in_batches(records, k, both_strands=both_strands)
    return rows.select("number").dropDuplicates(["number"]).select(from_number("number", k).alias("c"))


def counts_by_time(records: DataFrame, k: int, at: str, width: str, late: str, both_strands: bool = True) -> DataFrame:
    """Occurrences of canonical k-mers (k <= 31) in windows of time: start, c, n.

    Records (``at``: timestamp, ``seq``) may be late by ``late``; a window comes out, and its state goes, once the newest
    record is further ahead. Later records for it are left out, as are those without a time.
    """
    rows = counted_in_batches(records.where(F.col(at).isNotNull()), k, at, both_strands)
    each = rows.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), "number").agg(F.sum("n").alias("n"))
    return each.select(F.col("w.start").alias("start"), from_number("number", k).alias("c"), "n")


def taken(stream: DataFrame, at: str | None = None) -> DataFrame:
    """Run a stream over all that has arrived, and read what it has passed on so far.

    Rows and progress are kept in the folder ``at`` (a new one in the shared folder if none is named): called again with
    the same stream and folder, only what has arrived since is processed, and lost executors or a lost driver change nothing.
    """
    spark = stream.sparkSession
    at = at or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        run = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start()
    finally:
        spark.conf.set(key, before)
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
