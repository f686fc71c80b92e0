"""Folders that all executors see, staged tables and table loading."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: Rows of whole texts or shingle sets that go to Python at a time, in staged jobs: it bounds what a worker holds.
_BATCH, BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
#: Bits of the largest sieve, 8 MB: the bound of what sift sends to the driver and to the executors.
SIEVE_BITS = 26


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only where that is unset and the master is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="quarrymill-")
    return _OWN[app]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/quarrymill/{tag}-{uuid.uuid4().hex}"


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it again."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    given = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(BATCH, int(given)) if int(given) > 0 else BATCH))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_BATCH, given)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession, wait: float = 0) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs; executors do so a moment later, in ``wait`` seconds."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(wait)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sieve(frame: DataFrame, column: str, ids: DataFrame) -> Column:
    """A condition on rows of ``frame``: true where ``column`` is in ``ids(column)`` and for a few other rows, false
    for the rest and for null.

    For joins of whole texts with few documents: it spares the shuffle of the other texts. Ids are hashed into a
    bitmap of 2**SIEVE_BITS bits at most, whatever their number; with more ids, more other rows pass.
    """
    spark = frame.sparkSession
    size = 1 << min(SIEVE_BITS, max(10, (16 * ids.count()).bit_length()))
    spot = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(size))
    cells = ids.where(F.col(column).isNotNull()).select(spot.alias("_spot"))
    cells = cells.groupBy(F.shiftright("_spot", 5).cast("int").alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_spot & 31 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(size // 32, np.uint32)
    bitmap[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy().astype(np.uint32)
    sent = spark.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def passes(spots: pd.Series) -> pd.Series:
        at = spots.fillna(0).to_numpy().astype(np.int64)
        return pd.Series(((sent.value[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) == 1) & spots.notna().to_numpy())

    return passes(F.when(F.col(column).isNotNull(), spot))


def sift(frame: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows of ``frame`` whose ``column`` is in ``ids(column)``, and a few others (see sieve)."""
    return frame.where(sieve(frame, column, ids))
