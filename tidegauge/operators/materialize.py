"""Cutting lineage in the shared checkpoint folder, and broadcasts of a counted size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow table that may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 50_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder. Only local mode, where driver and executors are one process, may go without one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidegauge-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, materialised once; later reads don't compute it again and survive lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """df with its columns computed once a row: no filter above it is pushed below and no expression above it takes theirs in.

    A filter over derived columns would otherwise go down to the scan with their whole expressions written out wherever it
    names them, and rows that pass compute them again. All columns are computed, also those that nobody reads.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def store(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the checkpoint folder, for wide tables whose readers take few columns."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder by the file system that its path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a checkpointed table for broadcast if its rows, counted up to the limit, allow it."""
    return F.broadcast(df) if len(df.select(F.lit(1)).take(rows + 1)) <= rows else df
