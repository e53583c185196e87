"""Intermediate tables in the folder that all executors share, where a plan would otherwise grow with each analysis that reads it."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the context's checkpoint folder; a folder of this machine only in local mode, refused on a cluster, where each executor would write to its own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        elif spark.sparkContext.master.startswith("local"):
            base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def small(df: DataFrame, most: int = 500_000) -> DataFrame:
    """df, settled, to be broadcast if it has at most so many rows; its rows are counted, not guessed."""
    df = settled(df)
    return F.broadcast(df) if df.count() <= most else df


def settled(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks(df: DataFrame, rows: int, most: int = 1_000_000) -> int:
    """Partitions of so many rows that none has much more than `most` of them."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / most))
