"""Tables that are written once in the middle of a plan, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a session in one process without it gets a temporary folder, a cluster without it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidewater-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tidewater/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet and read again: what has been computed once, such as row numbers, holds for all who read it."""
    spark = df.sparkSession
    names = [f"c{i}" for i in range(len(df.columns))]
    path = fresh_path(spark)
    df.toDF(*names).write.parquet(path)
    return spark.read.schema(df.toDF(*names).schema).parquet(path).toDF(*df.columns)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt to as many tasks as a shuffle has: a small file is read by one or two tasks, which its words or hits would outgrow.

    The number is given, so partitions are not put together again by their small size before the rows grow.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *keys)
