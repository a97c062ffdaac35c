"""Tables that a job writes for its own later steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; on one machine without that setting (tests) a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(spark, "_folioworks_scratch"):
        spark._folioworks_scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return spark._folioworks_scratch


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once and read again: later steps read the table, whatever executors are lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/folioworks-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
