"""Helpers that the operators of this subpackage share: shared scratch tables and dedup of labels."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def lower_ascii(col):
    """Lower-cases A-Z only."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where the setting is missing (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.startswith("local"):
            found = getattr(spark, "_folioworks_tmp", None)
            if not found:
                found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
                spark._folioworks_tmp = found
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found


class Scratch:
    """Tables written to the shared folder, to cut lineage; each can be dropped when no later step reads it.

    A written table survives the loss of executors and is read again by any of them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/folioworks-{name}-{uuid.uuid4().hex}"
        self.step = 0

    def save(self, df: DataFrame, by: str | None = None) -> DataFrame:
        self.step += 1
        path = f"{self.root}/{self.step}"
        df.write.parquet(path)
        # what shuffles of finished steps left on the executors' disks goes once the driver has collected its garbage
        gc.collect()
        self.spark._jvm.System.gc()
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that save() returned."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in frames:
            path = getattr(df, "_scratch_path", None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def most_frequent(counts: DataFrame, column: str, most: int) -> DataFrame:
    """The rows of largest count, at most ``most`` of them and all above one count.

    The limit is found from a histogram of logarithms (a few hundred rows), so no
    task sends its own best rows to the driver.
    """
    level = F.floor(F.log2(F.col(column)) * 8).cast("int")
    left, least = most, None
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.level):
        left -= r.n
        if left < 0:
            break
        least = r.level
    return counts.where(level >= least) if least is not None else counts.limit(0)
