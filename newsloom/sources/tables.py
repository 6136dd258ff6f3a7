"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`. Only where driver and executors are one process (tests) may it be unset: it is then a folder under /tmp. On a
    cluster such a folder would not be shared, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    return found.rstrip("/")


class Scratch:
    """Parquet tables that cut lineage and outlive lost executors; they go when the JVM ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once and read it back."""
        at = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)
