"""Helpers shared by the training-data operators: word splitting, scratch tables, bounded broadcasts."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of `[^\x20\x09-\x0D]+` words.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"

#: The base columns of `documents`; stages give back whatever columns they were given.
PREFIX = "_nl_"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`. Only where driver and executors are one process (tests)
    may it be unset, and one under /tmp is set; on a cluster such a folder would not be shared, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Parquet tables in the shared folder. They cut lineage, outlive lost executors and go when the JVM ends, or by drop()."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        path = self._path(self.root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def _path(self, at: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(at)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once and read it back."""
        at = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self._path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """array<string> of the `[^\\x20\\x09-\\x0D]+` words; null and empty texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z in words that are compared with ASCII phrases. lower() is far faster than translate() and differs there
    only where U+212A or U+0130 would become ASCII letters, so texts that hold those take the slow way."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(text.rlike("[Kİ]"), F.translate(text, upper, upper.lower())).otherwise(F.lower(text))


def unit_hash(seed: int, *cols: Column) -> Column:
    """A uniform double in [0, 1) from a seeded 53-bit hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") / F.lit(float(1 << 53))


def broadcast_if(df: DataFrame, rows: int, most: int) -> DataFrame:
    """broadcast(df) if its counted rows are at most `most`; else df, for a shuffled join that AQE may split."""
    return F.broadcast(df) if rows <= most else df


def bounded_sample(labels: DataFrame, ids: str, most: int, seed: int) -> DataFrame:
    """At most about `most` rows, chosen by a hash of `ids`; all of them when there are no more. The bound is a parameter of
    the classifiers that are fitted on labelled rows."""
    n = labels.count()
    if n <= most:
        return labels
    return labels.where(unit_hash(seed, F.col(ids)) < F.lit(0.98 * most / n))


def training_fold(ids: Column) -> Column:
    """False on held-out rows: crc32 of the id as text is a multiple of 5."""
    return F.crc32(ids.cast("string").cast("binary")) % 5 != 0


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """At most so many rows in an Arrow batch, since texts may be long. Plans run after their functions return, so the session keeps
    the setting; a smaller one of the caller's own stays."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def small_messages(spark: SparkSession, size: str = "4m") -> None:
    """At most so many bytes in an Arrow batch, besides the bound on rows: pairs of long texts else fill hundreds of megabytes, in the
    JVM and in its Python worker at once. The session keeps the setting, as above."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def where_computed(df: DataFrame, cond: Column) -> DataFrame:
    """df.where(cond) on columns that cost much to compute. A plain filter would be pushed down through their projection, and each
    mention of such a column would then be computed again, within lambdas even once an element; it is not pushed past a column
    that is not deterministic."""
    return df.withColumn("_nl_row", F.monotonically_increasing_id()).where((F.col("_nl_row") >= 0) & cond).drop("_nl_row")
