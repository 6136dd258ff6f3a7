"""Micro-batch ingest: a stream of articles is merged into a keyed store, the first of each content hash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.dialect import Spark
from newsloom.operators.text import content_hash_sql


def folder_of(spark: SparkSession, path: str) -> tuple[str, str]:
    """(folder, pattern of names) by which a stream reads a table: it reads folders, so a single file is named in its own."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return path, "*.parquet"
    where, name = path.rsplit("/", 1)
    return where, name


class ArticleStore:
    """Articles by content hash under one folder in shared storage. A batch appends the keys that no earlier batch has, under its own
    number, so that a batch that is run again replaces what it wrote; with the checkpoint beside it a stopped stream resumes.

    Columns are content_hash, article_id and what else the articles have. Of a key's rows in one batch the one with the least article_id
    is taken, null last. Later rows of a stored key are not appended, but `filled` takes from them what the stored one lacks.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def _batches(self, table: str, below: int | None = None) -> DataFrame:
        names = []
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if fs.exists(path):
            names = [f.getPath() for f in fs.listStatus(path) if below is None or int(f.getPath().getName()) < below]
        done = [str(x) for x in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
        schema = f"content_hash string, {self.schema}"
        return self.spark.read.schema(schema).parquet(*done) if done else self.spark.createDataFrame([], schema)

    def articles(self) -> DataFrame:
        return self._batches("articles")

    def merge(self, batch: DataFrame, number: int) -> None:
        """batch: the store's columns but the hash, with title, content and url among them."""
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema.fields]
        hashed = batch.withColumn("content_hash", F.expr(content_hash_sql(Spark()))).select("content_hash", *names)
        at = f"{self.root}/offered/{number:09d}"
        hashed.write.mode("overwrite").parquet(at)
        hashed = self.spark.read.schema(f"content_hash string, {self.schema}").parquet(at)
        stored = self._batches("articles", number).select("content_hash")
        one = F.min_by(F.struct(*names), F.struct(F.isnull("article_id"), "article_id")).alias("x")
        new = hashed.join(stored, "content_hash", "left_anti").groupBy("content_hash").agg(one).select("content_hash", "x.*")
        new.write.mode("overwrite").parquet(f"{self.root}/articles/{number:09d}")

    def filled(self, *columns: str) -> DataFrame:
        """The articles, where nulls of these columns are taken from the earliest offered row of the key that has them, by article_id."""
        offered = self._batches("offered").groupBy("content_hash").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("article_id"))).alias(f"_{c}") for c in columns])
        out = self.articles().join(offered, "content_hash")
        for c in columns:
            out = out.withColumn(c, F.coalesce(c, f"_{c}"))
        return out.drop(*[f"_{c}" for c in columns])

    def follow(self, stream: DataFrame, prepared: Callable[[DataFrame], DataFrame]) -> None:
        """Merges what a stream has by now."""
        run = lambda batch, number: self.merge(prepared(batch), number)
        stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
