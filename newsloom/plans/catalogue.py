"""Every registered query of the news engine with its oracle: one text in two dialects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsloom.functions.dialect import Duck, Spark
from newsloom.operators import editing, intelligence, newsrules, relational, retrieval, text
from newsloom.plans import native

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
BUILDERS = [*relational.QUERIES, *text.QUERIES, *retrieval.QUERIES, *intelligence.QUERIES, *newsrules.QUERIES, *editing.QUERIES]


def register(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Temporary views of the tables that the text may name."""
    for t in TABLES:
        if t in sql:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def run_sql(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, sql)
        return spark.sql(sql)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {b.__name__: run_sql(b(Spark())) for b in BUILDERS} | native.queries()


def oracle_sql() -> dict[str, str]:
    return {b.__name__: b(Duck()) for b in BUILDERS} | native.oracle_sql()
