"""Independent reports: greedy clusters of a retrieved pool, each led by its first article."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import vocabulary as V
from newsloom.functions.dialect import Spark
from newsloom.operators.text import wire_sql

#: Word similarity beyond which a text counts as a reprint.
REPRINT = 0.65


def _words(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(text), r"[^a-z0-9 \t\n\x0b\x0c\r]", "")
    return F.array_distinct(F.filter(F.split(plain, r"[ \t\n\x0b\x0c\r]+"), lambda w: F.length(w) > 3))


def _reason(a: Column, b: Column) -> Column:
    """Why a depends on b; null if it does not."""
    both = F.size(F.array_intersect(a["words"], b["words"]))
    alike = (F.size(a["words"]) > 0) & (F.size(b["words"]) > 0) & (both > REPRINT * (F.size(a["words"]) + F.size(b["words"]) - both))
    return F.when(a["article_id"] == b["article_id"], "same article").when(a["wire"] == b["wire"], "same wire service").when((a["outlet"] == b["outlet"]) & (a["outlet"] != ""), "same outlet").when(alike, "same text")


def independent_clusters(pool: DataFrame, wires: dict[str, str] = V.WIRES) -> DataFrame:
    """(article_id, leader_id, reason) of a pool (article_id, place, title, summary, outlet): an article joins the first leader, by
    place, that it depends on, and else leads a cluster of its own; leaders have reason null.

    The order decides the clusters, so one task folds the pool. It must be a bounded one, such as the lanes' union with its limit
    a lane. Null titles, summaries and outlets are empty; ties of place go by article_id; an empty pool gives no rows.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = pool.withColumn("said", F.concat_ws(" ", text("title"), text("outlet"), F.substring(text("summary"), 1, 300)))
    one = F.struct(
        F.col("place"),
        F.col("article_id"),
        F.expr(wire_sql(Spark(), "said", wires)).alias("wire"),
        F.lower(F.trim(text("outlet"))).alias("outlet"),
        _words(F.concat_ws(" ", text("title"), text("summary"))).alias("words"),
    )
    listed = rows.select(one.alias("x")).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    depends = lambda a, b: _reason(a, b).isNotNull()
    leaders = F.aggregate("xs", F.slice("xs", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: depends(x, y)), acc).otherwise(F.concat(acc, F.array(x))))
    led = listed.withColumn("leaders", leaders).select("leaders", F.explode("xs").alias("x"))
    led = led.withColumn("y", F.get(F.filter("leaders", lambda y: depends(F.col("x"), y)), 0))
    own = F.col("x.article_id") == F.col("y.article_id")
    return led.select(F.col("x.article_id").alias("article_id"), F.col("y.article_id").alias("leader_id"), F.when(~own, _reason(F.col("x"), F.col("y"))).alias("reason"))
