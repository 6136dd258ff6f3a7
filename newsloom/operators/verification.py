"""Verdicts on claims by their reports: contradictions by name, independent clusters of support, kinds of sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import vocabulary as V
from newsloom.functions.dialect import Spark
from newsloom.operators import clusters
from newsloom.operators.text import hierarchy_sql, wire_sql

#: Reports of a claim up to which its clusters are folded in one go.
GROUP = 500


def marked(reports: DataFrame, wires: dict[str, str] = V.WIRES) -> DataFrame:
    """claim_id, and x: what the independence of a report and its source's level go by. reports: (claim_id, article_id, published_at, title,
    summary, outlet, kind, url); nulls are empty, and null times come first."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = reports.withColumn("said", F.concat_ws(" ", text("title"), text("outlet"), F.substring(text("summary"), 1, 300)))
    return rows.select(
        "claim_id",
        F.struct(
            "published_at",
            "article_id",
            F.expr(wire_sql(Spark(), "said", wires)).alias("wire"),
            F.lower(F.trim(text("outlet"))).alias("outlet"),
            clusters._words(F.concat_ws(" ", text("title"), text("summary"))).alias("words"),
            F.expr(hierarchy_sql(Spark(), "coalesce(outlet, '')", "coalesce(kind, '')", "coalesce(url, '')")).alias("level"),
        ).alias("x"),
    )


def _depends(a: Column, b: Column) -> Column:
    return clusters._reason(a, b).isNotNull()


def leaders(rows: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(claim_id, x) of the reports that lead a cluster: each, by time, that depends on no earlier leader of its claim.

    A claim may have any number of reports, so they are not gathered: a round takes the first report left of every claim as a leader
    and drops what depends on it, at least the rest of its outlet. Claims with GROUP reports or fewer are folded at once.
    """
    rows, out, k = keep(rows, "reports-0"), [], 0
    while True:
        sizes = rows.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("first"))
        sizes = keep(sizes, f"sizes-{k}")
        few = rows.join(sizes.where(F.col("n") <= GROUP).select("claim_id"), "claim_id")
        listed = few.groupBy("claim_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
        fold = F.aggregate("xs", F.slice("xs", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: _depends(x, y)), acc).otherwise(F.concat(acc, F.array(x))))
        out.append(keep(listed.select("claim_id", F.explode(fold).alias("x")), f"led-{k}"))
        many = sizes.where(F.col("n") > GROUP)
        if not many.limit(1).count():
            break
        out.append(many.select("claim_id", F.col("first").alias("x")))
        left = rows.join(many.select("claim_id", "first"), "claim_id").where(~_depends(F.col("x"), F.col("first")))
        k += 1
        rows = keep(left.select("claim_id", "x"), f"reports-{k}")
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found


def verify(claims: DataFrame, support: DataFrame, against: DataFrame, keep: Callable[[DataFrame, str], DataFrame], wires: dict[str, str] = V.WIRES) -> DataFrame:
    """(claim_id, status, badge, independent_sources, provenance) of every claim_id of claims. Reports against a claim contradict it, by
    the name of the first; else a primary or scientific source or two independent clusters verify it; clusters that are all public
    signals never do. Nothing is called false. support and against: columns of marked(); empty ones leave claims unverified.
    Repeated reports count once."""
    level = F.col("x.level")
    led = leaders(marked(support, wires).distinct(), keep).groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("clusters"), F.bool_or(level.isin("PRIMARY SOURCE", "SCIENTIFIC_TECHNICAL")).alias("official"), F.bool_and(level == "PUBLIC_SIGNAL").alias("social")
    )
    named = F.min_by(F.coalesce("outlet", F.lit("Independent Reporting")), F.struct("published_at", "article_id"))
    denied = against.select("claim_id", "article_id", "published_at", "outlet").distinct().groupBy("claim_id").agg(named.alias("by"), F.count(F.lit(1)).alias("denials"))
    df = claims.select("claim_id").distinct().join(led, "claim_id", "left").join(denied, "claim_id", "left")
    contradicted, social = F.col("denials").isNotNull(), F.coalesce("social", F.lit(False))
    official, n = F.coalesce("official", F.lit(False)), F.coalesce("clusters", F.lit(0))
    verified = official | (n >= 2)
    return df.select(
        "claim_id",
        F.when(contradicted, "CONTRADICTED").when(social, "UNVERIFIED").when(verified, "VERIFIED").otherwise("UNVERIFIED").alias("status"),
        F.when(contradicted, F.concat(F.lit("CONTRADICTED BY "), F.upper("by"))).when(social, "UNVERIFIED (PUBLIC SIGNAL ONLY)").when(verified, "VERIFIED").otherwise("UNVERIFIED").alias("badge"),
        F.when(contradicted, F.col("denials")).otherwise(n).alias("independent_sources"),
        F.when(contradicted, "NEWS REPORTING").when(social, "PUBLIC SIGNAL").when(official, "PRIMARY SOURCE").otherwise("NEWS REPORTING").alias("provenance"),
    )
