"""Mixing sources to target weights: repetition rates per source, then floor(rate) copies plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.common import Scratch, broadcast_if, read_table

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
SEED = 20_240_101
#: Seeds tried for each source.
DRAWS = 16
#: Sources up to which the rate table (one row each) is broadcast; beyond it the join is shuffled and AQE splits hot sources.
MOST_BROADCAST = 100_000


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size, target, rate), a row per source, from rows (source, size).

    A target is min(cap * source_size, level * weight). The level is the water level at which the targets add up to all sizes:
    with sources sorted by cap * source_size / weight, those before the first that the level of the rest doesn't fill are
    capped. That is the fixed point of resharing the excess by weight. The weights go by the sources' global order, so the windows sort
    one row of some 50 bytes per source in one task: fit for up to some ten million sources, however many documents they have.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    per = per.withColumn("weight", weight).withColumn("most", cap * F.col("source_size").cast("double"))
    ratio = F.col("most") / F.col("weight")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = Window.orderBy(ratio, F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything)
    rest = F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing))
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / rest
    per = per.withColumn("open", ratio > level).withColumn("level", level)
    first = F.min_by(F.col("level"), F.when(F.col("open"), ratio)).over(everything)
    per = per.withColumn("water", first).drop("open", "level")
    target = F.least(F.col("most"), F.coalesce(F.col("water") * F.col("weight"), F.col("most")))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(cap), target / F.col("source_size"))).otherwise(0.0)
    return per.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def copies(rate: Column, seed: Column, ids: Column) -> Column:
    """floor(rate) plus one hash-seeded Bernoulli copy with probability equal to the fraction."""
    whole = F.floor(rate)
    return whole + (F.shiftrightunsigned(F.xxhash64(seed, ids), 11) / F.lit(float(1 << 53)) < rate - whole).cast("long")


def rate_table(sizes: DataFrame, scratch: Scratch, weights: tuple[float, ...], cap: float, seed: int, draws: int) -> DataFrame:
    """source_targets() with the seed of each source: of `draws` seeds, that whose Bernoulli draws take words nearest the
    target. One draw leaves a source with few or very long documents far from it; the sums for all seeds take one pass."""
    rates = scratch.keep(source_targets(sizes, weights, cap), "targets")
    few = broadcast_if(rates.withColumnRenamed("source", "_nl_source"), rates.count(), MOST_BROADCAST)
    joined = sizes.join(few, F.col("source").eqNullSafe(F.col("_nl_source")), "left")
    off = [F.abs(F.sum(F.col("size") * copies(F.col("rate"), F.lit(seed + k), F.col("doc_id"))) - F.first("target")) for k in range(draws)]
    best = joined.groupBy("source").agg(F.least(*[F.struct(x.alias("off"), F.lit(seed + k).alias("seed")) for k, x in enumerate(off)]).alias("best"))
    best = best.select(F.col("source").alias("_nl_source"), F.col("best.seed").alias("seed"))
    with_seed = rates.join(best, F.col("source").eqNullSafe(F.col("_nl_source")), "left").drop("_nl_source")
    return scratch.keep(with_seed.withColumnRenamed("source", "_nl_source"), "rates")


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = SEED, draws: int = DRAWS) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of every row of docs.

    Null text: size 0. Null source: a source of its own, last. A document's Bernoulli draw depends on its id and its source's
    seed, so reruns agree and repeated rows of one id take the same copies. Very long texts count whole. Empty table: no rows. Other
    columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sizes = scratch.keep(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    rates = rate_table(sizes, scratch, weights, cap, seed, draws)
    few = broadcast_if(rates, rates.count(), MOST_BROADCAST)
    joined = sizes.join(few, F.col("source").eqNullSafe(F.col("_nl_source")), "left")
    return joined.select("doc_id", "source", "size", "source_size", "target", copies(F.col("rate"), F.col("seed"), F.col("doc_id")).alias("copies"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = SEED, draws: int = DRAWS) -> DataFrame:
    """The mix itself: every column of docs, each row as often as its copies. A draw needs only the row's id and its source's
    rate and seed, so the texts are not shuffled."""
    scratch = Scratch(docs.sparkSession, "mixing")
    sizes = scratch.keep(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    rates = rate_table(sizes, scratch, weights, cap, seed, draws).select("_nl_source", F.col("rate").alias("_nl_rate"), F.col("seed").alias("_nl_seed"))
    joined = docs.join(broadcast_if(rates, rates.count(), MOST_BROADCAST), docs["source"].eqNullSafe(F.col("_nl_source")), "left")
    n = copies(F.col("_nl_rate"), F.col("_nl_seed"), docs["doc_id"]).cast("int")
    return joined.withColumn("_nl_copy", F.explode(F.array_repeat(F.lit(True), n))).select(*docs.columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mixed() of every row of documents, with the words that its copies take."""
    out = mixed(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
