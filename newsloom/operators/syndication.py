"""Articles that depend on others, of all articles: by wire service, outlet and words. No pair is written before it is known to be near.

Pairs of word sets meet by a word of their prefixes (their rarest words, of which two sets that are alike share one). As common words grow with
the articles, so many sets share a word that most of these meetings are by chance. They are refused where they are made, by the
places of the word and by two bounds that are carried along: the sizes, and 128 bits of parity of the set's words. The bits in which two sets differ
are at most as many as the words in which they differ, so nothing that is alike is refused.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Above this similarity two sets are alike, as a fraction (fixed values); shared words c of sizes n, m: (A + B) * c > A * (n + m).
A, B = 13, 20


def similar_pairs(sets: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(x, y) with x < y of sets (leader, words) of a similarity above A / B. Leaders are unique, words are distinct and not empty."""
    bits = lambda half: f"aggregate(words, 0L, (b, w) -> b ^ CASE WHEN xxhash64(w) & 64 = {half} THEN shiftleft(1L, cast(xxhash64(w) & 63 AS int)) ELSE 0L END)"
    listed = keep(sets.select("leader", "words", F.size("words").alias("n"), F.expr(bits(0)).alias("low"), F.expr(bits(64)).alias("high")), "listed")
    flat = listed.select("leader", F.explode(F.transform("words", lambda w: F.xxhash64(w))).alias("word"))
    # words of equal hashes only meet more often; any order of the words gives the same pairs
    ranked = flat.join(flat.groupBy("word").agg(F.count(F.lit(1)).alias("uses")), "word")
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("leader").orderBy("uses", "word")))
    prefix = ranked.drop("uses").join(listed.drop("words"), "leader").where(f"{B} * (n - place + 1) > {A} * n")
    prefix = keep(prefix.select("word", "leader", "n", "place", "low", "high"), "prefix")
    a, b = prefix.alias("a"), prefix.alias("b")
    sizes = "(a.n + b.n)"
    near = f"{A + B} * (1 + least(a.n - a.place, b.n - b.place)) > {A} * {sizes}"
    parity = "(bit_count(a.low ^ b.low) + bit_count(a.high ^ b.high))"
    possible = f"{A + B} * ({sizes} - {parity}) > {2 * A} * {sizes}"
    met = a.join(b, F.expr(f"a.word = b.word AND a.leader < b.leader AND {near} AND {possible}")).select(F.col("a.leader").alias("x"), F.col("b.leader").alias("y")).distinct()
    left, right = (listed.select(F.col("leader").alias(k), F.col("words").alias(f"{k}_words")) for k in ("x", "y"))
    both = F.size(F.array_intersect("x_words", "y_words"))
    return met.join(left, "x").join(right, "y").where((A + B) * both > A * (F.size("x_words") + F.size("y_words"))).select("x", "y")


def syndication_pairs(articles: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(leader, article_id, reason) of articles (article_id, wire, outlet, ws: their sorted distinct words by blanks): each article beside the
    first of its wire service, of its outlet and of its set of words, and pairs of the first articles of sets that are alike."""
    m = keep(articles, "articles")

    def members(key: str, of: DataFrame, reason: str) -> DataFrame:
        led = of.groupBy(key).agg(F.min("article_id").alias("leader"))
        return m.join(led, key).where("article_id <> leader").select("leader", "article_id", F.lit(reason).alias("reason"))

    said = m.where("ws <> ''")
    sets = said.groupBy("ws").agg(F.min("article_id").alias("leader")).select("leader", F.split("ws", " ").alias("words"))
    alike = similar_pairs(sets, keep).select(F.col("x").alias("leader"), F.col("y").alias("article_id"), F.lit("similar words").alias("reason"))
    return members("wire", m.where("wire IS NOT NULL"), "same wire service").union(members("outlet", m, "same outlet")).union(members("ws", said, "same words")).union(alike)
