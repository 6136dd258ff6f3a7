"""Quality rules: counts per document, then a hashed n-gram log-likelihood ratio between a trusted and the raw corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import Scratch, broadcast_if, read_table, words

#: Buckets of hashed word 1- and 2-grams; both multinomials have this size at every scale.
BUCKETS = 1 << 15
WINDOW = 5
#: Documents below this mean log-likelihood ratio per n-gram (nats) are rejected.
THRESHOLD = -0.2
#: Ids of good rows up to which they are broadcast; beyond it the join is shuffled. All of them are counted in either case.
MOST_BROADCAST = 100_000


def _hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def _bucket(h: Column, n: int) -> Column:
    return F.pmod(h, F.lit(n)).cast("int")


def _grams(hs: Column, n: int) -> Column:
    """Buckets of the words and of neighbouring pairs."""
    pairs = F.zip_with(F.slice(hs, 1, F.size(hs) - 1), F.slice(hs, 2, F.size(hs)), lambda a, b: _bucket(F.xxhash64(a, b), n))
    return F.concat(F.transform(hs, lambda h: _bucket(h, n)), F.when(F.size(hs) > 1, pairs).otherwise(F.array().cast("array<int>")))


def _windows(hs: Column, n: int) -> Column:
    """A hash of each window of n words."""
    windows = F.transform(F.sequence(F.lit(1), F.size(hs) - (n - 1)), lambda i: F.xxhash64(*[F.element_at(hs, i + k) for k in range(n)]))
    return F.when(F.size(hs) >= n, windows).otherwise(F.array().cast("array<long>"))


def document_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs, with word hashes and the base counts of every row. Null texts have no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n", -1)
    out = docs.select(*[docs[c] for c in keep], *([] if "text" in keep else [docs["text"]]))
    out = out.withColumn("_nl_ws", words(F.col("text")))
    out = out.select(
        *keep,
        F.size("_nl_ws").cast("long").alias("_nl_n_words"),
        F.length(F.array_join("_nl_ws", "")).cast("long").alias("_nl_word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("_nl_n_symbols"),
        F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_nl_lines"),
        _hashes(F.col("_nl_ws")).alias("_nl_hs"),
    )
    out = out.withColumn("_nl_n_dup_lines", (F.size("_nl_lines") - F.size(F.array_distinct("_nl_lines"))).cast("long")).drop("_nl_lines")
    out = out.withColumn("_nl_win", _windows(F.col("_nl_hs"), WINDOW))
    # Texts without a repeated window end at the distinct count; the others sort their windows by (hash, start), mark those
    # equal to a neighbour, and add up the words that the marked starts cover.
    out = out.withColumn("_nl_sorted", F.when(F.size("_nl_win") > F.size(F.array_distinct("_nl_win")), F.array_sort(F.transform("_nl_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    marked = F.filter(
        F.transform("_nl_sorted", lambda x, k: F.when((F.get("_nl_sorted", k - 1)["h"] == x["h"]) | (F.get("_nl_sorted", k + 1)["h"] == x["h"]), x["i"])),
        lambda i: i.isNotNull(),
    )
    out = out.withColumn("_nl_starts", F.array_sort(marked)).drop("_nl_win", "_nl_sorted")
    covered = F.aggregate(
        F.zip_with("_nl_starts", F.slice("_nl_starts", 2, F.greatest(F.size("_nl_starts"), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0),
        lambda acc, x: acc + x,
    )
    out = out.withColumn("_nl_n_repeat", F.coalesce(covered, F.lit(0)).cast("long")).drop("_nl_starts")
    failed = (F.col("_nl_n_words") < 10) | (100 * F.col("_nl_n_repeat") > 20 * F.col("_nl_n_words"))
    return out.withColumn("_nl_base_failed", failed)


def ratio_table(docs: DataFrame, trusted: DataFrame | None, buckets: int = BUCKETS) -> DataFrame:
    """One row: array of log(p_trusted / p_raw) by bucket. Raw counts are scaled to the trusted total before both get one pseudo-count a
    bucket, so that in a small corpus, too, what both hold alike has ratio 0. Raw counts cover every row of docs; trusted ones every row whose doc_id is in `trusted`. Without any, all ratios are 0."""
    on = docs.select("doc_id", "text")
    if trusted is None:
        on = on.withColumn("on", F.lit(False))
    else:
        ids = trusted.select(F.col("doc_id").alias("_nl_id"), F.lit(True).alias("on")).distinct()
        on = on.join(broadcast_if(ids, trusted.count(), MOST_BROADCAST), F.col("doc_id") == F.col("_nl_id"), "left")
    hs = on.select("on", _hashes(words(F.col("text"))).alias("hs"))
    grams = hs.select(F.coalesce("on", F.lit(False)).cast("int").alias("on"), F.explode(_grams(F.col("hs"), buckets)).alias("b"))
    counts = grams.groupBy("b").agg(F.sum("on").alias("t"), F.count(F.lit(1)).alias("r"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"))
    counts = every.join(counts, "b", "left").select("b", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("t", "r")])
    rows = counts.agg(F.array_sort(F.collect_list(F.struct("b", "t", "r"))).alias("x"), F.sum("t").alias("nt"), F.sum("r").alias("nr"))
    ratio = lambda x: F.log(x["t"] + F.lit(1.0)) - F.log(x["r"] * F.col("nt") / F.col("nr") + 1)
    return rows.select(F.when(F.col("nt") > 0, F.transform("x", ratio)).otherwise(F.transform("x", lambda x: F.lit(0.0))).alias("ratios"))


def quality_rules(docs: DataFrame, trusted: DataFrame | None, *, keep: list[str], buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """The columns `keep` of every row of docs, and _nl_n_words, _nl_word_chars, _nl_n_symbols, _nl_n_dup_lines, _nl_n_repeat,
    _nl_base_failed, _nl_llr (mean log-likelihood ratio of the row's n-grams), _nl_kept.

    Two passes over the texts: one counts the n-grams of the whole corpus into `buckets` numbers, one scores each row with that
    table in a scalar subquery, without a shuffle. Rows without words have ratio 0 and fail the base. Repeated rows have equal
    results. An empty table gives none. Columns of docs other than doc_id and text are only carried.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    table = scratch.keep(ratio_table(docs.select("doc_id", "text"), trusted, buckets), "ratios").scalar()
    out = document_counts(docs, keep)
    # The table is named once, so that Catalyst inlines the subquery and no row carries it.
    out = out.withColumn("_nl_table", table).withColumn("_nl_grams", _grams(F.col("_nl_hs"), buckets))
    total = F.aggregate("_nl_grams", F.lit(0.0), lambda acc, b: acc + F.get("_nl_table", b))
    grams = F.greatest(2 * F.col("_nl_n_words") - 1, F.lit(1))
    out = out.withColumn("_nl_llr", total / grams).drop("_nl_table", "_nl_grams", "_nl_hs")
    return out.withColumn("_nl_kept", ~F.col("_nl_base_failed") & (F.col("_nl_llr") >= threshold))


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all rows labelled as good."""
    return read_table(spark, sf_dir, "labels").where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(read_table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir), keep=["doc_id"])
    return out.select(
        "doc_id",
        F.col("_nl_n_words").alias("n_words"),
        F.col("_nl_word_chars").alias("word_chars"),
        F.col("_nl_n_symbols").alias("n_symbols"),
        F.col("_nl_n_dup_lines").alias("n_dup_lines"),
        F.col("_nl_n_repeat").alias("n_repeat_words"),
        F.col("_nl_base_failed").alias("base_failed"),
        F.col("_nl_kept").alias("kept"),
        F.round("_nl_llr", 6).alias("llr"),
    )
