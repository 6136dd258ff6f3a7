"""Document fingerprints: closed syncmers of words as context-free anchors, all kept with their places."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.llm.common import read_table, unit_hash, words

#: Scales of symbols, from fine to coarse: name, symbols in a k-mer and in its inner substrings, and the code points (more than the first
#: number, at most the second) of the texts that have them. A k-mer is an anchor if its least inner substring is its first or
#: its last. A text and one of at least half and at most all of its length have a scale in common.
SCALES = (("a", 2, 1, 0, 24), ("b", 4, 2, 12, 96), ("c", 6, 2, 48, 512), ("w", 6, 2, 256, 1 << 31))
#: The scale whose symbols are words; texts of fewer words than FEW have scale c at any length.
WORDS, FEW = "w", 24
#: Two matches are in one group if their shifts, or those of matches between them, are within this many symbols of each other.
SHIFT = 8
#: Rows of a range of ids, ranges at most (beyond it ranges get longer and their sorts spill), and ids a range that the bounds are
#: estimated from. Results are the same for any bounds.
RANGE_ROWS, MOST_RANGES, SAMPLE = 128, 1 << 17, 32


_ANCHORS = "array<struct<h:bigint,p:int>>"


def _anchors(h: str, m: str, k: int, s: int) -> Column:
    """Anchors (h, p) of the symbols' hashes h and their inner substrings' hashes m, ascending."""
    inner = k - s

    def anchor(i: Column) -> Column:
        at = [F.get(m, i + j) for j in range(inner + 1)]
        return F.when((F.least(*at) == at[0]) | (F.least(*at) == at[inner]), F.struct(F.xxhash64(*[F.get(h, i + j) for j in range(k)]).alias("h"), i.alias("p")))

    found = F.filter(F.transform(F.sequence(F.lit(0), F.size(h) - k), anchor), lambda x: x.isNotNull())
    return F.when(F.size(h) >= k, F.sort_array(found)).otherwise(F.array().cast(_ANCHORS))


def add_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with `name`: for each scale of SCALES the hashes, ascending, and the places of a text's anchors; a hash comes once for each
    place. A scale that a text does not have is empty; one that it has without an anchor holds the whole text's hash. Empty texts have none."""
    n = F.coalesce(F.length(text), F.lit(0))
    df = df.withColumn(f"{name}_ws", words(F.col(text)))  # split once: it is what costs most
    parts = []
    for scale, k, s, low, high in SCALES:
        h, m = f"{name}_{scale}h", f"{name}_{scale}m"
        has = (n > low) & (n <= high)
        if scale == WORDS:
            has, symbols = has & (F.size(f"{name}_ws") >= k), F.col(f"{name}_ws")
        else:
            has = has | ((n > high) & (F.size(f"{name}_ws") < FEW)) if scale == "c" else has
            symbols = F.split(F.coalesce(F.col(text), F.lit("")), "")
        hashes = F.transform(symbols, lambda x: F.xxhash64(x))
        df = df.withColumn(h, F.when(has, hashes).otherwise(F.array().cast("array<long>")))
        if s == 1:
            df = df.withColumn(m, F.col(h))
        else:
            after = F.greatest(F.size(h) - 1, F.lit(0))
            df = df.withColumn(m, F.zip_with(F.slice(h, 1, after), F.slice(h, 2, after), lambda x, y: F.xxhash64(x, y)))
        df = df.withColumn(f"{name}_{scale}", _anchors(h, m, k, s))
        whole = F.when(F.size(h) > 0, F.array(F.struct(F.xxhash64(text).alias("h"), F.lit(0).alias("p")))).otherwise(F.array().cast(_ANCHORS))
        df = df.withColumn(f"{name}_{scale}", F.when(F.size(f"{name}_{scale}") > 0, F.col(f"{name}_{scale}")).otherwise(whole)).drop(h, m)
        x = F.col(f"{name}_{scale}")
        parts.append(F.struct(F.transform(x, lambda y: y["h"]).alias("h"), F.transform(x, lambda y: y["p"]).alias("p")).alias(scale))
    return df.withColumn(name, F.struct(*parts)).drop(f"{name}_ws", *[f"{name}_{x[0]}" for x in SCALES])


def _numbered(name: str, side: int) -> Column:
    """The anchors as (hash, number among its places, side, place). Numbers are looked up only where a hash repeats."""
    h = f"{name}.h"
    row = lambda x, i, k: F.struct(x.alias("h"), k.alias("k"), F.lit(side).alias("side"), F.get(f"{name}.p", i).alias("p"))
    plain = F.transform(h, lambda x, i: row(x, i, F.lit(0)))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), plain).otherwise(F.transform(h, lambda x, i: row(x, i, i + 1 - F.array_position(h, x).cast("int"))))


def add_likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """df with `name`: of all anchors of either text, of the finest scale that both have, the share that match. Equal hashes match in the order of their places, and a
    match counts if another one has nearly its shift, so that each part of a text that moved has a group of its own; a single
    match counts too. Two empty fingerprints are alike (1); an empty and another are not (0)."""
    common = lambda scale: (F.size(f"{a}.{scale}.h") > 0) & (F.size(f"{b}.{scale}.h") > 0)
    own = {}
    for x in (a, b):
        own[x] = f"{name}_{'x' if x == a else 'y'}"
        pick = F.col(f"{x}.{WORDS}")
        for scale, *_ in reversed(SCALES[:-1]):
            pick = F.when(common(scale), F.col(f"{x}.{scale}")).otherwise(pick)
        df = df.withColumn(own[x], pick)
    empty = reduce(lambda p, q: p & q, [(F.size(f"{a}.{x[0]}.h") == 0) & (F.size(f"{b}.{x[0]}.h") == 0) for x in SCALES])
    df = df.withColumn(f"{name}_empty", empty)
    a, b = own[a], own[b]
    both, shifts = f"{name}_both", f"{name}_shifts"
    df = df.withColumn(both, F.when(F.arrays_overlap(f"{a}.h", f"{b}.h"), F.sort_array(F.concat(_numbered(a, 0), _numbered(b, 1)))))

    def shift(x: Column, i: Column) -> Column:
        after = F.get(both, i + 1)
        return F.when((after["h"] == x["h"]) & (after["k"] == x["k"]), x["p"] - after["p"])

    df = df.withColumn(shifts, F.sort_array(F.filter(F.transform(both, shift), lambda d: d.isNotNull()))).drop(both)
    near = F.filter(shifts, lambda d, i: F.coalesce((d - F.get(shifts, i - 1) <= SHIFT), F.lit(False)) | F.coalesce((F.get(shifts, i + 1) - d <= SHIFT), F.lit(False)) | (F.size(shifts) == 1))
    n = F.size(f"{a}.h") + F.size(f"{b}.h")
    return df.withColumn(name, F.when(F.col(f"{name}_empty"), 1.0).when(F.col(shifts).isNull(), 0.0).otherwise(F.size(near) / (n - F.size(shifts)))).drop(shifts, a, b, f"{name}_empty")


def fingerprint_text(name: str) -> Column:
    """`hash@place` in hexadecimal, by hash, comma-joined; scales from fine to coarse, each ended by its name."""
    listed = lambda x: F.lower(F.array_join(F.zip_with(f"{name}.{x}.h", f"{name}.{x}.p", lambda h, p: F.concat(F.hex(h), F.lit("@"), F.hex(p.cast("long")))), ","))
    return F.concat(*[F.when(F.size(f"{name}.{x[0]}.h") > 0, F.concat(listed(x[0]), F.lit(f":{x[0]};"))).otherwise("") for x in SCALES])


def with_next(df: DataFrame, key: str, order: list[str], carried: list[str]) -> DataFrame:
    """df with next_<c> for each carried column c: its value in the next row by (key, order), after the last the first.

    Rows are dealt into ranges of keys whose bounds are quantiles of a hashed sample of the column (SAMPLE * MOST_RANGES keys). The
    rows of the least key of a range are dealt to the range before too, as guests at its end, so that every row finds its
    successor within its range. No window holds more than a range.
    """
    spark = df.sparkSession
    keys = df.select(F.col(key).cast("long").alias("k"))
    n, low, nulls = keys.agg(F.count(F.lit(1)), F.min("k"), F.coalesce(F.sum(F.col("k").isNull().cast("long")), F.lit(0))).first()
    ranges = max(1, min(MOST_RANGES, -(-n // RANGE_ROWS)))
    some = keys.where("k is not null").distinct() if n <= SAMPLE * ranges else keys.where(unit_hash(7, F.col("k")) < SAMPLE * ranges / n).distinct()
    sampled = np.sort(some.toArrow()["k"].to_numpy()) if ranges > 1 else np.zeros(0, np.int64)  # 8 bytes a key: 34 MB at most
    starts = sorted({low, *sampled[:: max(1, len(sampled) // ranges)].tolist()} - {None})  # the least key of each range; nulls are range 0
    table = spark.createDataFrame([(starts,)], "starts array<long>").scalar()
    halves = [1 << b for b in range(max(1, len(starts)).bit_length() - 1, -1, -1)]
    found = F.aggregate(F.array(*map(F.lit, halves)), F.lit(0), lambda acc, h: F.when(F.get("_nl_starts", acc + h - 1) <= F.col(key), acc + h).otherwise(acc))
    df = df.withColumn("_nl_starts", table).withColumn("_nl_range", F.coalesce(found, F.lit(0))).drop("_nl_starts")
    df = df.withColumn("_nl_starts", table).withColumn("_nl_least", F.coalesce(F.get("_nl_starts", F.col("_nl_range") - 1) == F.col(key), F.col("_nl_range") == 0)).drop("_nl_starts")
    before = F.when(F.col("_nl_range") > (0 if nulls else 1), F.col("_nl_range") - 1).otherwise(len(starts))
    homes = F.when(F.col("_nl_least"), F.array(F.struct(F.lit(0).alias("guest"), F.col("_nl_range").alias("no")), F.struct(F.lit(1).alias("guest"), before.alias("no"))))
    df = df.withColumn("_nl_home", F.explode(F.coalesce(homes, F.array(F.struct(F.lit(0).alias("guest"), F.col("_nl_range").alias("no"))))))
    df = df.select("*", F.col("_nl_home.guest").alias("_nl_guest"), F.col("_nl_home.no").alias("_nl_no")).drop("_nl_home", "_nl_range", "_nl_least")
    w = Window.partitionBy("_nl_no").orderBy("_nl_guest", F.col(key).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order])
    df = df.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carried])
    return df.where(F.col("_nl_guest") == 0).drop("_nl_guest", "_nl_no")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text, edited, fp, edited_fp, near_edited, near_next) of every row of docs.

    edited: text with its last floor(n/2) code points replaced by as many of the next document's first, or all of them. The next
    document is that of the next doc_id, nulls first; repeated ids follow in the order of their texts; after the last comes the
    first, so a single row is its own next. Null texts are empty. An empty table gives no rows. Very long texts keep all their anchors.
    Other columns are ignored, whatever their names.
    """
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = with_next(df, "doc_id", ["text"], ["text"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    df = df.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    # Fingerprints are as long as the texts, so that of the next text is computed here again instead of being shuffled.
    for text, name in (("text", "fp"), ("edited", "edited_fp"), ("next_text", "next_fp")):
        df = add_fingerprint(df, text, name)
    df = add_likeness(add_likeness(df, "fp", "edited_fp", "near_edited"), "fp", "next_fp", "near_next")
    return df.select("doc_id", "text", "edited", "fp", "edited_fp", "near_edited", "near_next")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fingerprint_documents() of every row of documents."""
    out = fingerprint_documents(read_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint_text("fp").alias("fingerprint"),
        fingerprint_text("edited_fp").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
