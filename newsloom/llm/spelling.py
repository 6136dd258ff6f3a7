"""Spelling variants: words one edit apart, found by bands of letter-parity masks, and the form that each leads to.

A word's mask has a bit for each letter, set if the word holds the letter an odd number of times. One edit flips at most two bits (a
replaced letter and its replacement), so of three bands of the mask one at least is equal in two near words. It also leaves one
half of the shorter word where it was, at the front or at the end. Words of equal or neighbouring lengths meet if they share a band
and that half; every pair that meets is verified. Groups that are large all the same are met by the rest of the words without one
letter, which holds every near pair too and no more of them than the alphabet allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import Scratch, read_table

#: Runs of letters; least code points and occurrences of a word; the run of every so manieth hash loses a letter (fixed values).
LETTERS, LEAST_CHARS, LEAST_COUNT, EVERY = "[A-Za-zÀ-ÿ]+", 5, 3, 97
#: A form occurs so many times as often as the word that it is the form of, at least (fixed value).
RATIO = 2
#: Bands of a mask: one more than the bits that an edit flips.
BANDS = 3
#: Words of a group up to which its words meet all at once.
GROUP = 2_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_runs(text: Column) -> Column:
    """The runs of letters with only A-Z in lower case. lower() is far faster than translate() and differs where it would change
    letters beyond ASCII or make letters of U+212A, U+212B, U+0130, U+0178 or U+1E9E; texts that hold those take the slow way."""
    plain = F.when(text.rlike("[À-ÞKÅİŸẞ]"), F.translate(text, _UPPER, _UPPER.lower())).otherwise(F.lower(text))
    return F.regexp_extract_all(plain, F.lit(LETTERS), F.lit(0))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of LEAST_CHARS code points and LEAST_COUNT occurrences or more. The rule of EVERY goes by the hash of
    document and run, so that reruns agree; null texts have no words, a null doc_id counts as an empty string. Occurrences are
    counted in every task before they are shuffled, so frequent words are no hot keys."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(lower_runs(F.coalesce("text", F.lit("")))).alias("run"))
    hashed = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = F.expr("cast(h % length(run) AS int)")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % EVERY == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_CHARS)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def _band(k: int) -> Column:
    """Band k of the mask of a word's letters: letters are numbered a to z, then from U+00C0, and dealt to the bands in turn."""
    number = "if(p < 128, p - 97, p - 192 + 26)"
    points = "transform(sequence(1, length(word)), i -> ascii(substring(word, i, 1)))"
    return F.expr(f"aggregate(transform({points}, p -> {number}), 0, (mask, b) -> mask ^ if(b % {BANDS} = {k}, shiftleft(1, cast(b div {BANDS} AS int)), 0))")


def _keys(words: DataFrame) -> DataFrame:
    """(key, rest, word, n, size, short) for every band and half under which a word can meet another: as one of the shorter or equal
    length (short), and as the longer. The key holds the shorter length, the side and letters of the half, and the band; rest is
    the other part of the word."""
    masked = words.withColumn("bands", F.array(*[_band(k) for k in range(BANDS)])).withColumn("size", F.length("word"))
    masked = masked.withColumn("least", F.explode(F.expr("array(size, size - 1)")))
    front, back = F.expr("least div 2").cast("int"), F.expr("least - least div 2").cast("int")
    sides = F.array(
        F.struct(F.lit("<").alias("side"), F.substring("word", F.lit(1), front).alias("half"), F.substring("word", front + 1, F.col("size")).alias("rest")),
        F.struct(F.lit(">").alias("side"), F.substring("word", F.col("size") - back + 1, back).alias("half"), F.substring("word", F.lit(1), F.col("size") - back).alias("rest")),
    )
    sided = masked.select("word", "n", "size", "least", "bands", F.explode(sides).alias("s"))
    each = sided.select("word", "n", "size", "least", "s", F.posexplode("bands").alias("k", "band"))
    key = F.concat_ws(":", "least", "s.side", "k", "band", "s.half")
    return each.select(key.alias("key"), F.col("s.rest").alias("rest"), "word", "n", "size", (F.col("size") == F.col("least")).alias("short"))


def _without_one(rest: str) -> Column:
    """A string and it without each of its letters: two strings at most one edit apart share one of these."""
    return F.expr(f"array_distinct(concat(array({rest}), transform(sequence(1, greatest(length({rest}), 1)), i -> concat(substring({rest}, 1, i - 1), substring({rest}, i + 1, length({rest}))))))")


def _met(keyed: DataFrame, on: list[str]) -> DataFrame:
    """(a, n_a, b, n_b) of the words that meet on these columns and are one edit apart. One of the two is of the shorter length."""
    a = keyed.where("short").select(*on, F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = keyed.select(*on, F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("short").alias("short_b"))
    met = a.join(b, on).where((~F.col("short_b") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "n_a", "b", "n_b")


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, near, near_n) of every two distinct words of (word, n) that one inserted, deleted or replaced code point parts, both ways.
    Verified pairs are few and may be found under several keys, so repeats go at the end."""
    keyed = scratch.keep(_keys(words), "keys")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max("short").alias("meets")).where("meets and size > 1")
    marked = keyed.drop("size").join(sizes.select("key", "size"), "key")
    marked = scratch.keep(marked, "marked")
    few = _met(marked.where(F.col("size") <= GROUP), ["key"])
    many = marked.where(F.col("size") > GROUP).withColumn("variant", F.explode(_without_one("rest")))
    pairs = scratch.keep(few.union(_met(many, ["key", "variant"])).distinct(), "pairs")
    return pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).union(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last. Each round doubles the steps taken. A form occurs RATIO times as often as
    its word, so chains are no longer than the logarithm of the counts, and rounds than the logarithm of that."""
    steps, k = forms.select("word", F.col("form").alias("to")), 0
    while True:
        hop = steps.select(F.col("word").alias("to"), F.col("to").alias("further"))
        steps = scratch.keep(steps.join(hop, "to", "left").select("word", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), f"steps-{k}")
        if not steps.where("moved").limit(1).count():
            return steps.select("word", F.col("to").alias("root"))
        steps, k = steps.drop("moved"), k + 1


def spelling_variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of docs (doc_id, text): the near word of largest n, the first in code-point
    order on a tie, is its form if it occurs RATIO times as often at least; root is where forms lead.

    Null and empty texts have no words, and an empty table gives none; repeated rows count as often as they stand; very long texts
    count whole. Other columns are not read, whatever their names."""
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.keep(word_counts(docs.select("doc_id", "text")), "words")
    near = near_words(words, scratch)
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")
    of_word = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    joined = words.join(of_word, "word", "left")
    often = -F.col("best.minus") >= RATIO * F.col("n")
    found = joined.select("word", F.when(often, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(often, -F.col("best.minus")).alias("form_n"))
    found = scratch.keep(found, "forms")
    led = found.join(roots(found.where("form IS NOT NULL"), scratch), "word", "left")
    return led.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spelling_variants() of all documents."""
    return spelling_variants(read_table(spark, sf_dir, "documents"))
