"""What a table of questions asks for: tokens, named entities, search hypotheses and the text to search by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import vocabulary as V
from newsloom.functions.dialect import Spark
from newsloom.operators import text as rules

#: Hypotheses in the expanded text, and its characters (fixed values).
IN_TEXT, LONGEST = 4, 300
#: A boundary between ASCII word characters and others.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
_NAME = rf"{EDGE}[A-Z][a-z0-9_-]+(?:\s+[A-Z][a-z0-9_-]+)*{EDGE}"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def strings(items: list[str]) -> Column:
    return F.array(*map(F.lit, items))


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits, _ and - of three characters or more, and the short ones that name a subject; with repeats."""
    found = F.split(F.lower(text), "[^a-zA-Z0-9_-]+")
    return F.filter(found, lambda t: (F.length(t) > 2) | t.isin(V.SHORT_TOKENS))


def hypotheses(text: Column) -> Column:
    """What the concepts that the text holds anywhere suggest, in the order of the concepts; `ai` fires inside `trail`."""
    concepts = F.array(*[F.struct(F.lit(k).alias("key"), strings(v).alias("related")) for k, v in V.CONCEPTS.items()])
    return F.array_distinct(F.flatten(F.transform(F.filter(concepts, lambda c: F.contains(F.lower(text), c["key"])), lambda c: c["related"])))


def expand(questions: DataFrame, keys: list[str], signals: dict[str, list[str]] | None = None) -> DataFrame:
    """keys, question (the trimmed text), tokens (of high signal, with repeats), entities, hypotheses, keywords, expanded, temporal_intent,
    primary_intent, intents, expected_types, demoted_types, temporal_focus of questions (keys, text). Null and blank texts ask
    nothing: their arrays are empty and their intents are those of an empty text. Nothing is shuffled; rows may repeat."""
    signals = signals or V.INTENT_SIGNALS
    own = [F.col(k) for k in keys]
    q = questions.select(*own, trimmed(F.col("text")).alias("question"))
    every = tokens(F.col("question"))
    strong = F.filter(every, lambda t: ~t.isin(V.QUESTION_STOP))
    names = F.filter(F.regexp_extract_all("question", F.lit(_NAME), F.lit(0)), lambda w: ~F.lower(w).isin(V.QUESTION_STOP))
    q = q.withColumn("every", every).withColumn("tokens", strong).withColumn("entities", F.array_distinct(names)).withColumn("hypotheses", hypotheses(F.col("question")))
    base = F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.col("every"))
    words = F.filter(F.array_distinct(base), lambda t: ~t.isin(V.QUESTION_STOP) & (F.length(t) > 2))
    parts = F.concat(F.array("question"), F.slice("hypotheses", 1, IN_TEXT))
    q = q.withColumn("keywords", words).withColumn("expanded", F.when(F.col("question") == "", F.lit("")).otherwise(F.substring(F.array_join(parts, " "), 1, LONGEST)))
    view = "nl_questions"
    q.withColumn("text", F.col("question")).createOrReplaceTempView(view)
    spark = questions.sparkSession
    kept = "question, tokens, entities, hypotheses, keywords, expanded"
    intents = rules.intent_sql(Spark(), view, ", ".join([*keys, kept]), signals)
    timed = f"SELECT *, {rules.temporal_sql(Spark(), 'question')} AS temporal_intent FROM ({intents}) t"
    return spark.sql(timed)
