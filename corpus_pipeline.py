"""From raw documents to token ids: quality rules, near-duplicate removal, sanitisation, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
documents. Extra columns of documents are carried; null texts are empty; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import bpe, mixing, neardup, pii, quality
from newsloom.llm.common import Scratch, read_table, where_computed

#: The steps need Python and counts of the whole corpus, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the likelihood ratio reject go; empty ones have too few words. Repeated rows are judged alike."""
    judged = quality.quality_rules(docs, quality.trusted_ids(spark, sf_dir), keep=docs.columns)
    return where_computed(judged, F.col("_nl_kept")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest (doc_id, text hash) stays, ids that are null last; of rows that
    repeat both, any one. Documents without words link with nothing and all stay. Decisions travel as ids and hashes, and groups of
    one row are not looked at. A group of n rows is judged in parts, about sqrt(all rows) of them, so that no task holds a large
    one. Texts move only where the rows that go are too many to broadcast, or where ids and hashes repeat."""
    scratch = Scratch(spark, "groups")
    found = neardup.near_duplicates(docs, text_hash="_nl_h", group="_nl_group").where(F.col("_nl_group").isNotNull())
    found = scratch.keep(found.groupBy("_nl_group", "doc_id", "_nl_h").agg(F.count(F.lit(1)).alias("_nl_rows")), "members")
    parts = math.isqrt(found.count()) + 1
    found = found.withColumn("_nl_part", F.pmod(F.xxhash64("doc_id", "_nl_h"), F.lit(parts)))
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "_nl_h")).alias("_nl_first")
    by_part = scratch.keep(found.groupBy("_nl_group", "_nl_part").agg(first, F.sum("_nl_rows").alias("_nl_rows")), "parts")
    best = by_part.groupBy("_nl_group").agg(F.min("_nl_first").alias("_nl_best"), F.sum("_nl_rows").alias("_nl_size")).where("_nl_size > 1")
    best = by_part.select("_nl_group", "_nl_part").join(best.select("_nl_group", "_nl_best"), "_nl_group")
    stays = found["doc_id"].eqNullSafe(F.col("_nl_best.doc_id")) & (found["_nl_h"] == F.col("_nl_best._nl_h"))
    judged = found.join(best, ["_nl_group", "_nl_part"]).select(F.col("doc_id").alias("_nl_id"), "_nl_h", "_nl_rows", stays.alias("_nl_stays"))
    judged = scratch.keep(judged.where(~F.col("_nl_stays") | (F.col("_nl_rows") > 1)), "judged")
    same = lambda other: docs["doc_id"].eqNullSafe(other["_nl_id"]) & (F.xxhash64(docs["text"]) == other["_nl_h"])
    gone, repeated = judged.where(~F.col("_nl_stays")), judged.where("_nl_stays")
    if not repeated.limit(1).count():
        return docs.join(gone, same(gone), "left_anti")
    marked = docs.join(judged, same(judged), "left")
    once = marked.where(F.col("_nl_stays")).dropDuplicates(["_nl_id", "_nl_h"])
    return marked.where(F.col("_nl_stays").isNull()).select(*docs.columns).union(once.select(*docs.columns))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced; n_chars, if there is such a column, follows the new text. No row goes."""
    out = pii.sanitise(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their source's rate says, at most three times; rows that repeat an id as often as each other."""
    return mixing.mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document of the mix without its text: n_tokens and ids, and the SHA-256 of what the ids decode to. Rows that repeat
    stay; columns of docs with one of the new names are replaced."""
    out = bpe.encode(docs, decoded="_nl_decoded")
    carried = [c for c in docs.columns if c not in ("text", "ids", "n_tokens", "decoded_sha256")]
    return out.select(*carried, F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("_nl_decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("PII", pii_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
