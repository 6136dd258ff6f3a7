"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import Scratch, bounded_sample, read_table, small_batches, training_fold, unit_hash
from newsloom.llm.features import WordHashes, mix, sigmoid

#: Hash buckets. Weights are a vector of this size, broadcast by its non-zero entries.
DIMS = 1 << 20
#: FTRL-proximal: learning rate, its offset, and the L1 and L2 penalties; passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 30.0, 0.1, 6
#: Label 1 is rare; its rows weigh as the ratio of the labels, up to this.
MOST_WEIGHT = 8.0
#: Bound on the labelled rows that the model is fitted on. They are chosen by a hash of their ids.
MOST_LABELLED = 12_000
#: Bound on the features of those rows, 4 bytes each on the driver; rows beyond it, by the same hash, are not learnt from.
MOST_FEATURES = 32_000_000
SEED = 31


def grams(hs: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Buckets of the words and their beginnings, of neighbouring pairs and of pairs that skip a word; a bucket may come more than
    once. Beginnings let the weights reach inflected words that the sample lacks."""
    parts = [mix(hs[:, 0], 1), mix(hs[:, 1], 4), mix(hs[:, 2], 5)]
    hs = hs[:, 0]
    if len(hs) > 1:
        parts.append(mix(hs[:-1] * np.uint64(3) + hs[1:], 2))
    if len(hs) > 2:
        parts.append(mix(hs[:-2] * np.uint64(5) + hs[2:], 3))
    return (np.concatenate(parts) & np.uint64(dims - 1)).astype(np.int32)


class Ftrl:
    """Per-coordinate learning rates from sums of squared gradients; weights are 0 until their gradients exceed L1."""

    def __init__(self, dims: int = DIMS):
        self.z, self.n = np.zeros(dims + 1), np.zeros(dims + 1)  # the last is the bias

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int, weight: float = 1.0) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = weight * (sigmoid(w.sum()) - label)
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label) of at most about `most` labelled rows of the training fold. Their ids are broadcast, so that the
    texts are not shuffled. Rows without a label of 0 or 1 don't count. A repeated id counts once, by the text of the least hash and the
    greatest label, so that reruns agree."""
    rows = labels.where(training_fold(F.col("doc_id")) & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    few = bounded_sample(rows, "doc_id", most, SEED)
    found = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    return found.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("label").alias("label"))


def bounded_features(sample: DataFrame, at: str = "at", most: int = MOST_FEATURES) -> pa.Table:
    """The rows of the sample by doc_id, as many by the hash of their ids as have `most` features together. The sample's ids and
    sizes, MOST_LABELLED numbers, tell where to stop before any features are fetched."""
    order = unit_hash(SEED + 1, F.col("doc_id"))
    sizes = sample.select(order.alias("u"), F.size(at).alias("n")).toArrow().sort_by("u")
    held = np.cumsum(sizes.column("n").to_numpy())
    if len(held) and held[-1] > most:
        sample = sample.where(order < float(sizes.column("u")[int(np.searchsorted(held, most, side="right"))].as_py()))
    return sample.toArrow().sort_by("doc_id")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_LABELLED) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets, weights, bias). Only the buckets of the bounded sample's n-grams come to the driver. Null texts are empty; columns of docs and labels
    other than doc_id, text and `label` are not read, whatever their names; without labelled rows every score is a half."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            found = [np.unique(grams(hashes.of(t.as_py() or ""))) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "label", "at"])

    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = labelled_rows(docs, labels, label, most)
    got = bounded_features(scratch.keep(rows.mapInArrow(run, "doc_id long, label int, at array<int>"), "sample"))
    model = Ftrl()
    at = [x.values.to_numpy() if len(x.values) else np.zeros(0, np.int32) for x in got.column("at")]
    y = got.column("label").to_pylist()
    rare = min(MOST_WEIGHT, max(1.0, (len(y) - sum(y)) / max(1, sum(y))))
    order = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        for i in order.permutation(len(y)):
            model.learn(at[i], y[i], rare if y[i] else 1.0)
    w = model.weights(np.arange(DIMS + 1))
    buckets = np.flatnonzero(w[:-1]).astype(np.int32)
    return buckets, w[buckets], float(w[-1])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], name: str = "score") -> DataFrame:
    """(doc_id, name) of every row of docs: the probability of label 1 from its whole text. Null and empty texts get that of the
    bias. Nothing is shuffled; the broadcast weights are at most DIMS. Repeated rows have equal scores, an empty table gives none, very long
    texts are read whole, one batch at a time. Other columns, such as one called `name`, are not read."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, weights, bias = sent.value
        table = np.zeros(DIMS, np.float64)
        table[buckets] = weights
        hashes = WordHashes()
        for b in batches:
            out = []
            for t in b.column("text"):
                at = grams(hashes.of(t.as_py() or ""))
                at = np.unique(at[table[at] != 0])
                out.append(sigmoid(bias + table[at].sum()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", name])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {name} double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out (false for a null id), score and predicted of every row of documents, learnt from `labels.toxic`."""
    docs = read_table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, read_table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        F.coalesce(~training_fold(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
