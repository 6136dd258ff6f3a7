"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import Scratch, read_table, small_batches, training_fold
from newsloom.llm.features import WordHashes, mix, sigmoid
from newsloom.llm.toxicity import bounded_features, labelled_rows

#: Hash buckets of words, and the rank of the interactions.
DIMS, RANK = 1 << 16, 8
RATE, DECAY, EPOCHS = 0.05, 1e-5, 6
#: Bound on the labelled rows that the model is fitted on. They are chosen by a hash of their ids.
MOST_LABELLED = 8_000
SEED = 37
#: Statistics of a text, in the order of their features after the words'.
STATS = ("log_bytes", "log_words", "word_length", "upper", "digits", "punctuation", "symbols", "spaces", "wide", "lines", "same_lines", "same_words")


def statistics(text: str, hs: np.ndarray) -> list[float]:
    """Structure of a text, and its length as metadata; each number is about 0 to 1."""
    data = text.encode()
    n = max(1, len(data))
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = lambda chars: float(count[list(chars)].sum()) / n
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        np.log1p(len(data)) / 12,
        np.log1p(len(hs)) / 12,
        min(1.0, len(data) / max(1, len(hs)) / 20),
        share(range(65, 91)),
        share(range(48, 58)),
        share(b".,;:!?'\"()-"),
        share(b"#*$%&|<>{}[]^~_=+/\\@"),
        share(b" \t\r\n"),
        share(range(128, 256)),
        min(1.0, len(lines) / max(1, len(hs))),
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        1 - len(np.unique(hs)) / len(hs) if len(hs) else 0.0,
    ]


def word_buckets(hs: np.ndarray) -> np.ndarray:
    return np.unique((mix(hs, 7) & np.uint64(DIMS - 1)).astype(np.int32))


class Machine:
    """w0 + w.x + sum over f of ((V_f.x)^2 - (V_f^2).(x^2)) / 2, linear in the features that a row has."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        self.mean, self.spread = mean, spread
        self.w0, self.w = 0.0, np.zeros(DIMS + len(STATS))
        self.v = np.random.default_rng(SEED).normal(0, 0.02, (DIMS + len(STATS), RANK))

    def row(self, at: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of a row's features: the words share a length of 1, statistics are standardised."""
        x = np.concatenate([np.full(len(at), 1 / np.sqrt(max(1, len(at)))), np.clip((stats - self.mean) / self.spread, -4, 4) / 2])
        return np.concatenate([at, np.arange(DIMS, DIMS + len(STATS), dtype=np.int32)]), x

    def raw(self, at: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        v = self.v[at]
        s = x @ v
        return self.w0 + self.w[at] @ x + 0.5 * float((s * s).sum() - ((v * v) * (x * x)[:, None]).sum()), s, v

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> None:
        """AdaGrad on the logistic loss, in a seeded order."""
        g0, gw, gv = 1e-6, np.full(len(self.w), 1e-6), np.full(self.v.shape, 1e-6)
        order = np.random.default_rng(SEED)
        for _ in range(EPOCHS):
            for i in order.permutation(len(rows)):
                at, x = rows[i]
                z, s, v = self.raw(at, x)
                d = sigmoid(z) - labels[i]
                g0 += d * d
                self.w0 -= RATE * d / np.sqrt(g0)
                g = d * x + DECAY * self.w[at]
                gw[at] += g * g
                self.w[at] -= RATE * g / np.sqrt(gw[at])
                g = d * (x[:, None] * s - v * (x * x)[:, None]) + DECAY * v
                gv[at] += g * g
                self.v[at] -= RATE * g / np.sqrt(gv[at] + 1e-3)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_LABELLED) -> Machine:
    """Only the features of the bounded sample come to the driver (rows and features both bounded). Null texts are empty; without labelled rows every score is
    a half. Columns other than doc_id, text and `label` are not read, whatever their names."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            at, stats = [], []
            for t in b.column("text"):
                t = t.as_py() or ""
                hs = hashes.of(t)[:, 0]
                at.append(word_buckets(hs))
                stats.append(statistics(t, hs))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("label"), pa.array(at, pa.list_(pa.int32())), pa.array(stats, pa.list_(pa.float64()))],
                names=["doc_id", "label", "at", "stats"],
            )

    scratch = Scratch(docs.sparkSession, "classifier")
    rows = labelled_rows(docs, labels, label, most)
    got = bounded_features(scratch.keep(rows.mapInArrow(run, "doc_id long, label int, at array<int>, stats array<double>"), "sample"))
    stats = np.array(got.column("stats").to_pylist()).reshape(-1, len(STATS))
    machine = Machine(stats.mean(axis=0), stats.std(axis=0) + 1e-3) if len(stats) else Machine(np.zeros(len(STATS)), np.ones(len(STATS)))
    at = [x.values.to_numpy() if len(x.values) else np.zeros(0, np.int32) for x in got.column("at")]
    machine.fit([machine.row(a, s) for a, s in zip(at, stats, strict=True)], got.column("label").to_pylist())
    return machine


def score(docs: DataFrame, machine: Machine, name: str = "score") -> DataFrame:
    """(doc_id, name) of every row of docs: the probability of label 1 from its whole text. Null texts are empty, and empty texts
    are scored by their statistics. Nothing is shuffled; the broadcast weights are (DIMS + STATS) * (RANK + 1) numbers. Repeated
    rows have equal scores, an empty table gives none, very long texts are read whole. Other columns are not read."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hashes = sent.value, WordHashes()
        for b in batches:
            out = []
            for t in b.column("text"):
                t = t.as_py() or ""
                hs = hashes.of(t)[:, 0]
                out.append(sigmoid(model.raw(*model.row(word_buckets(hs), np.array(statistics(t, hs))))[0]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", name])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {name} double")


def op7_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out (false for a null id), score and predicted of every row of documents, learnt from `labels.quality`."""
    docs = read_table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, read_table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        F.coalesce(~training_fold(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )
