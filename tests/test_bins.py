"""Many small blocks of a slice are folded in few tasks' groups, with equal results."""

from collections import Counter

import numpy as np
import pandas as pd

from newsloom.sources.tables import Scratch
from newsloom.streaming import clustering as C


def test_bins_are_few_and_even():
    blocks = [0] * 50 + list(range(100, 700))
    bins = C._bins(blocks, 8)
    load = Counter(bins[b] for b in blocks)
    assert set(bins) == set(blocks) and len(load) == 8 and max(load.values()) - min(load.values()) <= 2


def test_a_slice_of_unrelated_articles_is_folded_in_few_groups(spark, monkeypatch):
    words = [f"{a}{b}{c}" * 2 for a in "bcdfg" for b in "aeiou" for c in "klmnp"]
    rows = [(i, w, None, 1_700_000_000 + i, "a", 0.5, "x", ["OTHER"], None) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, C.ARTICLES.replace("published_at timestamp", "published_at long"))
    df = df.withColumn("published_at", df.published_at.cast("timestamp"))
    store, whole = C.EventStore(spark, Scratch(spark, "bins").root), C.fold_block
    monkeypatch.setattr(C, "fold_block", lambda pdf, w: whole(pdf, w).assign(source=str(len(pdf))))
    C.cluster_batch(df, store, 0)
    sizes = [int(r.source) for r in store.table("joined", C.JOINED).collect()]
    assert len(sizes) == len(words) and sum(1 / s for s in sizes) <= 2 * spark.sparkContext.defaultParallelism + 0.01


def test_vectors_meet_within_a_block_only():
    none = np.zeros(0, np.int32).tobytes()
    row = lambda i, block, v: (block, i, None, f"t{i}", "x", ["LAW"], v, 100 + i, None, "s", 0.6, i, i, 3, none, none)
    columns = "block article_id event_id title category event_types embedding first_at last_at source reliability number rep grams near shared".split()
    out = C.fold_block(pd.DataFrame([row(0, 0, [1.0, 0.0]), row(1, 0, [1.0, 0.1]), row(2, 5, [1.0, 0.0]), row(3, 7, [1.0, 0.0, 0.0])], columns=columns), 0)
    assert out[out.article_id.notna()].set_index("article_id").event_id.to_dict() == {0: 0, 1: 0, 2: 2, 3: 3}
