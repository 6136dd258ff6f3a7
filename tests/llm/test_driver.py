"""What the near-duplicate join keeps in the driver, and its rounds of components."""

import random
import tracemalloc
import zlib

import numpy as np

from newsloom.llm import neardup
from newsloom.llm.common import Scratch


def test_counters_are_unpacked_in_the_driver_one_chunk_at_a_time(spark):
    rng, step = np.random.default_rng(0), neardup.COUNTERS // neardup.CHUNKS
    tasks = [np.minimum(rng.zipf(1.6, neardup.COUNTERS), 255).astype(np.uint8) for _ in range(2)]
    rows = [(n, k, bytearray(zlib.compress(t[n * step : (n + 1) * step].tobytes(), 1))) for k, t in enumerate(tasks) for n in range(neardup.CHUNKS)]
    chunks = spark.createDataFrame(rows, "n long, task long, data binary").cache()
    chunks.count()
    total = sum(t.astype(np.uint32) for t in tasks)
    above = np.maximum(total - (total.mean() + 4 * np.sqrt(total.mean()) + 8), 0)
    expected = np.where(above > 0, 1 + np.log2(np.maximum(above, 1)), 0).astype(np.uint8)
    del rows, above, total
    tracemalloc.start()
    try:
        got = neardup.frequency_classes(chunks)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (got == expected).all() and got.any()
    assert peak < 40e6, peak


def test_no_counters_give_no_classes(spark):
    assert not neardup.frequency_classes(spark.createDataFrame([], "n long, task long, data binary")).any()


def test_components_of_chains_stars_and_chance(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 230)] + [(rng.randrange(300, 360), rng.randrange(300, 360)) for _ in range(40)]
    rng.shuffle(edges)
    leader = {x: x for e in edges for x in e}
    for _ in leader:
        for a, b in edges:
            leader[a] = leader[b] = min(leader[a], leader[b])
    found = neardup.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c")
    assert dict(map(tuple, found.collect())) == leader
    assert not neardup.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"), "c").count()
