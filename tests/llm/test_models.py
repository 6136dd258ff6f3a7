"""Models and counts against their plain definitions, and queries over empty, long and oddly named tables."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from newsloom.llm import classifier, quality, queries, toxicity


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def spark_hash(*values):
    """Spark's xxhash64 of strings and longs: one after the other, from seed 42."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else (v & (1 << 64) - 1).to_bytes(8, "little"), seed)
    return signed(seed)


def test_factorisation_machine_equals_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = classifier.Machine(np.zeros(len(classifier.STATS)), np.ones(len(classifier.STATS)))
    m.w0, m.w, m.v = 0.3, rng.normal(size=len(m.w)), rng.normal(size=m.v.shape)
    for size in (0, 1, 5, 40):
        at, x = m.row(np.sort(rng.choice(classifier.DIMS, size, replace=False)).astype(np.int32), rng.normal(size=len(classifier.STATS)))
        plain = m.w0 + sum(m.w[i] * v for i, v in zip(at, x))
        plain += sum(float(m.v[i] @ m.v[j]) * a * b for (i, a), (j, b) in itertools.combinations(list(zip(at, x)), 2))
        assert abs(m.raw(at, x)[0] - plain) < 1e-8


def test_factorisation_machine_steps_down_its_gradient():
    """One step of fit() moves against the numerical gradient of the loss."""
    rng = np.random.default_rng(2)
    m = classifier.Machine(np.zeros(len(classifier.STATS)), np.ones(len(classifier.STATS)))
    m.v[:] = rng.normal(0, 0.3, m.v.shape)
    at, x = m.row(np.arange(6, dtype=np.int32), rng.normal(size=len(classifier.STATS)))
    loss = lambda: math.log1p(math.exp(-m.raw(at, x)[0]))
    before, (z, s, v) = loss(), m.raw(at, x)
    grad = -1 / (1 + math.exp(z)) * (x[:, None] * s - v * (x * x)[:, None])
    i, f, step = 3, 2, 1e-6
    m.v[at[i], f] += step
    assert abs((loss() - before) / step - grad[i, f]) < 1e-4
    m.v[at[i], f] -= step
    m.fit([(at, x)], [1])
    assert loss() < before


def test_ftrl_equals_plain_dictionaries():
    rng = random.Random(3)
    model, z, n = toxicity.Ftrl(32), {}, {}

    def weight(i):
        l1 = 0.0 if i == 32 else toxicity.L1
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(400):
        at, w = sorted(rng.sample(range(32), rng.randrange(6))), rng.choice([1.0, 3.0])
        y = int(bool(at) and at[0] < 9)
        model.learn(np.array(at, np.int32), y, w)
        ids = [*at, 32]
        old = {i: weight(i) for i in ids}
        g = w * (1 / (1 + math.exp(-sum(old.values()))) - y)
        for i in ids:
            sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
            z[i] = z.get(i, 0.0) + g - sigma * old[i]
            n[i] = n.get(i, 0.0) + g * g
    got = model.weights(np.arange(33))
    assert np.allclose(got, [weight(i) for i in range(33)], atol=1e-9) and np.count_nonzero(got) > 5


def test_quality_ratio_equals_plain_counts(spark):
    rng, buckets = random.Random(7), 64
    vocabulary = [f"w{i}" for i in range(30)] + ["é", "日本"]
    docs = [(i % 40, rng.choice([None, ""]) if i % 9 == 0 else " ".join(rng.choice(vocabulary[: 10 + i % 22]) for _ in range(rng.randrange(1, 40)))) for i in range(60)]
    trusted = set(range(0, 40, 3))

    def grams(t):
        ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        hs = [spark_hash(w) for w in ws]
        return ws, [h % buckets for h in hs] + [spark_hash(a, b) % buckets for a, b in zip(hs, hs[1:])]

    raw, good = np.zeros(buckets), np.zeros(buckets)
    for i, t in docs:
        for b in grams(t)[1]:
            raw[b] += 1
            good[b] += i in trusted
    ratio = np.log(good + 1) - np.log(raw * good.sum() / raw.sum() + 1)
    df = spark.createDataFrame([(k, i, t) for k, (i, t) in enumerate(docs)], "k int, doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in trusted], "doc_id long")
    out = quality.quality_rules(df, ids, keep=["k"], buckets=buckets, threshold=0.01).collect()
    assert len(out) == len(docs)
    for r in out:
        ws, bs = grams(docs[r.k][1])
        llr = sum(ratio[b] for b in bs) / max(1, 2 * len(ws) - 1)
        assert abs(r._nl_llr - llr) < 1e-9 and r._nl_kept == (not r._nl_base_failed and r._nl_llr >= 0.01)
    assert len({r._nl_kept for r in out}) == 2


PAGES = "page_id long, url string, html string, payload string, digest string, record_type string, key int, page_ID2 long"


def pages(spark, rows, at):
    spark.createDataFrame([(i, f"http://x/{i}", h, "p", "d", "r", 1, 2) for i, h in rows], PAGES).write.parquet(f"{at}/pages.parquet")
    return {r.page_id: r for r in queries.queries()["op6_warc"](spark, str(at)).collect()}


def test_warc_of_long_and_oddly_named_pages(spark, tmp_path):
    long = "é" * 3_000_000
    rows = [(1, long), (2, "x" * 999), (3, "x" * 999), (4, None), (5, long), (6, "y" * 1000), (7, "y" * 1000)]
    out = pages(spark, rows, tmp_path)
    assert {i: (r.record_type, r.refers_to) for i, r in out.items()} == {1: ("revisit", 5), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("revisit", 7), 7: ("response", None)}
    for i, h in rows:
        data = (h or "").encode()
        assert (out[i].payload_bytes, out[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())


def test_queries_of_empty_tables(spark, tmp_path):
    """Each operator and the pipeline over tables without rows."""
    schemas = {
        "documents": "doc_id long, text string, lang string, source string, n_chars long",
        "labels": "doc_id long, quality int, toxic int",
        "pages": "page_id long, url string, html string",
        "embeddings": "vec_id long, embedding array<float>, label int",
    }
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in queries.queries().items():
        if re.match(r"op\d+_", name):
            assert query(spark, str(tmp_path)).count() == 0, name
    pipeline = pytest.importorskip("corpus_pipeline")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_scores_do_not_read_other_columns(spark):
    """Columns that are named like a result are not read, and null and repeated rows have scores."""
    docs = spark.createDataFrame([(1, "good words here", 9.0, "x"), (1, "good words here", 1.0, "y"), (None, None, None, None)], "doc_id long, text string, score double, label string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for module in (classifier, toxicity):
        out = module.score(docs, module.train(docs, labels)).collect()
        assert len(out) == 3 and all(0 <= r.score <= 1 for r in out) and len({r.score for r in out if r.doc_id == 1}) == 1
    assert docs.where(F.col("doc_id").isNull()).count() == 1
