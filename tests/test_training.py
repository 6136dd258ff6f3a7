"""The ranker's fit against the same steps in numpy; artifacts that are whole, broken or absent."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.operators import asking, training


def rows(spark, n=400, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.random((n, len(training.NAMES)))
    y = (x[:, 0] + x[:, 2] - x[:, 5] + rng.normal(0, 0.2, n) > 0.9).astype(int)
    return x, y, spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(x, y)], ", ".join(f"f_{k} double" for k in training.NAMES) + ", label int")


def test_fit_equals_numpy(spark):
    x, y, df = rows(spark)
    b, w = training.INTERCEPT, np.full(x.shape[1], training.WEIGHT)
    heavy = min(8.0, max(1.0, (len(y) - y.sum()) / y.sum()))
    for _ in range(5):
        e = (y - 1 / (1 + np.exp(-(x @ w + b)))) * np.where(y == 1, heavy, 1.0)
        b, w = b + training.RATE * e.mean(), w + training.RATE * ((e[:, None] * x).mean(0) - training.L2 * w)
    got = training.fit(df, steps=5)
    assert abs(got["intercept"] - b) < 1e-4 and np.allclose([got["weights"][k] for k in training.NAMES], w, atol=1e-4)
    assert training.fit(df.limit(0)) == {"intercept": training.INTERCEPT, "weights": dict.fromkeys(training.NAMES, training.WEIGHT)}


def test_evaluate(spark):
    x, y, df = rows(spark)
    model = {"intercept": -1.0, "weights": dict.fromkeys(training.NAMES, 0.1)}
    p = 1 / (1 + np.exp(1.0 - x.sum(1) * 0.1))

    def f1(t):
        tp, fp = ((p >= t) & (y == 1)).sum(), ((p >= t) & (y == 0)).sum()
        return round(float(2 * tp / (tp + fp + y.sum())), 4) if tp else 0.0

    best = training.evaluate(df, model)
    tried = [round(0.05 + 0.02 * i, 2) for i in range(31)]
    assert best["f1"] == max(map(f1, tried)) and best["threshold"] == next(t for t in tried if f1(t) == best["f1"])
    assert training.evaluate(df, model, 0.99)["precision"] == 0.0 and training.evaluate(df.limit(0), model)["f1"] == 0.0


def test_artifacts(spark, tmp_path):
    store = training.ModelStore(spark, str(tmp_path / "models"))
    assert store.read() is asking.DEFAULT and store.versions() == []
    model = {"intercept": 0.5, "weights": dict.fromkeys(training.NAMES, 2.0)}
    assert store.write(model, {"f1": 0.5}) == "v000001" and store.write({**model, "intercept": 0.7}, {}) == "v000002"
    assert store.read()["intercept"] == 0.7 and store.read()["version"] == "v000002" and store.read()["features"] == training.NAMES
    for broken in ("{", json.dumps({"intercept": 1}), json.dumps({"intercept": 1, "weights": {"semantic": 1}}), json.dumps({"intercept": float("nan"), "weights": model["weights"]})):
        at = f"{tmp_path}/models/v{len(store.versions()) + 1:06d}"
        spark.createDataFrame([(broken,)], "value string").coalesce(1).write.text(at)
        assert store.read()["version"] == "v000002"
    with pytest.raises(ValueError):
        store.write({"intercept": 1.0, "weights": {}}, {})
    half = tmp_path / "models" / "v000099"  # a version that was not finished
    half.mkdir()
    (half / "part-0.txt").write_text(json.dumps(model))
    assert store.read()["version"] == "v000002"


def test_train_writes_a_version(spark, tmp_path):
    _, _, df = rows(spark)
    split = df.withColumn("part", F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), (F.pmod(F.xxhash64("f_semantic"), F.lit(3)) + 1).cast("int")))
    store = training.ModelStore(spark, str(tmp_path))
    out = {r.name: (r.base, r.trained) for r in training.train(split, store, steps=20).collect()}
    assert store.read()["weights"]["headline"] == out["headline"][1] and out["test f1"][1] > 0.6
    assert set(out) == {*training.NAMES, "intercept", "test threshold", "test precision", "test recall", "test f1"}
