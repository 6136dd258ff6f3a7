"""The ranker's own model: fitted on questions' candidates with weak labels, kept as versioned artifacts, read with a fall-back."""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import asking, retrieval

#: First intercept and weights, L2 and the bounds of the weight of relevant rows (fixed values).
INTERCEPT, WEIGHT, L2, LEAST_WEIGHT, MOST_WEIGHT = -0.5, 0.5, 0.001, 1.0, 8.0
#: Steps along the mean gradient, and their length (parameters: a step is one aggregation over all rows).
STEPS, RATE = 30, 1.0
#: Thresholds that are tried: the first, the step and the last (fixed values).
LOW, STEP, HIGH = 0.05, 0.02, 0.65
NAMES = list(retrieval.RANKER)


def grade(headline: Column, lexical: Column) -> Column:
    """Weak relevance, 0 to 5, by the shares of the question's tokens in title and text."""
    return F.when(headline >= 0.6, 5).when((headline > 0) & (lexical > 0), 4).when(lexical >= 0.6, 3).when(lexical > 0, 2).otherwise(0)


def _z(model: dict) -> Column:
    return reduce(lambda a, b: a + b, [w * F.col(f"f_{n}") for n, w in model["weights"].items()], F.lit(model["intercept"]))


def fit(rows: DataFrame, steps: int = STEPS, rate: float = RATE) -> dict:
    """Weighted logistic regression of `label` (0 or 1) on f_<name>, by steps along the gradient that one aggregation over all rows gives;
    what reaches the driver is a number a feature. Rows of label 1 weigh as much as the others, within bounds. Without rows the first
    weights stay. Sums do not depend on the order of rows, but for rounding."""
    model = {"intercept": INTERCEPT, "weights": dict.fromkeys(NAMES, WEIGHT)}
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n:
        return model
    heavy = min(MOST_WEIGHT, max(LEAST_WEIGHT, (n - ones) / max(1, ones)))
    for _ in range(steps):
        error = (F.col("label") - 1.0 / (1.0 + F.exp(-_z(model)))) * F.when(F.col("label") == 1, heavy).otherwise(1.0)
        g = rows.withColumn("error", error).agg(F.avg("error").alias("b"), *[F.avg(F.col("error") * F.col(f"f_{x}")).alias(x) for x in NAMES]).first()
        model = {"intercept": model["intercept"] + rate * g.b, "weights": {x: w + rate * (g[x] - L2 * w) for x, w in model["weights"].items()}}
    return {"intercept": round(model["intercept"], 4), "weights": {x: round(w, 4) for x, w in model["weights"].items()}}


def evaluate(rows: DataFrame, model: dict, threshold: float | None = None) -> dict:
    """threshold (the first of best F1, unless given), precision, recall and f1 of the model on rows, from one aggregation."""
    tried = [threshold] if threshold is not None else [round(LOW + STEP * i, 2) for i in range(round((HIGH - LOW) / STEP) + 1)]
    scored = rows.select("label", (1.0 / (1.0 + F.exp(-_z(model)))).alias("p"))
    hit = lambda t, y: F.count_if((F.col("p") >= t) & (F.col("label") == y))
    got = scored.agg(F.count_if(F.col("label") == 1), *[hit(t, y) for t in tried for y in (1, 0)]).first()
    best = None
    for i, t in enumerate(tried):
        tp, fp = got[1 + 2 * i], got[2 + 2 * i]
        f1 = 2 * tp / (tp + fp + got[0]) if tp else 0.0
        if best is None or f1 > best["f1"]:
            best = {"threshold": t, "precision": round(tp / (tp + fp), 4) if tp + fp else 0.0, "recall": round(tp / got[0], 4) if got[0] else 0.0, "f1": round(f1, 4)}
    return best


def valid(model) -> bool:
    """A model has a number for the intercept and one for each feature, and no others."""
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)
    return isinstance(model, dict) and number(model.get("intercept")) and isinstance(model.get("weights"), dict) and set(model["weights"]) == set(NAMES) and all(map(number, model["weights"].values()))


class ModelStore:
    """Versions of the model under one folder in shared storage, each a JSON text that is whole once its folder says so."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [f.getPath() for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(p.getName() for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def write(self, model: dict, metrics: dict) -> str:
        """Adds a version, and gives its name. Models that are not valid are refused."""
        if not valid(model):
            raise ValueError("not a model of the ranker's features")
        name = f"v{1 + max([int(v[1:]) for v in self.versions()], default=0):06d}"
        self.spark.createDataFrame([(json.dumps({**model, "version": name, "features": NAMES, "metrics": metrics}),)], "value string").coalesce(1).write.text(f"{self.root}/{name}")
        return name

    def read(self) -> dict:
        """The latest version that is valid; the default model if none is."""
        for name in reversed(self.versions()):
            try:
                model = json.loads("".join(r.value for r in self.spark.read.text(f"{self.root}/{name}", wholetext=True).collect()))
            except ValueError:
                continue
            if valid(model):
                return model
        return asking.DEFAULT


def labelled(features: DataFrame) -> DataFrame:
    """f_<name>, label and part of candidates: the first 60 % of the time for training, then 20 % each for validation and test, by quantiles."""
    rows = features.select(*[f"f_{n}" for n in NAMES], (grade(F.col("headline"), F.col("lex")) >= 3).cast("int").alias("label"), F.unix_timestamp("published_at").alias("at"))
    cuts = rows.select(F.percentile_approx("at", [0.6, 0.8], 10_000).alias("c"))
    return rows.join(F.broadcast(cuts)).withColumn("part", F.when(F.col("at") > F.col("c")[1], "test").when(F.col("at") > F.col("c")[0], "validation").otherwise("train")).drop("at", "c")


def train(rows: DataFrame, store: ModelStore, steps: int = STEPS) -> DataFrame:
    """Fits, measures against the default model, writes a version; (name, base, trained) of the weights and of the test's metrics."""
    part = lambda p: rows.where(F.col("part") == p).drop("part")
    model = fit(part("train"), steps)
    results = {}
    for name, m in (("base", asking.DEFAULT), ("trained", model)):
        results[name] = evaluate(part("test"), m, evaluate(part("validation"), m)["threshold"])
    store.write(model, results)
    lines = [(x, float(asking.DEFAULT["weights"][x]), model["weights"][x]) for x in NAMES] + [("intercept", float(asking.DEFAULT["intercept"]), model["intercept"])]
    lines += [(f"test {k}", float(results["base"][k]), float(results["trained"][k])) for k in ("threshold", "precision", "recall", "f1")]
    return store.spark.createDataFrame(lines, "name string, base double, trained double")
