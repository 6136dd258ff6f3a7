"""Pairs of similar word sets: all of them, and no work with the square of the sets that share a word by chance."""

import random

from newsloom.operators import syndication


def test_similar_pairs_against_all(spark, tmp_path):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)]
    sets = []
    for _ in range(60):
        s = set(rng.sample(vocabulary, rng.randint(1, 25)))
        sets.append(s)
        for _ in range(3):
            sets.append({w for w in s if rng.random() > 0.15} | set(rng.sample(vocabulary, rng.randint(0, 2))) or {"w0"})
    sets += [set(vocabulary[:13]), set(vocabulary[:20]), set(vocabulary[:14])]  # 13 of 20 is 0.65, which is not above it; 14 of 20 is
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and 20 * len(a & b) > 13 * len(a | b)}
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "leader long, words array<string>")
    found = [tuple(r) for r in syndication.similar_pairs(rows, keeper(tmp_path)).collect()]
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 100


def test_chance_meetings_are_not_written(spark, tmp_path):
    """Sets that share rare words, but too few: with the prefixes alone each word's group gave all of its pairs to a shuffle."""
    rng = random.Random(8)
    shared = [f"rare{i}" for i in range(3)]
    sets = [(i, sorted([*shared, *(f"own{i}x{k}" for k in range(2)), *rng.sample([f"often{k}" for k in range(300)], 25)])) for i in range(400)]
    rows = spark.createDataFrame(sets, "leader long, words array<string>")
    met = syndication.similar_pairs(rows, keeper(tmp_path))
    met.collect()
    assert met.count() == 0 and _most_rows(met) < 400 * 399 / 2 / 10


def keeper(tmp_path):
    def keep(df, name):
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{tmp_path}/{name}")

    return keep


def _most_rows(df) -> int:
    """The most rows that a join of the plan that ran gave."""
    found, todo = [0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        if hasattr(p, "plan") and name.endswith("QueryStageExec"):
            todo.append(p.plan())
        if "Join" in name and p.metrics().contains("numOutputRows"):
            found.append(p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return max(found)
