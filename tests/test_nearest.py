"""Nearest vectors by blocks against the plain comparison, with ties, nulls and vectors without a length."""

import math

import numpy as np

from newsloom.operators import nearest


def test_nearest_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearest, "ROWS", 7)
    monkeypatch.setattr(nearest, "QUERIES", 3)
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(60)]
    rows[5], rows[8], rows[11], rows[20] = (5, None), (8, [1.0, None, 0.0, 0.0]), (11, [0.0] * 4), (20, [1.0, 2.0])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    found = [tuple(r) for r in nearest.nearest(df, df.where("vec_id % 10 IN (0, 5)"), 4).collect()]

    def sim(a, b):
        if a is None or b is None or None in a or None in b or len(a) != len(b):
            return None
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return float(np.round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 6)) if n else math.nan

    want = []
    for i, a in rows:
        if i % 10 in (0, 5):
            near = [(sim(a, b), j) for j, b in rows if j != i]
            near.sort(key=lambda p: (math.inf if p[0] is None else -math.inf if math.isnan(p[0]) else -p[0], p[1]))
            want += [(i, j, s, n + 1) for n, (s, j) in enumerate(near[:4])]
    assert sorted(map(str, found)) == sorted(map(str, want))


def test_a_pair_costs_no_row(spark):
    """Rows of the plan are blocks; before, each pair of a query and a vector was one."""
    df = spark.range(3000).selectExpr("id AS vec_id", "array(cast(id % 7 AS float), cast(id % 11 AS float), 1f) AS embedding").coalesce(1)
    blocks = nearest._packed(df, nearest.ROWS, "e").crossJoin(nearest._packed(df.where("vec_id % 100 = 0"), nearest.QUERIES, "q"))
    assert blocks.count() == 1 and nearest.nearest(df, df.where("vec_id % 100 = 0"), 3).count() == 90
