"""Pooling over score ranges: against plain pooling of all rows and MLlib's fit."""

import random

import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from riskloom.operators import model as MD
from riskloom.operators.isotonic import pooled_blocks


def plain_blocks(rows):
    counts = {}
    for x, y in rows:
        if x is not None and y is not None:
            n, pos = counts.get(x, (0, 0))
            counts[x] = (n + 1, pos + y)
    out = []
    for x in sorted(counts):
        out.append([x, x, *counts[x]])
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            _, hi, n, pos = out.pop()
            out[-1][1:] = [hi, out[-1][2] + n, out[-1][3] + pos]
    return [tuple(b) for b in out]


def drawn(kind, n=4000):
    rng = random.Random(kind)
    if kind == "ties":
        return [(round(rng.random(), 2), int(rng.random() < 0.4)) for _ in range(n)]
    if kind == "falling":       # one block over all ranges
        return [(i / n, int(rng.random() < 1 - i / n)) for i in range(n)]
    if kind == "rising":
        return [(i / n, int(rng.random() < (i / n) ** 2)) for i in range(n)]
    if kind == "one score":
        return [(0.5, i % 2) for i in range(50)]
    if kind == "one class":
        return [(i / 50, 1) for i in range(50)]
    return [(None, 1), (0.2, None), (0.3, 1), (0.1, 0)]


@pytest.mark.parametrize("kind", ["ties", "falling", "rising", "one score", "one class", "nulls"])
def test_blocks_equal_plain_pooling(spark, kind):
    rows = drawn(kind)
    df = spark.createDataFrame(rows, "s double, y int").repartition(8)
    got = pooled_blocks(df, "y", "s", block=150, fan=3)
    assert [tuple(r)[:4] for r in got.orderBy("lo").collect()] == plain_blocks(rows)


def test_fit_equals_fit_of_all_rows(spark):
    rng = random.Random(2)
    rows = [(x, float(rng.random() < 0.2 + 0.5 * x)) for x in (round(rng.random(), 3) for _ in range(3000))]
    df = spark.createDataFrame(rows, "raw_score double, y double")
    whole = IsotonicRegression(featuresCol="raw_score", labelCol="y", predictionCol="score").fit(df)
    probe = spark.range(1200).select((F.col("id") / 1000 - 0.1).alias("raw_score"))
    got, want = ([r[0] for r in m.transform(probe).orderBy("raw_score").select("score").collect()]
                 for m in (MD.fit_isotonic(df, "y"), whole))
    assert max(abs(a - b) for a, b in zip(got, want)) < 1e-12
