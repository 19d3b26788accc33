"""Stored sketches against exact answers."""

import pytest
from pyspark.sql import functions as F

from riskloom.operators import explore as E
from riskloom.operators import sketches as S


@pytest.fixture(scope="module")
def data(spark):
    d = spark.range(200_000).withColumn("day", F.col("id") % 7)
    hot = F.when(F.col("id") % 5 == 0, "hot").when(F.col("id") % 11 == 0, "warm").otherwise(F.concat(F.lit("v"), F.col("id").cast("string")))
    return d.select("day", "id", hot.alias("skewed"), F.when(F.col("id") % 3 > 0, F.concat(F.lit(""), (F.col("id") % 40).cast("string")))
                    .when(F.col("id") % 2 == 0, "").alias("few"), F.lit(None).cast("string").alias("void"))


def test_nearly_unique_columns_within_error(spark, data, tmp_path):
    path = str(tmp_path / "sketches")
    S.store(S.column_sketches(data, ["id", "skewed", "few", "void"], "day", tracked=1000), path)
    parts = S.stored(spark, path)
    assert parts.count() == 28
    merged = S.merge(parts, tracked=1000).cache()
    got = {(r["column"], r["rank"]): r for r in S.estimates(merged, 2, 1000).collect()}
    n = data.count()
    exact = data.agg(F.count_distinct("skewed").alias("s"), F.count_if(F.col("skewed") == "hot").alias("hot"), F.count_if(F.col("skewed") == "warm").alias("warm")).first()
    assert got["id", None]["value"] is None and abs(got["id", None]["n_unique"] - n) <= 3 * S.distinct_error() * n
    assert abs(got["skewed", 1]["n_unique"] - exact["s"]) <= 3 * S.distinct_error() * exact["s"]
    assert got["skewed", 1]["value"] == "hot" and abs(got["skewed", 1]["n"] - exact["hot"]) <= S.top_error(1000) * n
    assert got["skewed", 2]["value"] == "warm" and abs(got["skewed", 2]["n"] - exact["warm"]) <= S.top_error(1000) * n
    assert not any(c == "void" for c, _ in got)
    sums = {r["column"]: (r["n"], r["nulls"]) for r in merged.collect()}
    assert sums["void"] == (0, n) and sum(sums["few"]) == n
    # built at once: the same answers
    once = S.merge(S.column_sketches(data, ["id", "skewed", "few", "void"], F.lit(0), tracked=1000), tracked=1000)
    uniq = lambda m: {r["column"]: r["n_unique"] for r in S.estimates(m, 1, 1000).collect()}
    assert uniq(once) == uniq(merged)


def test_few_values_are_exact(data):
    got = S.estimates(S.merge(S.column_sketches(data, ["few"], "day")), 3)
    want = E.cardinality_top(data, ["few"], 3)
    key = lambda df: sorted(tuple(r) for r in df.select("column", "value", "n", "rank", "n_unique").collect())
    assert key(got) == key(want)


def test_reload_replaces_one_part(spark, data, tmp_path):
    path = str(tmp_path / "s")
    S.store(S.column_sketches(data.where("day < 3"), ["few"], "day"), path)
    S.store(S.column_sketches(data.where("day = 2").limit(10), ["few"], "day"), path)
    n = {r["part"]: r["n"] + r["nulls"] for r in S.stored(spark, path).collect()}
    assert n[2] == 10 and n[0] == data.where("day = 0").count() and len(n) == 3


def test_values_are_not_shuffled(data):
    plan = S.column_sketches(data, ["id", "skewed"], "day")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_theta_sketch_agg" in plan


def test_empty(spark):
    none = spark.createDataFrame([], "part int, a string")
    assert S.estimates(S.merge(S.column_sketches(none, ["a"], "part"))).count() == 0
