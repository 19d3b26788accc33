"""Grouped operators keep rows without key, time, group or label, and survive hot keys."""

import datetime as dt

from pyspark.sql import functions as F

from riskloom.functions.cumulative import grouped_exact_quantiles, prefix_sums
from riskloom.operators.encode import OrdinalEncoder
from riskloom.operators.explore import box_stats
from riskloom.operators.quality import row_constraints
from riskloom.operators.sequence import entity_sequence
from riskloom.operators.split import stratified_split


def test_entity_sequence_keeps_null_key_and_date(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    rows = [(1, "a", day(0)), (2, "a", day(40)), (3, None, day(3)), (4, None, day(5)), (5, "a", None), (6, None, None)]
    df = spark.createDataFrame(rows, "id int, k string, ts timestamp")
    got = {r["id"]: (r["nxt"], r["n"]) for r in entity_sequence(df, "k", "ts", "id", "nxt", {"n": F.lit(True)}).collect()}
    assert got == {5: (day(0), 0), 1: (day(40), 1), 2: (None, 2), 6: (day(3), 0), 3: (day(5), 1), 4: (None, 2)}


def test_prefix_sums_and_quantiles_keep_the_null_group(spark):
    df = spark.createDataFrame([(None, float(i), 1) for i in range(5)] + [("x", float(i), 1) for i in range(3)], "g string, v double, c int")
    got = prefix_sums(df, "v", {"s": "c"}, group_cols=["g"]).collect()
    assert sorted((r["g"] or "", r["v"], r["s"]) for r in got) == [("", float(i), i + 1) for i in range(5)] + [("x", float(i), i + 1) for i in range(3)]
    assert grouped_exact_quantiles(df, "v", ["g"], [0.5]) == {(None,): [2.0], ("x",): [1.0]}


def test_split_with_null_label_and_repeated_key(spark):
    rows = [(i, i % 2) for i in range(40)] + [(100 + i, None) for i in range(20)] + [(7, 1)] * 30
    df = spark.createDataFrame(rows, "encounter_id long, label int")
    out = stratified_split(df).groupBy("label", "split").count().collect()
    assert sum(r["count"] for r in out) == len(rows)
    assert {r["split"] for r in out if r["label"] is None} == {"train", "val", "test"}


def test_box_stats_with_null_class(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("", 10.0)], "c string, x double")
    got = {r["c"]: (r["min"], r["median"], r["max"]) for r in box_stats(df, ["x"], "c").collect()}
    assert got == {None: (1.0, 2.0, 3.0), "": (10.0, 10.0, 10.0)}


def test_bad_requests_are_rejected_not_fatal(spark):
    fields = (("n", "int", True, 0, 5, None), ("x", "double", False, 0, None, 1.5))
    df = spark.createDataFrame([("3", "2.5"), ("abc", None), ("0.7", "x"), (None, "-1"), ("9", "1")], "n string, x string")
    got = [(r["n"], r["x"], r["violations"]) for r in row_constraints(df, fields).collect()]
    assert got == [(3, 2.5, []), (None, 1.5, ["n:type"]), (None, 1.5, ["n:type", "x:type"]),
                   (None, -1.0, ["n:missing", "x:ge"]), (9, 1.0, ["n:le"])]


def test_encoder_of_a_hundred_thousand_values(spark):
    df = spark.range(100_000).select(F.md5(F.col("id").cast("string")).alias("c"))
    out = OrdinalEncoder(["c"]).fit(df).transform(df.withColumn("v", F.col("c")))
    r = out.agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.countDistinct("c").alias("n")).first()
    assert (r["lo"], r["hi"], r["n"]) == (0.0, 99_999.0, 100_000)
    first = out.orderBy("v").limit(50).collect()
    assert [x["c"] for x in first] == [float(i) for i in range(50)]
