"""Plans that grew with the width of the table, not its rows: one aggregate over all columns
is generated code too big to be compiled, and an input read twice is derived twice."""

import pytest
from pyspark.sql import functions as F

from riskloom.operators import cleaning as K
from riskloom.operators import selection as SEL
from riskloom.operators.features import FeatureModel
from riskloom.session import written


def wide(spark, features=3):
    rows = [(i % 2, *[None if (i + j) % 7 == 0 else float(i * (j + 1) % 11) for j in range(features)]) for i in range(60)]
    return spark.createDataFrame(rows, "y int, " + ", ".join(f"f{j} double" for j in range(features))), [f"f{j}" for j in range(features)]


def text(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("score", [SEL.mutual_info, SEL.abs_correlation, SEL.mean_difference])
def test_scores_aggregate_one_feature_at_a_time(spark, score):
    few, names = wide(spark, 3)
    many, all_names = wide(spark, 12)
    calls = ("covar_pop(", "stddev_pop(", "avg(", "min(")
    sizes = [sum(text(score(df, f, "y")).count(c) for c in calls) for df, f in ((few, names), (many, all_names))]
    assert sizes[0] == sizes[1]


def test_scores_of_every_feature_by_hand(spark):
    df, names = wide(spark)
    df = df.withColumn("flat", F.lit(4.0)).withColumn("void", F.lit(None).cast("double"))
    names = [*names, "flat", "void"]
    rows = df.collect()
    corr = {r["feature"]: r["abs_corr"] for r in SEL.abs_correlation(df, names, "y").collect()}
    smd = {r["feature"]: r["smd"] for r in SEL.mean_difference(df, names, "y").collect()}
    mi = {r["feature"]: r["mi_score"] for r in SEL.mutual_info(df, names, "y").collect()}
    assert set(corr) == set(smd) == set(mi) == set(names)
    assert corr["flat"] == corr["void"] == smd["flat"] == smd["void"] == 0.0
    assert mi["flat"] == pytest.approx(0.0) and mi["void"] == pytest.approx(0.0)
    for c in names[:3]:
        pairs = [(r[c], r["y"]) for r in rows if r[c] is not None]
        mean = sum(v for v, _ in pairs) / len(pairs)
        std = (sum((v - mean) ** 2 for v, _ in pairs) / len(pairs)) ** 0.5
        one, zero = ([v for v, y in pairs if y == k] for k in (1, 0))
        gap = abs(sum(one) / len(one) - sum(zero) / len(zero))
        assert smd[c] == pytest.approx(gap / std)
        share = len(one) / len(pairs)
        assert corr[c] == pytest.approx(gap / std * (share * (1 - share)) ** 0.5)
        assert mi[c] > 0


def test_scores_of_an_empty_table(spark):
    df, names = wide(spark)
    empty = df.limit(0)
    assert [r["abs_corr"] for r in SEL.abs_correlation(empty, names, "y").collect()] == [0.0] * 3
    assert [r["smd"] for r in SEL.mean_difference(empty, names, "y").collect()] == [0.0] * 3
    assert SEL.mutual_info(empty, names, "y").collect() == []


def test_constant_profile_leaves_out_missing_columns_in_one_pass(spark):
    df = spark.createDataFrame([(1, "a", None, 3), (2, "a", None, None), (3, None, "x", None)], "k int, a string, b string, c int")
    one = K.constant_profile(df, exclude=("k",), max_missing=60.0)
    assert sorted(map(tuple, one.collect())) == [("a", True)]
    assert sorted(map(tuple, K.constant_profile(df, exclude=("k",)).collect())) == [("a", True), ("b", True), ("c", True)]
    assert text(one).split("== Optimized Logical Plan ==")[1].split("== Physical")[0].count("LogicalRDD") == 1


def test_row_constraints_derives_its_input_once(spark, monkeypatch):
    from riskloom.operators import quality as Q
    from riskloom.plans import q_quality
    bad = spark.range(1).select(*[F.lit("abc").alias(f[0]) for f in Q.REQUEST_FIELDS])
    monkeypatch.setattr(q_quality, "featured", lambda *_: bad)
    got = q_quality.q_row_constraints(spark, "")
    n = {r["violation"]: r["n"] for r in got.collect()}
    assert n.pop("valid") == 0 and n and set(n.values()) == {1}
    assert text(got).split("== Analyzed Logical Plan ==")[1].split("==")[0].count("Range (") == 1


def test_diagnosis_codes_are_parsed_once_a_row(spark):
    df = spark.createDataFrame([("250.5", "V10", "x"), (None, " 401 ", "E1")], "diag_1 string, diag_2 string, diag_3 string")
    out = FeatureModel(None, None).transform(df)
    plan = text(out).split("== Optimized Logical Plan ==")[1].split("==")[0]
    assert plan.count("substring_index") == 3
    assert [(r["diag_1_category"], r["diag_2_category"], r["diag_3_category"], r["primary_diag_high_risk"]) for r in out.collect()] == [
        ("Endocrine", "External", "Other", 1), ("Other", "Circulatory", "External", 0)]
    assert not [c for c in out.columns if c.startswith("_")]


def test_written_bounds_the_rows_of_a_file(spark):
    t = written(spark.range(0, 100, 1, 1), "bounded", 30)
    assert len(t.inputFiles()) == 4 and t.count() == 100


def test_correlations_aggregate_one_pair_at_a_time(spark):
    from riskloom.operators.explore import correlation_matrix
    few, names = wide(spark, 3)
    many, all_names = wide(spark, 12)
    plans = [text(correlation_matrix(df, f)).split("== Physical Plan ==")[1] for df, f in ((few, names), (many, all_names))]
    assert plans[0].count("covar_pop(") == plans[1].count("covar_pop(") > 0
    rows = {(r["col_a"], r["col_b"]): r["corr"] for r in correlation_matrix(few.withColumn("void", F.lit(None).cast("int")), [*names, "void"]).collect()}
    assert set(rows) == {("f1", "f0"), ("f2", "f0"), ("f2", "f1"), ("void", "f0"), ("void", "f1"), ("void", "f2")}
    assert all(rows[p] is None for p in rows if "void" in p)
    for a, b in (("f1", "f0"), ("f2", "f1")):
        pairs = [(r[a], r[b]) for r in few.collect() if r[a] is not None and r[b] is not None]
        mx, my = (sum(p[k] for p in pairs) / len(pairs) for k in (0, 1))
        cov = sum((x - mx) * (y - my) for x, y in pairs)
        norm = (sum((x - mx) ** 2 for x, _ in pairs) * sum((y - my) ** 2 for _, y in pairs)) ** 0.5
        assert rows[a, b] == pytest.approx(cov / norm, abs=2e-6)
    assert [r["corr"] for r in correlation_matrix(few.limit(0), names).collect()] == [None] * 3


def test_shuffles_follow_the_rows_of_the_input(spark, tmp_path, monkeypatch):
    from riskloom import session as S
    from riskloom.sources.encounters import encounters
    spark.range(40).selectExpr("id as o_orderkey", "id % 7 as o_custkey", "timestamp_seconds(id * 86400) as o_orderdate",
                               "'1-URGENT' as o_orderpriority").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(7).selectExpr("id as c_custkey", "'x' as c_mktsegment").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(120).selectExpr("id % 40 as l_orderkey", "id as l_partkey", "'R' as l_returnflag").write.parquet(str(tmp_path / "lineitem.parquet"))
    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    was = spark.conf.get(first, None)
    try:
        spark.conf.unset(first)
        assert encounters(spark, str(tmp_path)).count() == 40
        assert spark.conf.get(first, None) is None      # few rows: as the session has it
        monkeypatch.setattr(S.follow_rows, "__defaults__", (4,))
        plan = text(encounters(spark, str(tmp_path))).split("== Physical Plan ==")[1]
        assert "hashpartitioning(l_orderkey" in plan and ", 30)" in plan
        S.follow_rows(spark, 8)
        assert spark.conf.get(first) == "30"            # never lowered
        assert encounters(spark, str(tmp_path)).count() == 40
    finally:
        spark.conf.unset(first)
        if was is not None:
            spark.conf.set(first, was)
