"""Encounter, scored-population and prediction-log inputs derived from the
driver tables (orders ⋈ customer ⟕ lineitem; events).

An order is an encounter, a customer a patient; "readmitted" is a re-order
within 30 days.  The derivation is deterministic so the same expressions serve
Spark and the SQL oracle (``riskloom.plans.oracle``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import exprs as X
from riskloom.operators.sequence import entity_sequence
from riskloom.session import follow_rows
from riskloom.sources.tables import read_table


def _s(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def lineitem_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_returnflag"])
    return li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_distinct("l_partkey").alias("n_parts"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).cast("long").alias("n_ret"),
        F.min("l_partkey").alias("p1"),
        F.max("l_partkey").alias("p2"))


def order_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders",
                   ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"])
    pr = F.col("o_orderpriority")
    return entity_sequence(
        o, key="o_custkey", ts="o_orderdate", tiebreak="o_orderkey", next_name="nx",
        prior_counts={"n_out": pr.isin("4-NOT SPECIFIED", "5-LOW"),
                      "n_emg": pr == "1-URGENT",
                      "n_inp": pr == "2-HIGH"})


def encounter_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders(+history) ⋈ customer ⟕ lineitem summary, the raw key columns."""
    # the files' footers give the counts
    follow_rows(spark, max(read_table(spark, sf_dir, t).count() for t in ("lineitem", "orders")))
    o = order_history(spark, sf_dir)
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment"])
    li = lineitem_summary(spark, sf_dir)
    return (o.join(c, o.o_custkey == c.c_custkey)
             .join(li, o.o_orderkey == li.l_orderkey, "left"))


def _encounter_columns() -> list:
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    p1, p2 = F.col("p1"), F.col("p2")
    age_lo = (ck * 7 % 10) * 10
    ddiff = F.datediff(F.col("nx").cast("date"), F.col("o_orderdate").cast("date"))
    return [
        ok.alias("encounter_id"),
        ck.alias("patient_nbr"),
        F.when(ck % 50 == 0, "?").otherwise(F.col("c_mktsegment")).alias("race"),
        F.when(ck % 101 == 0, "Unknown/Invalid").when(ck % 2 == 0, "Male")
         .otherwise("Female").alias("gender"),
        F.concat(F.lit("["), age_lo.cast("string"), F.lit("-"),
                 (age_lo + 10).cast("string"), F.lit(")")).alias("age"),
        F.when(ok % 30 == 0, "[75-100)").otherwise("?").alias("weight"),
        F.when(ck % 3 == 0, "?").otherwise("MC").alias("payer_code"),
        F.lit("No").alias("examide"),
        F.lit("No").alias("citoglipton"),
        F.lit("No").alias("troglitazone"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("admission_type_id"),
        (1 + ck % 5).alias("discharge_disposition_id"),
        (1 + ok % 7).alias("admission_source_id"),
        (1 + ok % 14).alias("time_in_hospital"),
        (1 + (ok * 13) % 100).alias("num_lab_procedures"),
        F.col("n_ret").alias("num_procedures"),
        F.col("n_parts").alias("num_medications"),
        F.col("n_lines").alias("number_diagnoses"),
        F.coalesce("n_out", F.lit(0)).cast("long").alias("number_outpatient"),
        F.coalesce("n_emg", F.lit(0)).cast("long").alias("number_emergency"),
        F.coalesce("n_inp", F.lit(0)).cast("long").alias("number_inpatient"),
        F.when(p1 % 17 == 0, F.concat(F.lit("V"), _s(p1 % 90)))
         .when(p1 % 19 == 0, F.concat(F.lit("E"), _s(p1 % 999)))
         .when(p1 % 23 == 0, "?").otherwise(_s(p1 % 1000)).alias("diag_1"),
        F.concat(_s(p2 % 1000), F.lit("."), _s(p2 % 100)).alias("diag_2"),
        F.when((p1 + p2) % 29 == 0, "V").when((p1 + p2) % 31 == 0, "x12")
         .otherwise(_s((p1 + p2) % 1100)).alias("diag_3"),
        F.when(ok % 6 == 0, ">8").when(ok % 6 == 1, ">7").when(ok % 6 == 2, "Norm")
         .when(ok % 6 == 3, "?").otherwise("None").alias("A1Cresult"),
        F.when(ok % 8 == 0, ">300").when(ok % 8 == 1, ">200").when(ok % 8 == 2, "Norm")
         .otherwise("None").alias("max_glu_serum"),
        _cycle((ok + ck) % 5, ["Steady", "Up", "?"], "No").alias("metformin"),
        _cycle((ok * 5 + ck) % 7, ["Steady", "Down"], "No").alias("glipizide"),
        _cycle((ok * 3 + ck) % 4, ["No", "Steady", "Up"], "Down").alias("insulin"),
        F.when(ok % 3 == 0, "Ch").otherwise("No").alias("change"),
        F.when(ck % 4 == 0, "No").otherwise("Yes").alias("diabetesMed"),
        F.when(F.col("nx").isNull(), "NO").when(ddiff < 30, "<30").otherwise(">30")
         .alias("readmitted"),
    ]


def _cycle(k, values, other) -> F.Column:
    e = None
    for i, v in enumerate(values):
        e = F.when(k == i, v) if e is None else e.when(k == i, v)
    return e.otherwise(other)


def encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw encounter table (FIXTURES A): one row per order."""
    return encounter_base(spark, sf_dir).select(*_encounter_columns())


def scored(spark: SparkSession, sf_dir: str, with_groups: bool = True) -> DataFrame:
    """Scored population (FIXTURES B): key, label, tie-rich integer score, subgroup dims."""
    b = encounter_base(spark, sf_dir)
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    ddiff = F.datediff(F.col("nx").cast("date"), F.col("o_orderdate").cast("date"))
    label = F.coalesce(F.col("nx").isNotNull() & (ddiff < 30), F.lit(False)).cast("int")
    milli = F.least(F.lit(999).cast("long"),
                    (ok * 7919) % 700 + 100 * F.coalesce("n_inp", F.lit(0)))
    cols = [ok.alias("encounter_id"), label.alias("label"), milli.alias("score_milli"),
            (milli / F.lit(1000.0)).alias("score")]
    if not with_groups:
        return b.select(*cols)
    age_lo = (ck * 7 % 10) * 10
    age = F.concat(F.lit("["), age_lo.cast("string"), F.lit("-"),
                   (age_lo + 10).cast("string"), F.lit(")"))
    gender = F.when(ck % 101 == 0, "Unknown/Invalid").when(ck % 2 == 0, "Male") \
        .otherwise("Female")
    p1 = F.col("p1")
    diag1 = F.when(p1 % 17 == 0, F.concat(F.lit("V"), _s(p1 % 90))) \
        .when(p1 % 19 == 0, F.concat(F.lit("E"), _s(p1 % 999))) \
        .when(p1 % 23 == 0, "?").otherwise(_s(p1 % 1000))
    # raw strings first, categories in a second projection: each raw expression is
    # then evaluated once instead of being inlined into every branch that reads it.
    raw = b.select(*cols, age.alias("_age"), gender.alias("_gender"),
                   X.sentinel_null(diag1).alias("_diag1"))
    return raw.select("encounter_id", "label", "score_milli", "score",
                      X.age_risk_bucket("_age").alias("age_risk_bucket"),
                      X.gender_code("_gender").alias("gender"),
                      X.icd_category("_diag1").alias("diag_1_category"))


def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction log (FIXTURES D) from ``events``."""
    e = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    return e.select(
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("endpoint"),
        (F.col("event_type") == "error").alias("is_error"),
        (F.least(F.col("value"), F.lit(100.0)) / F.lit(100.0)).alias("risk_score"),
        (F.col("value") / F.lit(200.0)).alias("latency_s"),
        F.col("user_id").alias("batch_id"))
