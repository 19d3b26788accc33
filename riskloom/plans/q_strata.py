"""Registered queries: risk tiers (2.10 stratification)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import strata as S
from riskloom.plans.oracle import oracle
from riskloom.plans.registry import query
from riskloom.plans.sqlparts import tier_no_sql, tier_sql, with_scored
from riskloom.sources.encounters import scored

_THR = """thr AS (
  SELECT quantile_cont(score, 0.25) FILTER (WHERE label = 1) AS p25,
         quantile_cont(score, 0.50) FILTER (WHERE label = 1) AS p50,
         quantile_cont(score, 0.75) FILTER (WHERE label = 1) AS p75
  FROM scored)"""
_TIERED = "t AS (SELECT s.*, " + tier_sql("s.score", "thr.p25", "thr.p50", "thr.p75") + \
    " AS tier FROM scored s CROSS JOIN thr)"


@query("tier_thresholds")
def q_tier_thresholds(spark, sf_dir):
    thr = S.tier_thresholds(scored(spark, sf_dir, with_groups=False).cache())
    return S.thresholds_frame(spark, thr).select(*[F.round(c, 6).alias(c) for c in ("p25", "p50", "p75")])


oracle("tier_thresholds", with_scored(
    "SELECT round(p25, 6) AS p25, round(p50, 6) AS p50, round(p75, 6) AS p75 FROM thr", _THR))


@query("assign_tier")
def q_assign_tier(spark, sf_dir):
    sc = scored(spark, sf_dir, with_groups=False).cache()
    thr = S.tier_thresholds(sc)
    return S.assign_tier(sc, thr).select("encounter_id", "score", "tier")


oracle("assign_tier", with_scored("SELECT encounter_id, score, tier FROM t", _THR + ",\n" + _TIERED))


@query("tier_summary")
def q_tier_summary(spark, sf_dir):
    sc = scored(spark, sf_dir, with_groups=False).cache()
    return S.tier_summary(sc, S.tier_thresholds(sc))


oracle("tier_summary", with_scored(f"""
SELECT d.tier, d.tier_no, g.cnt AS count, round(g.mean, 6) AS mean
FROM (SELECT tier, {tier_no_sql('tier')} AS tier_no FROM (VALUES ('Low'), ('Medium'), ('High'), ('Critical')) v(tier)) d
LEFT JOIN (SELECT tier, count(*) AS cnt, avg(label) AS mean FROM t GROUP BY tier) g USING (tier)""",
    _THR + ",\n" + _TIERED))


@query("tier_qa")
def q_tier_qa(spark, sf_dir):
    sc = scored(spark, sf_dir, with_groups=False).cache()
    return S.tier_qa(sc, S.tier_thresholds(sc))


_TIER_QA_BODY = f"""
SELECT tier, tier_no, n, round(n / sum(n) OVER (), 6) AS pct_of_total,
       round(rate, 6) AS readmission_rate, round(mean_score, 6) AS mean_score,
       bool_and(ok) OVER () AS monotone
FROM (SELECT *, coalesce(lag(rate) OVER (ORDER BY tier_no) <= rate, true) AS ok
      FROM (SELECT tier, {tier_no_sql('tier')} AS tier_no, count(*) AS n, avg(label) AS rate,
                   avg(score) AS mean_score FROM t GROUP BY tier) g) x"""

oracle("tier_qa", with_scored(_TIER_QA_BODY, _THR + ",\n" + _TIERED))


@query("tier_reindex")
def q_tier_reindex(spark, sf_dir):
    """Counts per tier under the fixed thresholds, imposed on the ordered tier
    dimension (a tier with no rows still appears, with NULL counts)."""
    sc = scored(spark, sf_dir, with_groups=False)
    return S.tier_summary(sc, S.fixed_thresholds())


_FIXED_TIERED = "t AS (SELECT s.*, " + tier_sql("s.score", "0.25", "0.5", "0.75") + " AS tier FROM scored s)"
oracle("tier_reindex", with_scored(f"""
SELECT d.tier, d.tier_no, g.cnt AS count, round(g.mean, 6) AS mean
FROM (SELECT tier, {tier_no_sql('tier')} AS tier_no FROM (VALUES ('Low'), ('Medium'), ('High'), ('Critical')) v(tier)) d
LEFT JOIN (SELECT tier, count(*) AS cnt, avg(label) AS mean FROM t GROUP BY tier) g USING (tier)""", _FIXED_TIERED))
