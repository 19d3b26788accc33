"""Scalar column expressions (all JVM-side, codegen-friendly; no Python UDFs).

Each builder returns a ``Column``; ``register(spark)`` exposes the main ones
as SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from riskloom import config as C


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(cond: Column) -> Column:
    """Boolean → 0/1 where NULL counts as false (pandas ``NaN == x`` is False)."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def ne_null_true(c, value) -> Column:
    """pandas ``s != value``: NULL is *unequal* (true)."""
    return ~col(c).eqNullSafe(F.lit(value))


def sentinel_null(c, token: str = "?") -> Column:
    return F.nullif(col(c), F.lit(token))


def binary_target(c=C.TARGET_COL, positive: str = C.POSITIVE_CLASS) -> Column:
    return col(c).eqNullSafe(F.lit(positive)).cast("int")


# ---- age ------------------------------------------------------------------
def age_numeric(c="age", brackets=C.AGE_BRACKETS) -> Column:
    """Bracket → ordinal position; unmapped or NULL → 0."""
    m = F.create_map(*[x for i, b in enumerate(brackets) for x in (F.lit(b), F.lit(i))])
    return F.coalesce(m[col(c)], F.lit(0))


def age_risk_bucket(c="age", brackets=C.AGE_BRACKETS) -> Column:
    idx = age_numeric(c, brackets)
    return (F.when(col(c).isNull(), "Unknown")
            .when(idx <= 2, "Young")
            .when(idx <= 5, "Middle")
            .otherwise("Elderly"))


def gender_code(c="gender") -> Column:
    return F.when(col(c) == "Male", 0).when(col(c) == "Female", 1).otherwise(-1)


# ---- ICD-9 style diagnosis codes ------------------------------------------
def icd_number(c) -> Column:
    """Numeric part before the first '.', NULL when unparsable."""
    stripped = F.regexp_replace(col(c), r"^\s+|\s+$", "")
    return F.substring_index(stripped, ".", 1).try_cast("double")


def icd_category(c, num: Column | None = None) -> Column:
    """Diagnosis code → category (NULL/?/E/V/nan → Other; V*/E* → External; ranges; else Other).

    ``num``: a column that holds ``icd_number`` of the code already; without it every range
    parses the code again."""
    raw = col(c)
    stripped = F.regexp_replace(raw, r"^\s+|\s+$", "")
    num = icd_number(raw) if num is None else num
    expr = F.when(raw.isNull() | raw.isin(*C.ICD_OTHER_TOKENS), "Other") \
        .when(stripped.startswith("V") | stripped.startswith("E"), "External")
    for lo, hi, name in C.ICD_RANGES:
        expr = expr.when((num >= lo) & (num <= hi), name)
    return expr.otherwise("Other")


# ---- tiers ------------------------------------------------------------------
def risk_tier(score, p25, p50, p75) -> Column:
    """Low/Medium/High/Critical with strict ``<`` cut points (Column or literal)."""
    s = col(score)
    return (F.when(s < p25, "Low").when(s < p50, "Medium")
            .when(s < p75, "High").otherwise("Critical"))


def tier_no(tier) -> Column:
    m = F.create_map(*[x for i, t in enumerate(C.TIER_NAMES) for x in (F.lit(t), F.lit(i))])
    return m[col(tier)]


# ---- explicit-edge binning (binary-float edges like numpy.linspace) -------
def safe_corr(a, b) -> Column:
    """Pearson correlation over the rows where both are known; NULL for a constant side."""
    a, b = col(a).cast("double"), col(b).cast("double")
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def linspace(lo: float, hi: float, n: int) -> list[float]:
    """numpy.linspace without numpy: same float results for the edges we use."""
    if n == 1:
        return [float(lo)]
    step = (hi - lo) / (n - 1)
    out = [lo + i * step for i in range(n)]
    out[-1] = float(hi)
    return out


def left_closed_bin(score, edges: list[float]) -> Column:
    """Index i with edges[i] <= s < edges[i+1]; NULL when in no bin (e.g. s == last edge)."""
    s = col(score)
    expr = None
    for i in range(len(edges) - 1):
        cond = (s >= F.lit(edges[i])) & (s < F.lit(edges[i + 1]))
        expr = F.when(cond, i) if expr is None else expr.when(cond, i)
    return expr


def register(spark: SparkSession) -> None:
    """Expose ``icd_category`` and ``risk_tier`` as SQL functions."""
    whens = " ".join(f"WHEN n BETWEEN {lo} AND {hi} THEN '{name}'" for lo, hi, name in C.ICD_RANGES)
    toks = ", ".join(f"'{t}'" for t in C.ICD_OTHER_TOKENS)
    spark.sql(f"""
      CREATE OR REPLACE TEMPORARY FUNCTION icd_category_of_number(n DOUBLE) RETURNS STRING
      RETURN CASE {whens} ELSE 'Other' END""")
    spark.sql(f"""
      CREATE OR REPLACE TEMPORARY FUNCTION icd_category(code STRING) RETURNS STRING
      RETURN CASE WHEN code IS NULL OR code IN ({toks}) THEN 'Other'
                  WHEN regexp_replace(code, '^\\\\s+|\\\\s+$', '') LIKE 'V%'
                    OR regexp_replace(code, '^\\\\s+|\\\\s+$', '') LIKE 'E%' THEN 'External'
                  ELSE coalesce(icd_category_of_number(try_cast(substring_index(
                       regexp_replace(code, '^\\\\s+|\\\\s+$', ''), '.', 1) AS DOUBLE)), 'Other') END""")
    spark.sql("""
      CREATE OR REPLACE TEMPORARY FUNCTION risk_tier(s DOUBLE, p25 DOUBLE, p50 DOUBLE, p75 DOUBLE)
      RETURNS STRING
      RETURN CASE WHEN s < p25 THEN 'Low' WHEN s < p50 THEN 'Medium'
                  WHEN s < p75 THEN 'High' ELSE 'Critical' END""")
