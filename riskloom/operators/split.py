"""Deterministic stratified train/val/test split.

Rows are ordered per class by a keyed hash ``md5(key || '|' || seed)`` (then
by key); each class contributes its proportional share to test, then to val
(floor plus largest remainders, as the stratified shuffle split allocates).
The cut positions are found without a per-class window (which would run each
class in one task): distinct hash values with counts → distributed prefix
counts → the hash (and, only on a hash tie, the key) at each cut position.
Rows are then labelled by comparing with those literals — no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import config as C
from riskloom.functions.cumulative import prefix_sums


def hash_order(key: str, seed: int) -> Column:
    """60-bit integer from md5 of the key text and seed (order = hex order)."""
    hx = F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}"))), 1, 15)
    return F.conv(hx, 16, 10).cast("long")


def allocate(counts: dict, n_take: int) -> dict:
    """Split ``n_take`` across classes proportionally: floor, then largest remainder
    (ties by class value)."""
    n = sum(counts.values())
    if n == 0:
        return {k: 0 for k in counts}
    exact = {k: n_take * v / n for k, v in counts.items()}
    out = {k: min(counts[k], math.floor(x)) for k, x in exact.items()}
    left = n_take - sum(out.values())
    for k in sorted(counts, key=lambda k: (-(exact[k] - math.floor(exact[k])), k is None, 0 if k is None else k)):
        if left <= 0:
            break
        if out[k] < counts[k]:
            out[k] += 1
            left -= 1
    return out


def _cuts(hk: DataFrame, key: str, label: str, wanted: dict) -> dict:
    """(hash, key) at each wanted 0-based position per class, all classes in one pass.

    ``wanted``: {class: [positions]}.  Distinct (class, hash) counts → prefix counts
    per class (one distributed pass) → the rows covering the positions.  Each row
    carries its smallest and largest key, so only different keys of one hash need
    another look, as (key, count) rows: a repeated key stays one row.
    """
    cnt = hk.groupBy(label, "_h").agg(F.count(F.lit(1)).alias("_cnt"), F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    ps = prefix_sums(cnt, "_h", {"_cum": F.col("_cnt")}, group_cols=[label])
    cond = None
    for cls, positions in wanted.items():
        for pos in positions:
            c = F.col(label).eqNullSafe(F.lit(cls)) & (F.col("_cum") - F.col("_cnt") <= pos) \
                & (F.col("_cum") > pos)
            cond = c if cond is None else (cond | c)
    rows = ps.where(cond).select(label, "_h", "_cnt", "_lo", "_hi", "_cum").collect() if cond is not None else []
    out = {}
    for cls, positions in wanted.items():
        for pos in positions:
            r = next(r for r in rows if r[label] == cls and r["_cum"] - r["_cnt"] <= pos < r["_cum"])
            if r["_lo"] == r["_hi"]:
                out[(cls, pos)] = (r["_h"], r["_lo"])
                continue
            tied = hk.where(F.col(label).eqNullSafe(F.lit(cls)) & (F.col("_h") == r["_h"])) \
                .groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(key).collect()
            left = pos - (r["_cum"] - r["_cnt"])
            for t in tied:
                if left < t["n"]:
                    out[(cls, pos)] = (r["_h"], t[key])
                    break
                left -= t["n"]
    return out


def _le(h, k, key) -> Column:
    return (F.col("_h") < F.lit(h)) | ((F.col("_h") == F.lit(h)) & (F.col(key) <= F.lit(k)))


def stratified_split(df: DataFrame, key: str = "encounter_id", label: str = "label",
                     test_size: float = C.TEST_SIZE, val_size: float = C.VAL_SIZE,
                     seed: int = C.SEED, out: str = "split") -> DataFrame:
    """Add ``split`` ∈ {train, val, test}; sizes test = ceil(test_size·n),
    val = ceil(val_size·(n − test)), each stratified by ``label``."""
    d = df.withColumn("_h", hash_order(key, seed))
    hk = d.select("_h", key, label).cache()
    counts = {r[label]: r["n"] for r in hk.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    n_test = math.ceil(test_size * n)
    test_c = allocate(counts, n_test)
    rest = {c: counts[c] - test_c[c] for c in counts}
    n_val = math.ceil(val_size * sum(rest.values()))
    val_c = allocate(rest, n_val)
    wanted = {c: ([test_c[c] - 1] if test_c[c] > 0 else [])
              + ([test_c[c] + val_c[c] - 1] if val_c[c] > 0 else []) for c in counts}
    cuts = _cuts(hk, key, label, wanted)
    expr = None
    for c in sorted(counts, key=lambda x: (x is None, x)):
        is_c = F.col(label).eqNullSafe(F.lit(c))
        conds = []
        if test_c[c] > 0:
            h, k = cuts[(c, test_c[c] - 1)]
            conds.append((is_c & _le(h, k, key), "test"))
        if val_c[c] > 0:
            h, k = cuts[(c, test_c[c] + val_c[c] - 1)]
            conds.append((is_c & _le(h, k, key), "val"))
        for cond, name in conds:
            expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    hk.unpersist()
    label_expr = expr.otherwise("train") if expr is not None else F.lit("train")
    return d.withColumn(out, label_expr).drop("_h")
