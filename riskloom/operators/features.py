"""Feature derivation (groups D, A, B, C, E, G, F) as one projection.

``FeatureEngineer.fit`` computes the two data-dependent parameters (q75 of
total prior visits, median clinical complexity) in one aggregation and
returns a ``FeatureModel``; ``transform`` is a single ``select`` (one fused
Project in the plan).  ``per_split=True`` refits per split, the original
pipeline's behaviour.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import config as C
from riskloom.functions import exprs as X


def _has(df, *cols):
    return all(c in df.columns for c in cols)


def total_prior_visits(df: DataFrame, visit_cols=C.VISIT_COLUMNS) -> Column:
    cols = [c for c in visit_cols if c in df.columns]
    if not cols:
        return F.lit(0).cast("long")
    return sum((F.coalesce(F.col(c), F.lit(0)) for c in cols[1:]),
               F.coalesce(F.col(cols[0]), F.lit(0)))


def clinical_complexity(df: DataFrame) -> Column | None:
    parts = [F.coalesce(F.col(c), F.lit(0)) for c in
             ("num_procedures", "number_diagnoses", "num_medications") if c in df.columns]
    if not parts:
        return None
    return sum(parts[1:], parts[0])


def n_active_medications(df: DataFrame, meds=C.MEDICATION_COLUMNS) -> Column:
    used = [c for c in meds if c in df.columns]
    if not used:
        return F.lit(0)
    terms = [X.flag(F.col(c).isNotNull() & (F.col(c) != "No")) for c in used]
    return sum(terms[1:], terms[0])


@dataclass
class FeatureModel:
    q75_visits: float | None
    median_complexity: float | None
    medication_columns: tuple = C.MEDICATION_COLUMNS
    visit_columns: tuple = C.VISIT_COLUMNS

    def columns(self, df: DataFrame, numbers: dict | None = None) -> list[Column]:
        """The derived columns; ``numbers`` has the parsed number of a diagnosis column."""
        numbers = numbers or {}
        out: list[tuple[str, Column]] = [(c, F.col(c)) for c in df.columns]
        names = [n for n, _ in out]

        def put(name, expr):
            if name in names:
                out[names.index(name)] = (name, expr)
            else:
                out.append((name, expr))
                names.append(name)

        def drop(name):
            if name in names:
                i = names.index(name)
                del out[i]
                del names[i]

        # D demographic
        age_num = None
        if "age" in df.columns:
            age_num = X.age_numeric("age")
            put("age_numeric", age_num)
            put("age_risk_bucket", X.age_risk_bucket("age"))
            drop("age")
        if "gender" in df.columns:
            put("gender", X.gender_code("gender"))
        # A admission
        visits = [c for c in self.visit_columns if c in df.columns]
        tpv = total_prior_visits(df, self.visit_columns)
        put("total_prior_visits", tpv)
        q75 = self.q75_visits
        put("high_utilizer", X.flag(tpv > F.lit(q75)) if q75 is not None else F.lit(0))
        for c in visits:
            put(f"has_{c}", X.flag(F.col(c) > 0))
        # B clinical
        cx = clinical_complexity(df)
        if cx is not None:
            put("clinical_complexity", cx)
        if _has(df, "time_in_hospital", "number_diagnoses"):
            put("days_per_diagnosis", F.col("time_in_hospital") / (F.col("number_diagnoses") + 1))
        if _has(df, "time_in_hospital", "num_procedures"):
            put("procedure_intensity", F.col("num_procedures") / (F.col("time_in_hospital") + 1))
        if _has(df, "time_in_hospital", "num_lab_procedures"):
            put("lab_intensity", F.col("num_lab_procedures") / (F.col("time_in_hospital") + 1))
        # C lab
        a1c_t = glu_t = None
        if "A1Cresult" in df.columns:
            a1c_t = X.ne_null_true("A1Cresult", "None").cast("int")
            put("a1c_tested", a1c_t)
            put("a1c_high", X.flag(F.col("A1Cresult").isin(">7", ">8")))
            put("a1c_very_high", X.flag(F.col("A1Cresult") == ">8"))
        if "max_glu_serum" in df.columns:
            glu_t = X.ne_null_true("max_glu_serum", "None").cast("int")
            put("glucose_tested", glu_t)
            put("glucose_high", X.flag(F.col("max_glu_serum").isin(">200", ">300")))
        if a1c_t is not None and glu_t is not None:
            put("both_labs_done", (a1c_t.bitwiseAND(glu_t)).cast("int"))
        # E medication
        n_meds = n_active_medications(df, self.medication_columns)
        put("n_active_medications", n_meds)
        if "insulin" in df.columns:
            put("any_insulin", X.flag(F.col("insulin").isin("Up", "Down", "Steady")))
            put("insulin_increased", X.flag(F.col("insulin") == "Up"))
            put("insulin_decreased", X.flag(F.col("insulin") == "Down"))
        if "change" in df.columns:
            put("any_med_change", X.flag(F.col("change") == "Ch"))
        if "diabetesMed" in df.columns:
            put("on_diabetes_med", X.flag(F.col("diabetesMed") == "Yes"))
        # G diagnosis
        for d in ("diag_1", "diag_2", "diag_3"):
            if d in df.columns:
                put(f"{d}_category", X.icd_category(d, numbers.get(d)))
        if "diag_1" in df.columns:
            put("primary_diag_high_risk",
                X.flag(X.icd_category("diag_1", numbers.get("diag_1")).isin(*C.HIGH_RISK_DIAG)))
        for d in ("diag_1", "diag_2", "diag_3"):
            drop(d)
        # F interaction
        if age_num is not None and "number_diagnoses" in df.columns:
            put("age_x_ndiagnoses", age_num * F.col("number_diagnoses"))
        if "number_diagnoses" in df.columns:
            put("n_meds_x_ndiagnoses", n_meds * F.col("number_diagnoses"))
        if _has(df, "number_inpatient", "number_emergency"):
            put("inpatient_x_emergency", F.col("number_inpatient") * F.col("number_emergency"))
        if age_num is not None and cx is not None:
            med = self.median_complexity
            hi = X.flag(cx > F.lit(med)) if med is not None else F.lit(0)
            put("elderly_high_complexity", X.flag(age_num >= 6) * hi)
        return [e.alias(n) for n, e in out]

    def transform(self, df: DataFrame) -> DataFrame:
        # codes are parsed in a projection of their own, once a row and not once a range
        parsed = {d: f"_{d}_number" for d in ("diag_1", "diag_2", "diag_3") if d in df.columns}
        columns = self.columns(df, {d: F.col(n) for d, n in parsed.items()})
        return df.withColumns({n: X.icd_number(d) for d, n in parsed.items()}).select(*columns)


class FeatureEngineer:
    def __init__(self, q=C.HIGH_UTILIZER_Q, medication_columns=C.MEDICATION_COLUMNS,
                 visit_columns=C.VISIT_COLUMNS):
        self.q = q
        self.medication_columns = medication_columns
        self.visit_columns = visit_columns

    def fit(self, df: DataFrame) -> FeatureModel:
        """One aggregation: exact linear-interpolated q75 and median.

        ``percentile``'s buffer holds one count per distinct value; both inputs
        are small-integer sums, so that is bounded by their value range.
        """
        tpv = total_prior_visits(df, self.visit_columns)
        cx = clinical_complexity(df)
        aggs = [F.percentile(tpv, self.q).alias("q")]
        aggs.append(F.percentile(cx, 0.5).alias("m") if cx is not None
                    else F.lit(None).alias("m"))
        r = df.agg(*aggs).first()
        return FeatureModel(r["q"], r["m"], self.medication_columns, self.visit_columns)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def fit_transform_per_split(self, df: DataFrame, split_col: str = "split") -> DataFrame:
        """Per-split refit (parity with the original): params fitted per split value."""
        r = (df.groupBy(split_col)
             .agg(F.percentile(total_prior_visits(df, self.visit_columns), self.q).alias("q"),
                  F.percentile(clinical_complexity(df), 0.5).alias("m"))
             .collect())
        parts = None
        for row in r:
            m = FeatureModel(row["q"], row["m"], self.medication_columns, self.visit_columns)
            part = m.transform(df.where(F.col(split_col) == row[split_col]))
            parts = part if parts is None else parts.unionByName(part)
        return parts
