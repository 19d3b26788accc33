"""Pipeline parameters.

Fixed values: these must equal the original pipeline's configuration for
results to line up (column lists, brackets, thresholds, gates).
"""

from __future__ import annotations

# ---- fixed values ---------------------------------------------------------
TARGET_COL = "readmitted"
LABEL_COL = "readmitted_30d"
POSITIVE_CLASS = "<30"
TARGET_VALUES = ("<30", ">30", "NO")
DROP_COLUMNS = ("encounter_id", "patient_nbr", "readmitted", "examide", "citoglipton")
HIGH_MISSING_PCT = 35.0
TEST_SIZE = 0.15
VAL_SIZE = 0.176
SEED = 42
AGE_BRACKETS = (
    "[0-10)", "[10-20)", "[20-30)", "[30-40)", "[40-50)",
    "[50-60)", "[60-70)", "[70-80)", "[80-90)", "[90-100)",
)
MEDICATION_COLUMNS = (
    "metformin", "repaglinide", "nateglinide", "chlorpropamide", "glimepiride",
    "acetohexamide", "glipizide", "glyburide", "tolbutamide", "pioglitazone",
    "rosiglitazone", "acarbose", "miglitol", "troglitazone", "tolazamide",
    "insulin", "glyburide-metformin", "glipizide-metformin",
    "glimepiride-pioglitazone", "metformin-rosiglitazone", "metformin-pioglitazone",
)
VISIT_COLUMNS = ("number_outpatient", "number_emergency", "number_inpatient")
HIGH_UTILIZER_Q = 0.75
TOP_K = 30
LASSO_C = 0.1
RF_TREES = 100
GBT_DEFAULTS = dict(n_estimators=300, learning_rate=0.05, max_depth=6,
                    subsample=0.8, colsample_bytree=0.8)
SEARCH_SPACE = dict(
    n_estimators=(200, 800), learning_rate=(0.01, 0.2), max_depth=(3, 9),
    subsample=(0.6, 1.0), colsample_bytree=(0.5, 1.0), min_child_weight=(1, 10),
    gamma=(0.0, 5.0),
)
N_TRIALS = 50
CALIBRATION_BINS = 10
FIXED_TIERS = (0.25, 0.50, 0.75)
TIER_NAMES = ("Low", "Medium", "High", "Critical")
FLAG_PERCENTILE = 80
SHAP_TOP_K = 5
SHAP_SAMPLE = 500
PSI_WARNING = 0.10
PSI_CRITICAL = 0.25
GATE_MIN_AUC = 0.70
GATE_MIN_AP = 0.30
GATE_MAX_ECE = 0.05
MIN_ROWS = 50_000
POS_RATE_LOW = 0.05
POS_RATE_HIGH = 0.50
RANGE_CHECKS = (
    ("time_in_hospital", 1, 30),
    ("num_lab_procedures", 0, 200),
    ("num_procedures", 0, 10),
    ("num_medications", 0, 100),
    ("number_diagnoses", 0, 20),
)
HIGH_RISK_DIAG = ("Circulatory", "Respiratory", "Endocrine")
SUBGROUP_COLS = ("age_risk_bucket", "gender", "diag_1_category")
SUBGROUP_MIN_N = 30
SUBGROUP_MIN_POS = 5
KS_THRESHOLDS = 200
SWEEP_POINTS = 100
INTERVENTION_EFFICACY = 0.30
READMISSION_COST = 15_000
# ICD-9 style category ranges (inclusive), then the catch-all.
ICD_RANGES = (
    (1, 139, "Infectious"), (140, 239, "Neoplasms"), (240, 279, "Endocrine"),
    (280, 289, "Blood"), (290, 319, "Mental"), (320, 389, "Nervous"),
    (390, 459, "Circulatory"), (460, 519, "Respiratory"), (520, 579, "Digestive"),
    (580, 629, "Genitourinary"), (630, 679, "Pregnancy"), (680, 709, "Skin"),
    (710, 739, "Musculoskeletal"), (740, 759, "Congenital"), (780, 799, "Symptoms"),
    (800, 999, "Injury"),
)
ICD_OTHER_TOKENS = ("?", "E", "V", "nan")
# Serving-side latency histogram buckets (seconds) and score buckets.
LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5)
SCORE_BUCKETS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
BATCH_SIZE_BUCKETS = (1, 5, 10, 25, 50, 100, 250, 500)
# ---------------------------------------------------------------------------
