"""riskloom — Spark-native event-risk analytics.

Data-quality audits, feature derivation, reproducible splits, train-fitted
encoders, feature ranking, MLlib model fitting with isotonic calibration,
scored-population metrics, risk tiers, subgroup fairness, attribution,
batch/stream scoring and monitoring — all as DataFrame / Spark SQL /
Spark ML / Structured Streaming jobs.
"""
