"""Columns of any name come through every filtering and rewriting stage unchanged."""

from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF001
from tests.llm.helpers import LONG

NAMES = ["own", "_row", "_kept", "_k", "_cuts", "_left", "_text", "_base", "_spans", "_masked", "_rest", "_score", "score", "label", "row", "fp", "k"]


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    more = spark.createDataFrame([(10_001, LONG, "en", "s", len(LONG)), (10_002, "other " * 40 + LONG, "en", "s", 0),
                                  (10_003, "key token=abcdefghijkl end", None, None, None)], docs.schema)
    docs = docs.union(more).select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in NAMES])
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF001)
        assert out.columns == docs.columns, name
        assert dict(out.dtypes) == dict(docs.dtypes), name
        rows = out.select("doc_id", *NAMES).collect()
        assert rows and all(r[c] == f"{c}:{r['doc_id']}" for r in rows for c in NAMES), name
