"""Corpus pipeline: documents to packed training sequences in five stages.

Each stage calls one training-data operator on all that the stage before kept and
is written as a table before the next one reads it.  All but the last return the
columns of ``documents``; ``n_chars`` follows a changed text.

1. ``quality`` drops the documents that the classifier rejects (score under 0.3).
2. ``near_duplicates`` keeps one document of each SimHash component.
3. ``repeats`` cuts later copies of 200-byte passages, the first copy stays; a
   document that is nothing but such copies goes.
4. ``secrets`` masks every secret found.
5. ``packing`` returns the pieces of the packed sequences.

Null texts count as empty texts, empty tables pass through all stages, further columns
of any names keep their values up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import nbsvm, packing, secrets, simhash, suffix
from riskloom.llm.common import texts, written
from riskloom.sources.tables import read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = nbsvm.fit(docs, read_table(spark, sf_dir, "labels"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), "text")
    return nbsvm.scored(own, model).filter(F.col("score") >= nbsvm.KEEP_AT).select("own.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.cut_texts(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.masked_texts(docs, secrets.fit(secrets.document_samples(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.cut_documents(texts(docs)))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("secrets", mask_secrets), ("packing", pack)]

#: Trained models, bit sampling and tokenizers are not SQL: tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
