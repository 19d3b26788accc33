"""Small documents tables for the edge cases every operator must handle."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


def table(spark, rows, folder, name="documents", schema=DOCS, extra=()):
    """Write ``rows`` of (doc_id, text) as ``folder/name.parquet``; ``extra`` adds constant columns."""
    from pyspark.sql import functions as F
    if schema is DOCS:
        rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
    df = spark.createDataFrame(rows, schema)
    for c in extra:
        df = df.withColumn(c, F.lit("x"))
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
EDGE = [(0, None), (1, ""), (2, "   "), (3, "a"), (4, "the cat of the house is in the garden"),
        (4, "the cat of the house is in the garden"), (5, "the cat of the house is in the garden"),
        (None, "no id here"), (6, LONG), (7, "héllo wörld 日本語 text 𝒳𝒴"), (8, LONG + " end")]
EXTRA = ("fp", "row", "label", "size", "slot", "shard", "vslot", "score", "m", "length", "start", "spans", "fingerprint")
