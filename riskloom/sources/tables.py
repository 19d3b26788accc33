"""Parquet/CSV scans of the input tables (column-pruned at the scan)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import written

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | tuple | None = None) -> DataFrame:
    """Parquet scan; selecting ``columns`` here lets the scan read only them."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def scan_parquet(spark: SparkSession, path: str, schema=None) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)


def scan_csv(spark: SparkSession, path: str, schema=None, null_value: str | None = None,
             header: bool = True) -> DataFrame:
    """Header CSV scan.  Pass an explicit schema, or use ``infer_csv`` (inference here reads the data twice).

    ``null_value`` turns a sentinel token (e.g. ``?``) into SQL NULL at the reader.
    """
    r = spark.read.option("header", header)
    if null_value is not None:
        r = r.option("nullValue", null_value)
    if schema is not None:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", True)
    return r.csv(path)


#: Types that a text column can turn out to be, in the order in which they are tried, with
#: the form that a value must have.
CSV_TYPES = (("boolean", r"(?i)true|false"), ("bigint", r"[+-]?\d{1,19}"), ("double", r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"),
             ("date", r"\d{4}-\d{1,2}-\d{1,2}"), ("timestamp", r"\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?"))
MALFORMED = "_malformed"


def parsed_csv(spark: SparkSession, path: str, null_value: str | None = None, sep: str = ",") -> DataFrame:
    """A header CSV parsed once, into a table of text columns; a row of too few or too many
    fields has its whole line in ``_malformed`` (``_malformed_`` … if that name is taken)."""
    r = spark.read.option("header", True).option("sep", sep)
    names = r.csv(path).columns         # reads the first line only
    bad = MALFORMED
    while bad in names:
        bad += "_"
    schema = ", ".join(f"`{n}` string" for n in [*names, bad])
    r = r.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad)
    return written((r.option("nullValue", null_value) if null_value is not None else r).csv(path), "csv")


def inferred_types(rows: DataFrame, bad: str = MALFORMED) -> dict[str, str]:
    """The narrowest type that every value of a column has, from one aggregation over all
    well-formed rows; a column without values is text."""
    cols = [c for c in rows.columns if c != bad]
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(f"`{c}`")
        fits = [F.count_if(v.rlike(f"^(?:{form})$") & v.try_cast(t).isNotNull()).alias(f"t_{i}_{t}") for t, form in CSV_TYPES]
        aggs += [F.count(v).alias(f"n_{i}"), *fits]
    r = rows.where(F.col(f"`{bad}`").isNull()).agg(*aggs).first()

    def kind(i):
        n = r[f"n_{i}"]
        dated = n and r[f"t_{i}_date"] + r[f"t_{i}_timestamp"] == n
        return next((t for t, _ in CSV_TYPES if n and (r[f"t_{i}_{t}"] == n or (t == "timestamp" and dated))), "string")
    return {c: kind(i) for i, c in enumerate(cols)}


def infer_csv(spark: SparkSession, path: str, null_value: str | None = None, sep: str = ",") -> DataFrame:
    """A header CSV with types inferred from the whole file, which is parsed once: types are
    found, and values cast, in the parsed table.  Malformed rows stay, with NULL fields and
    their line in the last column."""
    rows = parsed_csv(spark, path, null_value, sep)
    bad = rows.columns[-1]
    types = inferred_types(rows, bad)
    ok = F.col(f"`{bad}`").isNull()
    return rows.select(*[F.when(ok, F.col(f"`{c}`").try_cast(t)).alias(c) for c, t in types.items()], F.col(f"`{bad}`"))
