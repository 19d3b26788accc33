"""Versioned folders: a version becomes visible by one row of a manifest, written last.

A writer fills a folder of its own and then appends its manifest row, which Spark commits
as a whole; readers take the newest row's folder.  A version whose writer died has no
row and is ignored.  One writer at a time; any number of readers, who keep their
version while a newer one appears.  All paths go through Spark's readers and writers.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

_SCHEMA = "version long, folder string, meta string"


@dataclass(frozen=True)
class Version:
    number: int
    folder: str
    meta: dict


def versions(spark: SparkSession, path: str) -> list[Version]:
    """All complete versions, oldest first (a row each)."""
    try:
        rows = spark.read.schema(_SCHEMA).parquet(os.path.join(path, "manifest")).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return [Version(r["version"], r["folder"], json.loads(r["meta"])) for r in sorted(rows, key=lambda r: r["version"])]


def latest(spark: SparkSession, path: str) -> Version | None:
    found = versions(spark, path)
    return found[-1] if found else None


def publish(spark: SparkSession, path: str, write: Callable[[str], dict | None]) -> Version:
    """Run ``write(folder)`` on a new folder and make it the newest version; what it returns
    is kept with the version.  If it fails, no version appears."""
    last = latest(spark, path)
    number = last.number + 1 if last else 1
    folder = os.path.join(path, f"v{number}-{uuid.uuid4().hex}")
    meta = write(folder) or {}
    spark.createDataFrame([(number, folder, json.dumps(meta))], _SCHEMA).coalesce(1).write.mode("append").parquet(os.path.join(path, "manifest"))
    return Version(number, folder, meta)
