"""Readers for tables kept as Parquet."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Schemas that Spark found, by the state of the files: reading a table again costs no job for its footers.
_SCHEMAS: dict[tuple, StructType] = {}


def _state(path: str) -> tuple | None:
    """What tells a local table's files from any others; None for other file systems, where nothing is remembered."""
    try:
        names = sorted(os.path.join(path, n) for n in os.listdir(path)) if os.path.isdir(path) else [path]
        return (path, *((n, s.st_mtime_ns, s.st_size, s.st_ino) for n in names for s in [os.stat(n)]))
    except OSError:
        return None


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder, lazily."""
    path = f"{folder}/{name}.parquet"
    state = _state(path)
    if state is None:
        return spark.read.parquet(path)
    if state not in _SCHEMAS:
        df = spark.read.parquet(path)
        _SCHEMAS[state] = df.schema
        return df
    return spark.read.schema(_SCHEMAS[state]).parquet(path)
