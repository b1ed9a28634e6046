"""Running queries of the dialect over a folder of Parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from tidemark.engine import ast as A
from tidemark.engine.errors import ParseError
from tidemark.engine.parser import parse_counted
from tidemark.engine.planner import Planner, Source
from tidemark.engine.types import value_type
from tidemark.sources import table


def bind(node, values: list):
    """``node`` with its parameters replaced by literals of the values' types."""
    literals = [A.Literal(v, value_type(v)) for v in values]
    return A.rewrite(node, lambda e: literals[e.index] if isinstance(e, A.Param) else e)


def folder_lookup(spark: SparkSession, folder: str) -> Callable[[str], Source | None]:
    found: dict[str, Source | None] = {}

    def lookup(name: str) -> Source | None:
        if name not in found:
            try:
                found[name] = Source(table(spark, folder, name))
            except AnalysisException:
                found[name] = None
        return found[name]

    return lookup


def run_query(spark: SparkSession, sql: str, lookup: Callable[[str], Source | None], params: list | None = None) -> DataFrame:
    """The result of a SELECT of the dialect, lazily."""
    statement, n = parse_counted(sql)
    if not isinstance(statement, A.Select):
        raise ParseError("not a query")
    if n != len(params or []):
        raise ParseError(f"the statement takes {n} parameters, {len(params or [])} are given")
    return Planner(spark, lookup).query(bind(statement.query, params or [])).result()


def query_folder(spark: SparkSession, folder: str, sql: str, params: list | None = None) -> DataFrame:
    """A SELECT of the dialect over the Parquet tables of ``folder``."""
    return run_query(spark, sql, folder_lookup(spark, folder), params)
