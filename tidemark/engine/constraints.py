"""Constraints as queries for the rows that break them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.engine import ast as A
from tidemark.engine.errors import ConstraintError
from tidemark.engine.parser import Parser
from tidemark.engine.planner import Planner, Source


def nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a null where none may be."""
    return df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))


def _whole_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose key holds no null; keys with a null break neither uniqueness nor references."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))


def repeated_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keys without nulls that occur more than once, with their number ``n``."""
    return _whole_keys(df, columns).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing_parents(child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str]) -> DataFrame:
    """Rows of ``child`` whose key, if it holds no null, is not among the parent's keys. Numbers compare by value."""
    keys = parent.select(*[F.col(c).alias(f"__p{i}") for i, c in enumerate(parent_columns)])
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__p{i}") for i, c in enumerate(columns)])
    return _whole_keys(child, columns).join(keys, on, "left_anti")


def failed_check(spark: SparkSession, df: DataFrame, check: str | A.Expr) -> DataFrame:
    """Rows for which a check is FALSE; UNKNOWN passes."""
    e = Parser(check).expr() if isinstance(check, str) else check
    planner = Planner(spark, lambda _: Source(df))
    names = df.columns
    rel = planner.source(A.TableRef("t", None), {}, False)
    ok = planner.lowering(rel.attrs, {}).condition(planner.resolved(e, rel.attrs))
    return rel.df.where(~F.coalesce(ok, F.lit(True))).select(*[F.col(a.column).alias(n) for a, n in zip(rel.attrs, names, strict=True)])


def require_none(violations: DataFrame, message: str) -> None:
    """Raise unless ``violations`` is empty; stops at the first row."""
    if violations.limit(1).count():
        raise ConstraintError(message)


class Checks:
    """Violation queries that are run together as one job."""

    def __init__(self):
        self.parts: list[tuple[DataFrame, str]] = []

    def none(self, violations: DataFrame, message: str) -> None:
        self.parts.append((violations, message))

    def run(self) -> None:
        """Raise the message of the first query, in order of addition, that has a row."""
        if not self.parts:
            return
        marks = [d.limit(1).select(F.lit(i).alias("n")) for i, (d, _) in enumerate(self.parts)]
        found = sorted(r[0] for r in reduce(lambda a, b: a.unionByName(b), marks).collect())
        if found:
            raise ConstraintError(self.parts[found[0]][1])
