"""What a write makes of a table, as DataFrames: the table after an UPDATE, a DELETE or an upsert."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tidemark.engine import ast as A
from tidemark.engine import types as K
from tidemark.engine.errors import AnalysisError, SqlError
from tidemark.engine.evaluate import evaluate
from tidemark.engine.parser import parse
from tidemark.engine.planner import Attr, Lowering, Planner, Source
from tidemark.engine.tables import folder_lookup


def met(planner: Planner, df: DataFrame, table: str, hidden: tuple[str, ...], where: A.Expr | None) -> Column:
    """The condition of a write over the columns of ``df``; UNKNOWN counts as not met."""
    if where is None:
        return F.lit(True)
    attrs = scope(df, table, hidden)
    return F.coalesce(planner.lowering(attrs, {}).condition(planner.resolved(where, attrs)), F.lit(False))


def scope(df: DataFrame, table: str, hidden: tuple[str, ...]) -> list[Attr]:
    return [Attr(table, f.name.lower(), f.name, K.of_field(f.dataType)) for f in df.schema if f.name not in hidden]


def assigned(low: Lowering, e: A.Expr, name: str, target: str, kind: DataType) -> Column:
    c, t = low.lower(e)
    if not K.coercible(t, target):
        raise AnalysisError(f"Type mismatch for column '{name}': {t} is no {target}")
    return c.cast(kind)


def updated(planner: Planner, df: DataFrame, statement: A.Update, hidden: tuple[str, ...] = ()) -> DataFrame:
    """``df`` after an UPDATE. Every right side sees the row as it was."""
    attrs = scope(df, statement.table, hidden)
    by_name = {a.name: a for a in attrs}
    low = planner.lowering(attrs, {})
    hit = met(planner, df, statement.table, hidden, statement.where)
    changes: dict[str, Column] = {}
    for name, e in statement.assignments:
        if name not in by_name:
            raise AnalysisError(f"Unknown column '{name}'")
        a = by_name[name]
        if a.column in changes:
            raise AnalysisError(f"Column '{name}' is set twice")
        new = assigned(low, planner.resolved(e, attrs), name, a.type, df.schema[a.column].dataType)
        changes[a.column] = F.when(F.col("__hit"), new).otherwise(F.col(a.column))
    marked = df.withColumn("__hit", hit)
    return marked.select(*[changes.get(c, F.col(c)).alias(c) for c in df.columns])


def deleted(planner: Planner, df: DataFrame, statement: A.Delete, hidden: tuple[str, ...] = ()) -> DataFrame:
    """``df`` after a DELETE."""
    return df.where(~met(planner, df, statement.table, hidden, statement.where))


def image(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """A Parquet table of ``folder`` as an UPDATE or DELETE would leave it; nothing is written."""
    statement, lookup = parse(sql), folder_lookup(spark, folder)
    found = lookup(statement.table)
    if found is None:
        raise AnalysisError(f"Table '{statement.table}' does not exist")
    planner = Planner(spark, lookup)
    return (updated if isinstance(statement, A.Update) else deleted)(planner, found.df, statement)


def upserted(
    planner: Planner, target: DataFrame, rows: DataFrame, key: list[str], assignments: list[tuple[str, A.Expr]], table: str, hidden: tuple[str, ...] = ()
) -> DataFrame:
    """``target`` after rows with distinct keys were inserted, those whose key is there changing the row instead.

    One full join on the key. Assignments run in order and see each other's results; they must not change the key.
    """
    columns = target.columns
    incoming = rows.select(*[F.col(c).alias(f"__new_{c}") for c in columns], F.lit(True).alias("__in"))
    on = None
    for k in key:
        c = F.col(k) == F.col(f"__new_{k}")
        on = c if on is None else on & c
    both = target.withColumn("__old", F.lit(True)).join(incoming, on, "full")
    attrs = scope(target, table, hidden)
    by_name = {a.name: a for a in attrs}
    values: dict[str, Column] = {}
    marks = {a.name: (F.col(f"__new_{a.column}"), a.type) for a in attrs}
    for name, e in assignments:
        if name not in by_name:
            raise AnalysisError(f"Unknown column '{name}'")
        a = by_name[name]
        low = _Threaded(planner, {x.column: x.type for x in attrs}, {}, marks, values)
        values[a.column] = assigned(low, planner.resolved(e, attrs), name, a.type, target.schema[a.column].dataType)
    out = []
    for c in columns:
        changed = values.get(c, F.col(c))
        out.append(F.when(F.col("__in").isNull(), F.col(c)).when(F.col("__old").isNull(), F.col(f"__new_{c}")).otherwise(changed).alias(c))
    return both.select(*out)


class _Threaded(Lowering):
    """Columns that were assigned already have their new values."""

    def __init__(self, planner, types, ctes, incoming, values: dict[str, Column]):
        super().__init__(planner, types, ctes, incoming)
        self.values = dict(values)

    def _column(self, e: A.Column) -> tuple[Column, str]:
        c, t = super()._column(e)
        return self.values.get(e.name, c), t


def upsert_image(spark: SparkSession, target: DataFrame, rows: DataFrame, key: list[str], sql: str) -> DataFrame:
    """``target`` after an upsert of ``rows``, with the assignments of an INSERT ... ON DUPLICATE KEY UPDATE."""
    statement = parse(sql)
    return upserted(Planner(spark, lambda _: Source(target)), target, rows, key, statement.on_duplicate, statement.table)


def fold_in_order(types: dict[str, str], key: list[str], assignments: list[tuple[str, A.Expr]], schema: pa.Schema):
    """A function for mapInArrow: rows sorted by key, the table's row (with its id) before incoming ones in their order, to
    the row that each key ends with, its id, and how many rows that counts for. An assignment that fails is told in
    ``__error``."""
    names = list(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        row: dict = {}
        rid, count, error = None, 0, None
        done: list[tuple] = []

        def emitted() -> pa.RecordBatch:
            columns = [pa.array([d[i] for d in done], f.type) for i, f in enumerate(schema)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            for *values, old in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                incoming = dict(zip(names, values, strict=True))
                at = tuple(incoming[k] for k in key)
                if at != now:
                    if now is not None:
                        done.append((*(row[n] for n in names), rid, count, error))
                    now, row, rid, error = at, incoming, old, None
                    count = 0 if old is not None else 1
                    continue
                new = dict(row)
                try:
                    for name, e in assignments:
                        v = evaluate(e, new, incoming)
                        if not K.coercible(K.value_type(v), types[name]):
                            raise AnalysisError(f"Type mismatch for column '{name}'")
                        new[name] = float(v) if types[name] == "float" and v is not None else v
                except SqlError as failed:
                    error = error or str(failed)
                    continue
                count += 2 * (new != row)
                row = new
            if len(done) >= 4096:
                yield emitted()
        if now is not None:
            done.append((*(row[n] for n in names), rid, count, error))
        yield emitted()

    return run
