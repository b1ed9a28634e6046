"""References to rows that do not exist, or did not at the time."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import skew
from tidemark.session import cut


@dataclass(frozen=True)
class Reference:
    """A column that names rows of ``parent`` by ``key``; a parent is live from ``since`` on and before ``until``."""

    name: str
    column: str
    parent: DataFrame
    key: str
    since: str
    until: str


_KEY = ["ref_table", "__ref"]


def _stacked(child: DataFrame, row_id: str, at: str, references: list[Reference]) -> DataFrame:
    """One row a reference, all of them from a single pass over the child; null references and times are left out."""
    kinds = {child.schema[r.column].dataType for r in references}
    value = lambda r: F.col(r.column) if len(kinds) == 1 else F.col(r.column).cast("string")
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("ref_table"), value(r).alias("__ref")) for r in references]))
    rows = child.where(F.col(at).isNotNull()).select(F.col(row_id).alias("__id"), F.col(at).alias("__at"), each.alias("__each"))
    return rows.select("__each.*", "__id", "__at").where(F.col("__ref").isNotNull())


def _spans(child: DataFrame, references: list[Reference]) -> DataFrame:
    """The distinct lives of all parents."""
    kinds = {child.schema[r.column].dataType for r in references}
    kind = next(iter(kinds)).simpleString() if len(kinds) == 1 else "string"
    parts = [
        r.parent.where(F.col(r.key).isNotNull() & F.col(r.since).isNotNull()).select(
            F.lit(r.name).alias("__r_table"), F.col(r.key).cast(kind).alias("__r_ref"), F.col(r.since).alias("__since"), F.col(r.until).alias("__until")
        )
        for r in references
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def orphans(child: DataFrame, row_id: str, at: str, references: list[Reference]) -> DataFrame:
    """References of ``child`` that name no row live at ``at``: ref_table, ``row_id``, reference, ``at``; each once.

    A parent is live from ``since`` on (included) and before ``until`` (excluded; null means still live); one with a
    null ``since`` is never live. Null references are no cases, a null time cannot be judged and is none either. Columns
    of unlike types are compared as text.

    The distinct references with the span of their times are anti-joined with the parents' lives: those that one life
    covers whole are sound. Only the rows of the others are looked at, again by an anti-join, now by time. Both small
    sides are counted; beyond :data:`skew.BROADCAST_ROWS` the rows are shuffled once, hot references in pieces.
    """
    rows = _stacked(child, row_id, at, references)
    keys = cut(rows.groupBy(*_KEY).agg(F.min("__at").alias("__lo"), F.max("__at").alias("__hi"), F.count(F.lit(1)).alias("__n")))
    spans = _spans(child, references)
    same = (F.col("ref_table") == F.col("__r_table")) & (F.col("__ref") == F.col("__r_ref"))

    def live(first: Column, last: Column) -> Column:
        return same & (F.col("__since") <= first) & (F.col("__until").isNull() | (F.col("__until") > last))

    doubtful = cut(keys.join(spans, live(F.col("__lo"), F.col("__hi")), "left_anti").select(*_KEY))
    at_row = live(F.col("__at"), F.col("__at"))
    most = skew.BROADCAST_ROWS
    if doubtful.limit(most + 1).count() <= most and spans.limit(most + 1).count() <= most:
        found = rows.join(F.broadcast(doubtful), _KEY, "left_semi").join(F.broadcast(spans), at_row, "left_anti")
    else:
        hot = skew.hot_counted(keys, _KEY, "__n")
        lives = spans.withColumnsRenamed({"__r_table": "ref_table", "__r_ref": "__ref"})
        left, right = skew.salted(rows, doubtful, _KEY, F.col("__at"), hot)
        _, lives = skew.salted(rows, lives, _KEY, F.col("__at"), hot)
        lives = lives.withColumnsRenamed({"ref_table": "__r_table", "__ref": "__r_ref", skew.SALT: "__r_salt"})
        found = left.join(right.hint("merge"), [*_KEY, skew.SALT], "left_semi").join(lives.hint("merge"), at_row & (F.col(skew.SALT) == F.col("__r_salt")), "left_anti")
    return found.select("ref_table", F.col("__id").alias(row_id), F.col("__ref").alias("reference"), F.col("__at").alias(at)).distinct()


def orphan_report(found: DataFrame, all_rows: DataFrame) -> DataFrame:
    """Cases and their share per (ref_table, period); ``all_rows`` has the same columns for every checked reference."""
    cases = found.groupBy("ref_table", "period").agg(F.count(F.lit(1)).alias("orphans"))
    total = all_rows.groupBy("ref_table", "period").agg(F.count(F.lit(1)).alias("checked"))
    return total.join(cases, ["ref_table", "period"], "left").select(
        "ref_table",
        "period",
        "checked",
        F.coalesce("orphans", F.lit(0)).cast("long").alias("orphans"),
        F.round(F.coalesce("orphans", F.lit(0)) / F.col("checked"), 6).alias("share"),
    )
