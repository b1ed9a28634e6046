"""Messages delivered at least once: one copy of each stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keepers(df: DataFrame, identifier: list[str], order: list[str], carry: list[str] | None = None) -> DataFrame:
    """One row per identifier: the columns of ``carry`` (all others by default) from the copy that is least by ``order``.

    An aggregation by identifier with ``min_by`` over a struct of the delivery's order and a tie-break, so copies meet
    map-side first and a message repeated for a third of all rows is no hot task. ``order`` should end in a unique column; ties are broken by the carried values. Nulls in
    an identifier are a value like any other; nulls in ``order`` come first.
    """
    carry = [c for c in df.columns if c not in identifier] if carry is None else carry
    chosen = F.min_by(F.struct(*carry), F.struct(*order, *[c for c in carry if c not in order]))
    return df.groupBy(*identifier).agg(chosen.alias("__kept")).select(*identifier, "__kept.*")


def surplus(df: DataFrame, identifier: list[str], delivery: str, order: list[str]) -> DataFrame:
    """The deliveries to drop, one row each, where ``delivery`` is unique.

    The copy that stays is the least by ``order``, then by ``delivery``. The kept ids are taken away by
    an anti-join on the unique delivery, whose keys cannot be skewed. Rows whose identifier holds a null are no
    messages and are left alone.
    """
    rows = df
    for c in identifier:
        rows = rows.where(F.col(c).isNotNull())
    kept = keepers(rows, identifier, order, [delivery]).select(delivery)
    return rows.select(delivery).join(kept, delivery, "left_anti")
