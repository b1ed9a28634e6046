"""Equi-joins whose key may be badly skewed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut

#: A key is hot if it holds more than one row in so many, hence fewer keys than this can be: a bound of their broadcast.
HOT_SHARE = 10_000
#: Keys with fewer rows than this are no burden for a task, whatever their share.
HOT_LEAST = 100_000
#: Pieces into which keys are spread that are not counted.
PIECES = 16
SALT = "__salt"
#: A side is broadcast up to so many rows, which are counted first.
BROADCAST_ROWS = 100_000


def hot_counted(counts: DataFrame, keys: list[str], n: str, share: int = HOT_SHARE, least: int = HOT_LEAST) -> DataFrame:
    """The keys that hold more than one row in ``share`` by the counts ``n``, and ``__pieces``: into how many a key is to be
    split so that no piece holds more than that. Null keys meet nothing and are left out."""
    total = counts.agg(F.sum(n)).scalar()
    known = counts
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    hot = known.where((F.col(n) >= least) & (F.col(n) * share > total))
    return hot.select(*keys, F.ceil(F.col(n) * share / total).cast("int").alias("__pieces"))


def hot_keys(df: DataFrame, keys: list[str], share: int = HOT_SHARE, least: int = HOT_LEAST) -> DataFrame:
    """:func:`hot_counted` of the rows of ``df``, which are counted map-side first."""
    return hot_counted(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), keys, "__n", share, least)


def salted(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, hot: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``__salt`` to join on besides ``keys``.

    Rows of ``big`` with a hot key get a salt from ``spread``; the rows of ``small`` with such a key are repeated
    once a salt. All other rows have salt 0, so the result of any join in which ``big`` is the kept side is unchanged.
    ``hot`` has fewer than :data:`HOT_SHARE` rows, which makes its broadcast safe.
    """
    hot = hot if hot is not None else hot_keys(big, keys)
    flags = F.broadcast(hot.select(*[F.col(k).alias(f"__h_{k}") for k in keys], "__pieces"))

    def marked(df: DataFrame) -> DataFrame:
        on = None
        for k in keys:
            c = F.col(k) == F.col(f"__h_{k}")
            on = c if on is None else on & c
        return df.join(flags, on, "left")

    drop = ["__pieces", *[f"__h_{k}" for k in keys]]
    pieces = F.coalesce("__pieces", F.lit(1))
    left = marked(big).withColumn(SALT, F.pmod(F.xxhash64(spread), pieces).cast("int"))
    right = marked(small).withColumn(SALT, F.explode(F.sequence(F.lit(0), pieces - 1)))
    return left.drop(*drop), right.drop(*drop)


def replicated(big: DataFrame, small: DataFrame, spread: Column, pieces: int = PIECES) -> tuple[DataFrame, DataFrame]:
    """As :func:`salted`, for a small side that is always far smaller: every key is spread, with no counting pass."""
    left = big.withColumn(SALT, F.pmod(F.xxhash64(spread), F.lit(pieces)).cast("int"))
    right = small.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))).hint("merge")  # never broadcast
    return left, right


def join_counted(
    big: DataFrame, small: DataFrame, keys: list[str], how: str, spread: Column, most: int = BROADCAST_ROWS, rows: int | None = None
) -> DataFrame:
    """``big`` joined with a side that is expected to be small but may not be (``how``: inner, left, left_anti ...).

    ``small`` is written once and its rows are counted, unless the caller knows their number: up to ``most`` it is
    broadcast, which spares a shuffle of ``big``; beyond that both sides are shuffled, with every key of ``small``
    repeated per salt.
    """
    if rows is None:
        small = cut(small)
        rows = small.limit(most + 1).count()
    if rows <= most:
        return big.join(F.broadcast(small), keys, how)
    left, right = replicated(big, small, spread)
    return left.join(right, [*keys, SALT], how).drop(SALT)
