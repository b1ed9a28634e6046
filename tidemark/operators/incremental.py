"""Processing only what no successful run has taken in yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.skew import BROADCAST_ROWS, SALT, replicated
from tidemark.session import cut


def mark(df: DataFrame, name: str) -> Column:
    """A time of arrival, or a delivery number, as a whole number that orders arrivals."""
    if isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(F.col(name).cast("timestamp"))
    return F.col(name).cast("long")


def offset_steps(runs: DataFrame, partition: list[str], started: str, point: str) -> DataFrame:
    """Per partition the greatest point any run took in, as a step function of the time a record first arrived.

    Rows ``partition, __after, __upto, __point``: a record that first arrived after ``__after`` and not later than
    ``__upto`` was taken in if its offset is at most ``__point``. Runs repeat, fail and move their points back, so the
    value is the maximum over all runs that started at ``__upto`` or later; runs that a later one with no lower point
    makes needless are left out, so a partition whose points only rise has one step. Runs with a null start or point
    took in nothing. The windows run over the runs of a partition, never over records.
    """
    known = runs.where(F.col(started).isNotNull() & F.col(point).isNotNull())
    per_start = known.groupBy(*partition, mark(runs, started).alias("__upto")).agg(F.max(point).alias("__p"))
    by = Window.partitionBy(*partition).orderBy(F.desc("__upto"))
    later = F.max("__p").over(by.rowsBetween(Window.unboundedPreceding, -1))
    needed = per_start.withColumn("__later", later).where(F.col("__later").isNull() | (F.col("__p") > F.col("__later")))
    return needed.select(*partition, F.lead("__upto").over(by).alias("__after"), "__upto", F.col("__p").alias("__point"))


def beyond(first: DataFrame, steps: DataFrame, partition: list[str], offset: str, span: tuple[int | None, int | None]) -> DataFrame:
    """The rows of ``first`` that no step took in. ``first`` has ``partition``, ``offset`` and ``__first``, the mark of the
    first arrival (null: never known to have arrived, so not taken in); ``span`` is the least and the greatest of them.

    Steps are cut into buckets of arrival, about as many as a partition has steps and never beyond the records' own span,
    however far a clock is off, which makes at most three pieces a step. The steps are written and counted: up to
    :data:`BROADCAST_ROWS` pieces are broadcast; more are met in a shuffle by partition, bucket and salt.
    """
    low, high = span
    steps = cut(steps)
    n, parts = steps.agg(F.count(F.lit(1)), F.count_distinct(F.struct(*partition))).first()
    if not n or low is None:
        return first
    width = (high - low) // max(1, -(-n // parts)) + 1

    def bucket(c: Column) -> Column:
        return F.floor((c - F.lit(low)) / F.lit(width)).cast("long")

    after, upto = F.greatest(F.col("__after") + 1, F.lit(low)), F.least("__upto", F.lit(high))
    names = {c: f"__r_{c}" for c in partition}
    pieces = (
        steps.where(after <= upto)
        .withColumn("__bucket", F.explode(F.sequence(bucket(after), bucket(upto))))
        .select(*[F.col(c).alias(names[c]) for c in partition], "__after", "__upto", "__point", "__bucket")
    )
    met = (F.col("__first") <= F.col("__upto")) & (F.col("__after").isNull() | (F.col("__first") > F.col("__after")))
    met = met & (bucket(F.col("__first")) == F.col("__bucket")) & (F.col(offset) <= F.col("__point"))
    for c in partition:
        met = met & (F.col(c) == F.col(names[c]))
    if 3 * n <= BROADCAST_ROWS:
        return first.join(F.broadcast(pieces), met, "left_anti")
    left, right = replicated(first, pieces, F.col(offset), 8)
    right = right.withColumnRenamed(SALT, f"__r_{SALT}")
    return left.join(right, met & (F.col(SALT) == F.col(f"__r_{SALT}")), "left_anti").drop(SALT)


def whole_records(records: DataFrame, partition: list[str], offset: str) -> DataFrame:
    """Rows with a null partition or offset are no records."""
    for c in [*partition, offset]:
        records = records.where(F.col(c).isNotNull())
    return records


def not_taken(records: DataFrame, runs: DataFrame, partition: list[str], offset: str, arrived: str, started: str, point: str) -> DataFrame:
    """Records that no run took in, each once: ``partition`` and ``offset``.

    A run took in every record of its partition with an arrival no later than its start and an offset up to its point.
    ``records`` may hold several deliveries of an offset: the first arrival counts, found by a map-side aggregation. A
    record without any arrival time was taken in by no run; rows with a null partition or offset are no records. Empty
    runs leave every record.
    """
    whole = whole_records(records, partition, offset)
    first = whole.groupBy(*partition, offset).agg(F.min(mark(records, arrived)).alias("__first"))
    at = mark(records, arrived)
    span = whole.agg(F.min(at), F.max(at)).first()
    return beyond(first, offset_steps(runs, partition, started, point), partition, offset, tuple(span)).select(*partition, offset)
