"""Batches of a log with per-partition offsets, planned ahead and replayed after a failure.

A run plans its batch first: the end of each partition, written to the state folder before anything else happens. A run
that dies leaves its plan behind; the next run executes that very plan again, whatever has arrived since. What was taken
in is kept as steps, per partition an offset and a time up to which its records had arrived, so a record that arrives
late below a committed offset, or fills a gap, is still new. The sink drops rows whose (partition, offset) it holds.
Hence no record is skipped and none is kept twice.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.incremental import beyond, mark, offset_steps, whole_records
from tidemark.operators.skew import join_counted
from tidemark.sources.fs import Folder


class LogProcessor:
    """Incremental processing of an append-only log.

    ``partition``, ``offset`` and ``arrived`` name the log's columns. ``arrived`` is the number or time of a delivery:
    one that becomes visible later has a greater one than all that were visible before. Offsets are whole numbers that
    identify a record within its partition; they may arrive late, in any order and more than once. State and results
    live under ``folder``, on any file system that Spark reads; all of it but two numbers a batch is Parquet, and the
    driver holds no row a partition.
    """

    def __init__(self, spark: SparkSession, folder: str, partition: list[str], offset: str, arrived: str):
        self.spark, self.partition, self.offset, self.arrived = spark, partition, offset, arrived
        self.keys = [*partition, offset]
        self.files = Folder(spark, folder)

    def _batches(self, kind: str) -> list[int]:
        return sorted(int(n.split("-")[1].split(".")[0]) for n in self.files.list() if n.startswith(f"{kind}-") and n.endswith(".json"))

    def _create(self, name: str, value: dict) -> None:
        if not self.files.create(name, json.dumps(value).encode()):
            raise OSError(f"{name} exists already: another run is active")

    def _read(self, name: str) -> dict:
        return json.loads(self.files.read(name))

    def pending(self) -> int | None:
        """The batch that was planned but not committed."""
        open_ = set(self._batches("plan")) - set(self._batches("commit"))
        return min(open_) if open_ else None

    def results(self) -> DataFrame | None:
        """Everything committed so far, None before the first commit."""
        paths = [self.files.uri(f"batch={n}") for n in self._batches("commit")]
        return self.spark.read.parquet(*paths) if paths else None

    def adopt(self, runs: DataFrame, started: str, point: str) -> None:
        """Take over what earlier runs of another program took in: each all records of its partition that had arrived when
        it ``started``, with an offset up to its ``point``. Only before the first batch."""
        if self._batches("plan"):
            raise ValueError("runs can be adopted before the first batch only")
        steps = offset_steps(runs, self.partition, started, point).select(*self.partition, "__upto", "__point")
        steps.coalesce(1).write.mode("overwrite").parquet(self.files.uri("steps--1"))  # a few rows a partition
        self._create("adopted.json", {})

    def _steps(self, after: int) -> DataFrame | None:
        """What all batches up to ``after`` took in (-1: what was adopted): kept from the run that first asks for it."""
        if after < 0:
            return self.spark.read.parquet(self.files.uri("steps--1")) if self.files.exists("adopted.json") else None
        if not self.files.exists(f"steps-{after}/_SUCCESS"):
            before = self._steps(after - 1)
            taken = self.spark.read.parquet(self.files.uri(f"plan-{after}")).where(F.col("__upto").isNotNull()).select(*self.partition, "__upto", "__point")
            taken = taken if before is None else taken.unionByName(before)
            steps = offset_steps(taken, self.partition, "__upto", "__point").select(*self.partition, "__upto", "__point")
            steps.coalesce(1).write.mode("overwrite").parquet(self.files.uri(f"steps-{after}"))
        return self.spark.read.parquet(self.files.uri(f"steps-{after}"))

    def _plan(self, log: DataFrame, number: int) -> bool:
        """Write down the end of each partition; False if none has moved since the last batch."""
        at = mark(log, self.arrived)
        ends = whole_records(log, self.partition, self.offset).groupBy(*self.partition)
        ends = ends.agg(F.max(at).alias("__upto"), F.min(at).alias("__from"), F.max(self.offset).alias("__point"), F.count_if(at.isNull()).alias("__unknown"))
        ends.coalesce(1).write.mode("overwrite").parquet(self.files.uri(f"plan-{number}"))  # one row a partition
        now = self.spark.read.parquet(self.files.uri(f"plan-{number}"))
        low, upto, moved = now.agg(F.min("__from"), F.max("__upto"), F.count(F.lit(1))).first()
        last = None
        if number:
            before = self.spark.read.parquet(self.files.uri(f"plan-{number - 1}"))
            last = self._read(f"plan-{number - 1}.json")["upto"]
            moved = upto != last or now.join(before, [*self.partition, "__point", "__unknown"], "left_anti").limit(1).count()
        if not moved and upto == last:
            self.files.delete(f"plan-{number}")
            return False
        self._create(f"plan-{number}.json", {"batch": number, "from": low, "upto": upto})
        return True

    def run(self, log: DataFrame, process: Callable[[DataFrame], DataFrame], order: list[str] | None = None) -> int:
        """Process what is new and commit it; returns the batch number, or -1 if there was nothing to do.

        ``process`` gets each record once, its copy that is least by ``order`` (by arrival if not given), and may make any
        number of rows of it that keep the columns of the partition and the offset. A record without any time of arrival
        is new until the sink holds it.
        """
        number = self.pending()
        if number is None:
            number = max(self._batches("commit"), default=-1) + 1
            if not self._plan(log, number):
                return -1
        plan = self._read(f"plan-{number}.json")
        at = mark(log, self.arrived)
        rows = whole_records(log, self.partition, self.offset)
        rows = rows.where(at.isNull() | (at <= plan["upto"]) if plan["upto"] is not None else at.isNull())
        before = self._steps(number - 1)
        if number and not self.files.exists("adopted.json"):
            # all that arrived earlier is in the sink, so older parts of the log need not be read
            last = self._read(f"plan-{number - 1}.json")["upto"]
            known = F.col(self.arrived).isNull()
            rows = rows.where(known | (at > last) if last is not None else F.lit(True))
        first = self._first(rows, order)
        if before is not None:
            first = beyond(first, offset_steps(before, self.partition, "__upto", "__point"), self.partition, self.offset, (plan["from"], plan["upto"]))
            if number:
                first = self._unseen(first, before)
        out = process(first.select(*log.columns))
        if missing := [c for c in self.keys if c not in out.columns]:
            raise ValueError(f"the results lack {', '.join(missing)}, by which the sink knows them")
        out.write.mode("overwrite").parquet(self.files.uri(f"batch={number}"))
        self._create(f"commit-{number}.json", {"batch": number})
        return number

    def _first(self, rows: DataFrame, order: list[str] | None) -> DataFrame:
        """One copy of each record with ``__first``, the mark of its first arrival, by one aggregation."""
        carry = [c for c in rows.columns if c not in self.keys]
        least = F.min(mark(rows, self.arrived)).alias("__first")
        grouped = rows.groupBy(*self.keys)
        if carry == [self.arrived] and order in (None, [self.arrived]):
            return grouped.agg(least, F.min(self.arrived).alias(self.arrived))
        order = order or [self.arrived]
        kept = F.min_by(F.struct(*carry), F.struct(*order, *[c for c in carry if c not in order])).alias("__kept")
        return grouped.agg(least, kept).select(*self.keys, "__first", "__kept.*")

    def _unseen(self, first: DataFrame, before: DataFrame) -> DataFrame:
        """Without the records that the sink holds. Those above the committed offsets cannot be there."""
        ends = before.groupBy(*self.partition).agg(F.max("__point").alias("__end"))
        rows = join_counted(first, ends, self.partition, "left", F.col(self.offset))
        above = F.col("__first").isNotNull() & (F.col("__end").isNull() | (F.col(self.offset) > F.col("__end")))
        sink = self.results().select(*self.keys)
        return rows.where(above).unionByName(rows.where(~above).join(sink, self.keys, "left_anti")).drop("__end")
