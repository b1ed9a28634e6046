"""A change feed applied as it streams: the present state of a table, kept by key and bucket.

Each micro-batch is folded with the state of the buckets it touches; those buckets are written anew and a manifest
with the batch's number is created, which is the commit. A batch that is run again after a failure finds its manifest
and does nothing, or finds none and starts over. Since the fold is commutative, late and repeated changes need no
watermark: tombstones stay and win over older changes.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.fold import fold_changes
from tidemark.sources.fs import Folder


class FoldedTable:
    """State under ``folder``. ``buckets`` is fixed when the first batch comes: only touched buckets are rewritten."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], position: list[str], operation: str, payload: list[str], buckets: int = 64):
        self.spark, self.files = spark, Folder(spark, folder)
        self.keys, self.position, self.operation, self.payload, self.buckets = keys, position, operation, payload, buckets

    def _manifest(self) -> dict:
        names = [n for n in self.files.list("commits") if n.endswith(".json")]
        return json.loads(self.files.read(f"commits/{max(names)}")) if names else {"batch": -1, "buckets": self.buckets, "parts": {}}

    def _read(self, parts: dict[str, str], only: set[int] | None = None) -> DataFrame | None:
        paths = [self.files.uri(p) for b, p in parts.items() if only is None or int(b) in only]
        return self.spark.read.parquet(*paths) if paths else None

    def state(self, tombstones: bool = False) -> DataFrame | None:
        """The rows after all committed batches, None before the first."""
        df = self._read(self._manifest()["parts"])
        return df if df is None or tombstones else df.where(F.col(self.operation) != "Delete")

    def apply(self, changes: DataFrame, batch: int) -> bool:
        """Fold one batch in; False if it was committed before."""
        done = self._manifest()
        if batch <= done["batch"]:
            return False
        n = done["buckets"]
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(n)).cast("int")
        touched = {r[0] for r in changes.select(bucket).distinct().collect()}  # at most ``buckets`` numbers
        parts = dict(done["parts"])
        if touched:
            base = self._read(parts, touched)
            new = fold_changes(changes, self.keys, self.position, self.operation, self.payload, base=base)
            folder = f"data/batch-{batch:019d}"
            # as many tasks as a shuffle has, however few buckets there are: a bucket is written in pieces
            pieces = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // len(touched))
            piece = F.pmod(F.shiftright(F.xxhash64(*self.keys), 20), F.lit(pieces))
            new.withColumn("__bucket", bucket).repartition("__bucket", piece).write.mode("overwrite").partitionBy("__bucket").parquet(self.files.uri(folder))
            parts |= {name.split("=")[1]: f"{folder}/{name}" for name in self.files.list(folder) if name.startswith("__bucket=")}
        commit = {"batch": batch, "buckets": n, "parts": parts}
        if not self.files.create(f"commits/{batch:019d}.json", json.dumps(commit).encode()):
            raise OSError(f"batch {batch} is being committed by another query")
        return True

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Keep the state up to date with a streaming DataFrame of changes."""
        writer = stream.writeStream.foreachBatch(lambda df, batch: self.apply(df, batch) and None).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()
