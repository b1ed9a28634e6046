"""A key-value store kept as an operation log.

Every write appends operations to a Parquet segment of the log, numbered by a sequence that is given out when the write
is accepted, so buffered and direct writes keep their order. The present state is the fold of the log: the last
operation of each key after the last Clear. A snapshot is the folded state up to a sequence.
"""

from __future__ import annotations

import json
import threading
import time
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.engine.errors import SqlError
from tidemark.functions.walrecord import compact
from tidemark.operators.badrows import crc_of
from tidemark.operators.fold import fold_changes
from tidemark.session import local_frame
from tidemark.sources.fs import Folder

LOG = T.StructType(
    [
        T.StructField("sequence", T.LongType()),
        T.StructField("timestamp_millis", T.LongType()),
        T.StructField("operation", T.StringType()),
        T.StructField("kv_key", T.StringType()),
        T.StructField("kv_value", T.StringType()),
        T.StructField("checksum", T.LongType()),
    ]
)


def record_checksum(sequence: int, millis: int, operation: str, key: str | None, value: str | None) -> int:
    """The CRC-32 of a log record, over its numbers and its compact operation."""
    body = {
        "Set": lambda: f'{{"Set":{{"key":{compact(key)},"value":{compact(value)}}}}}',
        "Delete": lambda: f'{{"Delete":{{"key":{compact(key)}}}}}',
        "Clear": lambda: '"Clear"',
    }[operation]()
    return zlib.crc32(sequence.to_bytes(8, "little") + millis.to_bytes(8, "little") + body.encode())


def _json_text(name: str) -> Column:
    """A column as a JSON text, spelt as :func:`compact` spells it."""
    plain = F.replace(F.replace(F.col(name), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    whole = plain
    for i in range(32):
        whole = F.replace(whole, F.lit(chr(i)), F.lit(compact(chr(i))[1:-1]))
    return F.concat(F.lit('"'), F.when(F.col(name).rlike(r"[\x00-\x1f]"), whole).otherwise(plain), F.lit('"'))


def record_crc() -> Column:
    """:func:`record_checksum` of a row of :data:`LOG`, in the JVM."""
    body = (
        F.when(F.col("operation") == "Set", F.concat(F.lit('{"Set":{"key":'), _json_text("kv_key"), F.lit(',"value":'), _json_text("kv_value"), F.lit("}}")))
        .when(F.col("operation") == "Delete", F.concat(F.lit('{"Delete":{"key":'), _json_text("kv_key"), F.lit("}}")))
        .otherwise(F.lit('"Clear"'))
    )
    return crc_of([F.col("sequence"), F.col("timestamp_millis")], body)


class KVStore:
    """A store under a folder. ``flush_ms`` is how long a buffered write may wait for the background thread; 0 starts
    none."""

    def __init__(self, spark: SparkSession, root: str, flush_ms: int = 0):
        self.spark, self.files = spark, Folder(spark, root)
        self._lock = threading.RLock()
        self._pending: list[tuple] = []
        self._sequence = max([self.snapshot_sequence(), *(last for _, last, _ in self.segments())])
        #: Sequence of the last Clear, which is looked up once and kept up to date.
        self._cleared = self.log(self.snapshot_sequence()).where(F.col("operation") == "Clear").agg(F.max("sequence")).first()[0] or 0
        self._stop = threading.Event()
        if flush_ms:
            threading.Thread(target=self._flusher, args=(flush_ms / 1000,), daemon=True).start()

    def _flusher(self, every: float) -> None:
        while not self._stop.wait(every):
            self.flush()

    def close(self) -> None:
        self._stop.set()
        self.flush()

    # -- files
    def segments(self) -> list[tuple[int, int, str]]:
        """(first sequence, last sequence, name) of the log's segments."""
        out = []
        for n in self.files.list("log"):
            if n.startswith("seg-") and "_SUCCESS" in self.files.list(f"log/{n}"):
                a, b = n[4:].split("-")
                out.append((int(a), int(b), f"log/{n}"))
        return sorted(out)

    def snapshots(self) -> list[dict]:
        names = [n for n in self.files.list("snapshots") if n.endswith(".json")]
        return sorted((json.loads(self.files.read(f"snapshots/{n}")) for n in names), key=lambda s: s["sequence"])

    def snapshot_sequence(self) -> int:
        found = self.snapshots()
        return found[-1]["sequence"] if found else 0

    def wal_bytes(self) -> int:
        """Bytes of the log's segments that no snapshot holds yet."""
        after = self.snapshot_sequence()
        return sum(self.files.size(name) for _, last, name in self.segments() if last > after)

    def damaged(self) -> DataFrame:
        """Records of the log whose checksum is not that of their content."""
        return self.log().where(~F.col("checksum").eqNullSafe(record_crc()))

    def check(self) -> None:
        """Refuse a log with damaged records."""
        if n := self.damaged().count():
            raise SqlError(f"{n} records of the key-value log are damaged")

    def log(self, after: int = 0) -> DataFrame:
        """The operations after a sequence, those that still wait included."""
        paths = [self.files.uri(n) for _, last, n in self.segments() if last > after]
        pending = local_frame(self.spark, list(self._pending), LOG)
        if not paths:
            return pending.where(F.col("sequence") > after)
        return self.spark.read.schema(LOG).parquet(*paths).unionByName(pending).where(F.col("sequence") > after)

    def state(self, keys: list[str] | None = None) -> DataFrame:
        """Keys alive (of ``keys`` only, if given) with their value and the sequence that set it."""
        with self._lock:
            found = self.snapshots()
            base = None
            after = 0
            if found:
                after = found[-1]["sequence"]
                base = self.spark.read.parquet(self.files.uri(found[-1]["folder"]))
            log = self.log(after)
        if keys is not None:  # the filter reaches the scans of the log and of the snapshot
            wanted = F.col("kv_key").isin(keys)
            log, base = log.where(wanted | (F.col("operation") == "Clear")), None if base is None else base.where(wanted)
        if self._cleared > after:
            log, base = log.where(F.col("sequence") > self._cleared), None
        points = log.where(F.col("operation") != "Clear")
        return fold_changes(points, ["kv_key"], ["sequence"], "operation", ["kv_value"], base=base, tombstones=False)

    # -- writes
    def _record(self, operation: str, key: str | None = None, value: str | None = None) -> tuple:
        self._sequence += 1
        millis = int(time.time() * 1000)
        return (self._sequence, millis, operation, key, value, record_checksum(self._sequence, millis, operation, key, value))

    def _append(self, rows: list[tuple]) -> None:
        if rows:
            name = f"log/seg-{rows[0][0]:019d}-{rows[-1][0]:019d}"
            local_frame(self.spark, rows, LOG).coalesce(1).write.parquet(self.files.uri(name))

    def set(self, key: str, value: str) -> None:
        self.set_many({key: value})

    def set_many(self, pairs: dict[str, str]) -> None:
        """All pairs in one append."""
        with self._lock:
            self._pending += [self._record("Set", k, v) for k, v in pairs.items()]
            self.flush()

    def set_async(self, key: str, value: str) -> None:
        """Accepted at once, written with the next flush."""
        with self._lock:
            self._pending.append(self._record("Set", key, value))

    def delete(self, key: str) -> bool:
        """Whether the key was there."""
        with self._lock:
            there = self.get(key) is not None
            if there:
                self._pending.append(self._record("Delete", key))
                self.flush()
            return there

    def clear(self) -> None:
        with self._lock:
            self._pending.append(self._record("Clear"))
            self._cleared = self._sequence
            self.flush()

    def flush(self) -> None:
        with self._lock:
            rows, self._pending = self._pending, []
            try:
                self._append(rows)
            except BaseException:
                self._pending = rows + self._pending
                raise

    def load(self, pairs: DataFrame) -> int:
        """Set all rows of a DataFrame (kv_key, kv_value), written by the executors; the new sequence. Of rows with the
        same key the one with the greatest value stays; rows with a null are left out."""
        with self._lock:
            self.flush()
            first, now = self._sequence + 1, int(time.time() * 1000)
            rows = pairs.where(F.col("kv_key").isNotNull() & F.col("kv_value").isNotNull()).groupBy("kv_key").agg(F.max("kv_value").alias("kv_value"))
            numbered = rows.select(
                F.lit(first).cast("long").alias("sequence"), F.lit(now).cast("long").alias("timestamp_millis"), F.lit("Set").alias("operation"),
                "kv_key", "kv_value",
            )
            numbered.withColumn("checksum", record_crc()).write.parquet(self.files.uri(f"log/seg-{first:019d}-{first:019d}"))
            self._sequence = first
            return first

    # -- reads
    def get(self, key: str) -> str | None:
        row = self.state([key]).select("kv_value").first()
        return row[0] if row else None

    def get_many(self, keys: list[str]) -> list[tuple[str, str]]:
        """The pairs that are there, in the order asked for."""
        wanted = local_frame(self.spark, [(i, k) for i, k in enumerate(keys)], T.StructType([T.StructField("i", T.LongType()), T.StructField("kv_key", T.StringType())]))
        found = self.state(list(dict.fromkeys(keys))).join(F.broadcast(wanted), "kv_key").orderBy("i").select("kv_key", "kv_value")
        return [tuple(r) for r in found.collect()]

    def __len__(self) -> int:
        return self.state().count()

    def is_empty(self) -> bool:
        return not self.state().limit(1).count()

    @property
    def current_sequence(self) -> int:
        return self._sequence

    def wal_size(self) -> int:
        """Operations that no snapshot holds yet."""
        return self.log(self.snapshot_sequence()).count()

    def snapshot(self) -> int:
        """Write the state; the sequence it reaches."""
        with self._lock:
            self.flush()
            folder = f"snapshots/state-{self._sequence:019d}-{int(time.time() * 1000)}"
            self.state().write.parquet(self.files.uri(folder))
            meta = {"sequence": self._sequence, "timestamp_millis": int(time.time() * 1000), "folder": folder}
            self.files.create(f"snapshots/{self._sequence:019d}-{meta['timestamp_millis']}.json", json.dumps(meta).encode())
            return self._sequence
