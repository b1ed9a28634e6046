"""Applying a stream of inserts, updates and deletes in any order of arrival.

The fold is commutative: the present state of a key is the operation with the greatest position, found by
``max(struct(position, ...))`` per key. Spark aggregates it map-side first, so a key that holds a third of all rows
costs one partial row a task. Removed keys stay as tombstones, so a change that arrives late loses against them.
Operations on many keys at once (Clear, DELETE without WHERE, ranges) are kept as aligned blocks of keys and joined to
the keys by block, never by comparing every key with every operation.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import intervals, logsql
from tidemark.operators.skew import join_counted
from tidemark.session import cut


def fold_changes(
    changes: DataFrame,
    keys: list[str],
    position: list[str],
    operation: str,
    payload: list[str],
    delete: str = "Delete",
    base: DataFrame | None = None,
    tombstones: bool = True,
) -> DataFrame:
    """The latest change of each key: ``keys``, ``position``, ``operation``, ``payload``.

    ``base`` is an earlier result of this function (or rows of the same columns) and takes part like any other change,
    so batches can be folded one after another in any order. Repeated changes have no effect. Of different changes at
    the same position the greater (operation, payload) wins, whatever the order of arrival. Rows with a null in a
    position are dropped: they cannot be ordered. Null keys form a key of their own. With ``tombstones`` false the
    deleted keys are left out, which is only right for the last batch. An empty input gives an empty result.
    """
    parts = [*position, operation, *payload]
    rows = changes.select(*keys, *parts)
    if base is not None:
        rows = rows.unionByName(base.select(*keys, *parts))
    for p in position:
        rows = rows.where(F.col(p).isNotNull())
    latest = rows.groupBy(*keys).agg(F.max(F.struct(*parts)).alias("__last")).select(*keys, "__last.*")
    return latest if tombstones else latest.where(F.col(operation) != delete)


def _kv_changes(log: DataFrame, payload: list[str]) -> DataFrame:
    """The changes of a key-value log as rows to fold. A ``Clear`` is a change of the null key, which is no other change's."""
    clear = F.col("operation") == "Clear"
    key = F.when(~clear, F.col("kv_key"))
    known = F.col("node_id").isNotNull() & F.col("operation").isin("Set", "Delete", "Clear") & (clear | F.col("kv_key").isNotNull())
    return log.where(known).select("node_id", key.alias("kv_key"), "sequence", "operation", *payload)


def kv_fold(log: DataFrame, base: DataFrame | None = None, payload: tuple[str, ...] = ("kv_value",)) -> DataFrame:
    """The folded state of a key-value log, to be the ``base`` of the next batch: node_id, kv_key, sequence, operation and
    ``payload``.

    One row a key, tombstones of deleted keys included, and one row with a null key a node that was ever cleared: its
    last ``Clear``. Batches may be folded in any order and more than once. Rows with a null node, sequence or operation
    are no records and are ignored, as are Set and Delete without a key.
    """
    parts = ["node_id", "kv_key"], ["sequence"], "operation", list(payload)
    return fold_changes(_kv_changes(log, list(payload)), *parts, base=base)


def kv_state(log: DataFrame, base: DataFrame | None = None, payload: tuple[str, ...] = ("kv_value",)) -> DataFrame:
    """Keys alive after all records of a key-value log: node_id, kv_key, sequence and ``payload``.

    ``log`` has node_id, sequence, operation (``Set``, ``Delete``, ``Clear``), kv_key and kv_value; ``base`` is a state
    of :func:`kv_fold` over earlier records. A ``Clear`` removes the node's keys set at a lower sequence, in whichever
    batch they come. Keys are compared byte by byte. See :func:`kv_fold` for rows that are no records.
    """
    changes = _kv_changes(log, list(payload))
    if base is not None:
        changes = changes.unionByName(base.select(*changes.columns))
    points = changes.where(F.col("operation") != "Clear")
    latest = fold_changes(points, ["node_id", "kv_key"], ["sequence"], "operation", list(payload), tombstones=False)
    clears = changes.where(F.col("operation") == "Clear").groupBy("node_id").agg(F.max("sequence").alias("__clear"))
    return (
        join_counted(latest, clears, ["node_id"], "left", F.col("kv_key"))
        .where(F.col("__clear").isNull() | (F.col("sequence") > F.col("__clear")))
        .select("node_id", "kv_key", "sequence", *payload)
    )


EFFECTS = "node_id string, commit_version long, place int, tbl string, kind string, level int, prefix long"


def effect_rows(key: str, strict: bool):
    """A function for mapInArrow: rows of node_id, commit_version, statements to rows of :data:`EFFECTS`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("node_id", pa.string()), ("commit_version", pa.int64()), ("place", pa.int32()), ("tbl", pa.string()), ("kind", pa.string()), ("level", pa.int32()), ("prefix", pa.int64())]
        )
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            nodes, versions, texts = (batch.column(i).to_pylist() for i in range(3))
            for node, version, text in zip(nodes, versions, texts, strict=True):
                if text is None:
                    continue
                try:
                    effects = logsql.list_effects(text, key)
                except (logsql.Unsupported, ValueError, KeyError, TypeError, AttributeError) as error:
                    if strict:
                        raise ValueError(f"node {node}, commit {version}: {error}") from error
                    continue
                for place, table, kind, lo, hi in effects:
                    for level, prefix in intervals.blocks(lo, hi):
                        for c, v in zip(cols, (node, version, place, table, kind, level, prefix), strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)

    return run


#: What a block of keys is folded by: whether its rows exist, which the last insert or delete decides, and what last met
#: them with an update, which creates no row and so must not hide a delete.
EXISTS, TOUCHED = "exists", "touched"
_BLOCK = ["node_id", "tbl", "level", "prefix", "register"]


def sql_fold(log: DataFrame, base: DataFrame | None = None, key: str = "id", strict: bool = True) -> DataFrame:
    """The folded state of a statement log, to be the ``base`` of the next batch: node_id, tbl, level, prefix, register,
    commit_version, place, kind.

    Every statement is a change of blocks of keys; each block keeps its last insert or delete and its last update. What a
    DELETE or UPDATE of a range did stays as a tombstone of the range, so an insert that arrives late loses against it.
    A statement whose effect cannot be told from its keys stops the query, or with ``strict`` false its commit is left
    out. Batches may be folded in any order and more than once. Rows with a null node or commit are no records.
    """
    rows = log.where(F.col("node_id").isNotNull() & F.col("commit_version").isNotNull()).select("node_id", "commit_version", "statements")
    register = F.when(F.col("kind") == "U", TOUCHED).otherwise(EXISTS)
    changes = rows.mapInArrow(effect_rows(key, strict), EFFECTS).withColumn("register", register)
    return fold_changes(changes, _BLOCK, ["commit_version", "place"], "kind", [], base=base)


def sql_alive(state: DataFrame) -> DataFrame:
    """Rows alive in a state of :func:`sql_fold`: node_id, tbl, row_id, version."""
    state = cut(state).withColumn("__last", F.struct("commit_version", "place", "kind"))
    points = state.where(F.col("level") == 0).select("node_id", "tbl", F.col("prefix").alias("row_id"), "register", "__last")
    wide = state.where(F.col("level") > 0).select("node_id", "tbl", "level", "prefix", "register", "__last")
    n, levels = wide.agg(F.count(F.lit(1)), F.sort_array(F.collect_set("level"))).first()  # at most 64 / STEP numbers
    if n:
        at = F.explode(F.array(*[F.lit(x) for x in levels])).alias("level")
        inserted = points.where((F.col("register") == EXISTS) & (F.col("__last.kind") == "I"))
        keyed = inserted.select("node_id", "tbl", "row_id", at).withColumn(
            "prefix", F.when(F.col("level") == 64, F.lit(0).cast("long")).otherwise(F.expr("shiftright(row_id, level)"))
        )
        met = join_counted(keyed, wide, ["node_id", "tbl", "level", "prefix"], "inner", F.col("row_id"), rows=n)
        points = points.unionByName(met.select(*points.columns))

    def last(register: str, of: Column) -> Column:
        return F.max(F.when(F.col("register") == register, of)).alias(register)

    return (
        points.groupBy("node_id", "tbl", "row_id")
        .agg(last(EXISTS, F.col("__last")), last(TOUCHED, F.col("__last.commit_version")))
        .where(F.col(f"{EXISTS}.kind") == "I")
        .select("node_id", "tbl", "row_id", F.greatest(F.col(f"{EXISTS}.commit_version"), F.col(TOUCHED)).alias("version"))
    )


def sql_state(log: DataFrame, base: DataFrame | None = None, key: str = "id", strict: bool = True) -> DataFrame:
    """Rows alive after all commits of a statement log: node_id, tbl, row_id, version.

    ``log`` has node_id, commit_version and statements (JSON list); ``base`` is a state of :func:`sql_fold` over earlier
    commits. A row is alive if its last insert comes after the last delete that meets it; version is the last commit that
    inserted it or met it with an update. Empty or null statement lists have no effect; repeated commits none either.
    """
    return sql_alive(sql_fold(log, base, key, strict))
