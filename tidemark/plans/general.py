"""Queries of the log and table operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import badrows, dedup, fold, references
from tidemark.session import cut, scratch
from tidemark.sources import table
from tidemark.streaming.incremental import LogProcessor

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Keys and rows alive at the end of both logs."""
    kv = fold.kv_state(table(spark, folder, "kv_wal")).select(
        F.lit("kv").alias("engine"), "node_id", F.col("kv_key").alias("state_key"), F.col("sequence").alias("version")
    )
    sql = fold.sql_state(table(spark, folder, "sql_wal")).select(
        F.lit("sql").alias("engine"), "node_id", F.concat_ws(":", "tbl", "row_id").alias("state_key"), "version"
    )
    return kv.unionByName(sql)


def p1_kv_state(spark: SparkSession, folder: str) -> DataFrame:
    """The key-value store of each node with its values."""
    return fold.kv_state(table(spark, folder, "kv_wal"))


def p1_state_in_batches(spark: SparkSession, folder: str) -> DataFrame:
    """The key-value store of each node, folded batch by batch: later batches first, one of them twice."""
    log, state = table(spark, folder, "kv_wal"), None
    part = F.pmod("batch_id", F.lit(3))
    for n in (2, 0, 0):
        state = cut(fold.kv_fold(log.where(part == n), state))
    return fold.kv_state(log.where((part == 1) | part.isNull()), state)


def _deliveries(spark: SparkSession, folder: str) -> DataFrame:
    kv = table(spark, folder, "kv_wal").select(F.lit("kv").alias("engine"), "node_id", F.col("sequence").alias("version"), "delivery_id", "arrived_at")
    sql = table(spark, folder, "sql_wal").select(F.lit("sql").alias("engine"), "node_id", F.col("commit_version").alias("version"), "delivery_id", "arrived_at")
    return kv.unionByName(sql)


#: Deliveries are numbered in the order they arrive; the number is unique and so breaks every tie.
DELIVERY = ["delivery_id", "arrived_at"]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries to drop."""
    parts = []
    for engine, name, version in (("kv", "kv_wal", "sequence"), ("sql", "sql_wal", "commit_version")):
        rows = table(spark, folder, name).select("node_id", version, *DELIVERY)
        parts.append(dedup.surplus(rows, ["node_id", version], "delivery_id", DELIVERY).select(F.lit(engine).alias("engine"), "delivery_id"))
    return parts[0].unionByName(parts[1])


def p2_kept(spark: SparkSession, folder: str) -> DataFrame:
    """How many records each node has once the copies are dropped, and how many deliveries there were."""
    rows = _deliveries(spark, folder)
    kept = dedup.keepers(rows, ["engine", "node_id", "version"], DELIVERY)
    per_node = kept.groupBy("engine", "node_id").agg(F.count(F.lit(1)).alias("records"))
    all_rows = rows.groupBy("engine", "node_id").agg(F.count(F.lit(1)).alias("deliveries"))
    return all_rows.join(per_node, ["engine", "node_id"])


def _period(at: Column) -> Column:
    return F.substring(at.cast("string"), 1, 7)


#: Referenced table, referencing column, and the columns of a row's life.
REFERENCES = (("users", "user_id", "created_at", "deleted_at"), ("products", "product_id", "listed_at", "delisted_at"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Orders that name a user or product not live at the time."""
    refs = [references.Reference(name, column, table(spark, folder, name), "id", since, until) for name, column, since, until in REFERENCES]
    found = references.orphans(table(spark, folder, "shop_orders"), "id", "ordered_at", refs)
    return found.select("ref_table", _period(F.col("ordered_at")).alias("period"), F.col("id").alias("order_id")).distinct()


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references and their share by table and month."""
    orders = table(spark, folder, "shop_orders").where(F.col("ordered_at").isNotNull())
    checked = None
    for name, column, *_ in REFERENCES:
        part = orders.where(F.col(column).isNotNull()).select(
            F.lit(name).alias("ref_table"), _period(F.col("ordered_at")).alias("period"), F.col("id").alias("order_id")
        ).distinct()
        checked = part if checked is None else checked.unionByName(part)
    return references.orphan_report(p3_found(spark, folder), checked)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records that no successful run has taken in: the next batch of a processor that takes over these runs."""
    runs, place = table(spark, folder, "recovery_points").where(F.col("status") == "ok"), scratch(spark, "p4")

    def left(engine: str, name: str, version: str, point: str) -> DataFrame:
        log = table(spark, folder, name).select("node_id", version, "arrived_at")
        processor = LogProcessor(spark, f"{place}/{engine}", ["node_id"], version, "arrived_at")
        processor.adopt(runs, "started_at", point)
        processor.run(log, lambda df: df.select(F.lit(engine).alias("engine"), "node_id", version))
        found = processor.results()
        return (log.limit(0).select(F.lit(engine).alias("engine"), "node_id", version) if found is None else found).withColumnRenamed(version, "version")

    logs = (("kv", "kv_wal", "sequence", "kv_sequence"), ("sql", "sql_wal", "commit_version", "sql_commit_version"))
    with ThreadPoolExecutor(len(logs)) as pool:  # the logs do not depend on one another, so their small jobs overlap
        started = [pool.submit(inheritable_thread_target(spark)(left), *log) for log in logs]
        kv, sql = (s.result() for s in started)
    return kv.unionByName(sql)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that fail, with the reason."""
    return badrows.bad_lines(table(spark, folder, "wal_lines"))


def p5_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """How many lines of each engine load."""
    good = badrows.good_lines(table(spark, folder, "wal_lines"))
    return good.groupBy("engine").agg(F.count(F.lit(1)).alias("loaded"))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (p1_found, p1_kv_state, p1_state_in_batches, p2_found, p2_kept, p3_found, p3_report, p4_found, p5_found, p5_loaded)
}

_P3 = """SELECT DISTINCT 'users' AS ref_table, strftime(o.ordered_at, '%Y-%m') AS period, o.id AS order_id FROM shop_orders o
WHERE o.user_id IS NOT NULL AND o.ordered_at IS NOT NULL AND NOT EXISTS (SELECT 1 FROM users u WHERE u.id = o.user_id
  AND u.created_at <= o.ordered_at AND (u.deleted_at IS NULL OR u.deleted_at > o.ordered_at))
UNION ALL
SELECT DISTINCT 'products', strftime(o.ordered_at, '%Y-%m'), o.id FROM shop_orders o
WHERE o.product_id IS NOT NULL AND o.ordered_at IS NOT NULL AND NOT EXISTS (SELECT 1 FROM products p WHERE p.id = o.product_id
  AND p.listed_at <= o.ordered_at AND (p.delisted_at IS NULL OR p.delisted_at > o.ordered_at))"""

_P4 = """SELECT '{e}' AS engine, w.node_id, w.version FROM (SELECT node_id, {v} AS version, min(arrived_at) AS first
  FROM {t} WHERE node_id IS NOT NULL AND {v} IS NOT NULL GROUP BY ALL) w
WHERE NOT EXISTS (SELECT 1 FROM recovery_points r WHERE r.status = 'ok' AND r.node_id = w.node_id
  AND r.started_at >= w.first AND r.{p} >= w.version)"""

_P1 = """WITH last AS (SELECT node_id, kv_key, max(sequence) AS sequence, arg_max(operation, sequence) AS op,
  arg_max(coalesce(kv_value, ''), sequence) AS kv_value FROM kv_wal WHERE operation IN ('Set', 'Delete') GROUP BY node_id, kv_key),
clears AS (SELECT node_id, max(sequence) AS c FROM kv_wal WHERE operation = 'Clear' GROUP BY node_id)
SELECT l.node_id, l.kv_key, l.sequence, l.kv_value FROM last l LEFT JOIN clears c ON l.node_id = c.node_id
WHERE l.op = 'Set' AND (c.c IS NULL OR l.sequence > c.c)"""

ORACLE: dict[str, str] = {
    "p1_kv_state": _P1,
    "p1_state_in_batches": _P1,
    "p2_found": """SELECT 'kv' AS engine, delivery_id FROM (SELECT delivery_id, row_number() OVER
  (PARTITION BY node_id, sequence ORDER BY delivery_id) AS n FROM kv_wal) WHERE n > 1
UNION ALL SELECT 'sql', delivery_id FROM (SELECT delivery_id, row_number() OVER
  (PARTITION BY node_id, commit_version ORDER BY delivery_id) AS n FROM sql_wal) WHERE n > 1""",
    "p2_kept": """SELECT 'kv' AS engine, node_id, count(*) AS deliveries, count(DISTINCT sequence) AS records FROM kv_wal GROUP BY node_id
UNION ALL SELECT 'sql', node_id, count(*), count(DISTINCT commit_version) FROM sql_wal GROUP BY node_id""",
    "p3_found": _P3,
    "p3_report": f"""WITH found AS ({_P3}), checked AS (
SELECT DISTINCT 'users' AS ref_table, strftime(ordered_at, '%Y-%m') AS period, id FROM shop_orders WHERE user_id IS NOT NULL AND ordered_at IS NOT NULL
UNION ALL SELECT DISTINCT 'products', strftime(ordered_at, '%Y-%m'), id FROM shop_orders WHERE product_id IS NOT NULL AND ordered_at IS NOT NULL),
f AS (SELECT ref_table, period, count(*) AS n FROM found GROUP BY ALL), c AS (SELECT ref_table, period, count(*) AS n FROM checked GROUP BY ALL)
SELECT c.ref_table, c.period, c.n AS checked, coalesce(f.n, 0) AS orphans, round(coalesce(f.n, 0) / c.n, 6) AS share
FROM c LEFT JOIN f ON c.ref_table = f.ref_table AND c.period = f.period""",
    "p4_found": "\nUNION ALL ".join(
        _P4.format(e=e, t=t, v=v, p=p)
        for e, t, v, p in (("kv", "kv_wal", "sequence", "kv_sequence"), ("sql", "sql_wal", "commit_version", "sql_commit_version"))
    ),
}
