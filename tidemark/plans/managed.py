"""Queries over tables and stores that are written first, so that a comparison covers the whole write path.

Each query makes a database of its own below the session's checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.engine.errors import ConflictError, ConstraintError
from tidemark.engine.kv import KVStore
from tidemark.engine.session import Database
from tidemark.session import scratch
from tidemark.sources import table


def _database(spark: SparkSession, folder: str, **keys: list[str]) -> Database:
    """A database with some of the folder's tables, loaded by the executors."""
    db = Database(spark, scratch(spark, "db"))
    for name, key in keys.items():
        db.load(name, table(spark, folder, name), key)
    return db


def managed_dml(spark: SparkSession, folder: str) -> DataFrame:
    """A table after INSERT ... SELECT, UPDATE and DELETE."""
    db = _database(spark, folder, supplier=["s_suppkey"], nation=["n_nationkey"])
    db.execute("INSERT INTO supplier SELECT s_suppkey + 1000000, s_name, s_nationkey, -s_acctbal FROM supplier WHERE s_nationkey < 5")
    db.execute("UPDATE supplier SET s_acctbal = s_acctbal * 2, s_name = 'moved' WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
    db.execute("DELETE FROM supplier WHERE s_acctbal < 0 AND s_suppkey < 1000000")
    return db.execute("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier").frame


def managed_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """A table after an upsert from a query, some of whose keys are there."""
    db = _database(spark, folder, supplier=["s_suppkey"], customer=["c_custkey"])
    db.execute(
        "INSERT INTO supplier (s_suppkey, s_nationkey, s_acctbal) SELECT c_custkey + 50, c_nationkey, c_acctbal FROM customer "
        "ON DUPLICATE KEY UPDATE s_acctbal = s_acctbal + VALUES(s_acctbal), s_nationkey = VALUES(s_nationkey)"
    )
    return db.execute("SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier").frame


def managed_alter(spark: SparkSession, folder: str) -> DataFrame:
    """A table after its columns were added, renamed, widened and dropped."""
    db = _database(spark, folder, nation=["n_nationkey"])
    db.execute("ALTER TABLE nation ADD COLUMN note TEXT DEFAULT 'none', RENAME COLUMN n_name TO label, MODIFY n_regionkey FLOAT, ADD COLUMN gone INTEGER")
    db.execute("UPDATE nation SET note = label WHERE n_regionkey > 2.5")
    db.execute("ALTER TABLE nation DROP COLUMN gone")
    return db.execute("SELECT * FROM nation").frame


def managed_transaction(spark: SparkSession, folder: str) -> DataFrame:
    """What is left after a commit, a conflict, a rollback and statements that break constraints."""
    db = _database(spark, folder, region=["r_regionkey"], nation=["n_nationkey"])
    db.execute("ALTER TABLE nation ADD CONSTRAINT in_region FOREIGN KEY (n_regionkey) REFERENCES region(r_regionkey), ADD CHECK (n_nationkey >= 0)")
    first, second, third = db.session(), db.session(), db.session()
    for s in (first, second, third):
        s.execute("BEGIN")
    first.execute("UPDATE nation SET n_name = 'first' WHERE n_nationkey < 3")
    second.execute("DELETE FROM nation WHERE n_nationkey < 10")
    third.execute("DELETE FROM nation")
    first.execute("COMMIT")
    try:
        second.execute("COMMIT")
    except ConflictError:
        pass
    third.execute("ROLLBACK")
    for broken in ("DELETE FROM region WHERE r_regionkey = 1", "INSERT INTO nation VALUES (1, 'twice', 1)", "UPDATE nation SET n_nationkey = -1 WHERE n_nationkey = 4", "INSERT INTO nation VALUES (99, 'lost', 77)"):
        try:
            db.execute(broken)
        except ConstraintError:
            continue
        raise AssertionError(broken)
    return db.execute("SELECT n_nationkey, n_name, n_regionkey FROM nation").frame


def managed_past(spark: SparkSession, folder: str) -> DataFrame:
    """A table as it was at an earlier version, read after it changed."""
    db = _database(spark, folder, region=["r_regionkey"])
    before = db.store.latest().version
    db.execute("DELETE FROM region WHERE r_regionkey > 1")
    db.execute("ALTER TABLE region RENAME COLUMN r_name TO other")
    return db.query_at(before, "SELECT r_regionkey, r_name FROM region")


def kv_store_state(spark: SparkSession, folder: str) -> DataFrame:
    """A key-value store after a bulk load, single writes, a snapshot and deletes."""
    kv = KVStore(spark, scratch(spark, "db"))
    kv.load(table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("kv_key"), F.col("c_name").alias("kv_value")))
    kv.set_many({"1": "one", "x": "new"})
    kv.snapshot()
    kv.delete("2")
    kv.set_async("3", "three")
    return kv.state().select("kv_key", "kv_value")


QUERIES = {f.__name__: f for f in (managed_dml, managed_upsert, managed_alter, managed_transaction, managed_past, kv_store_state)}

ORACLE = {
    "managed_dml": """WITH s AS (SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier
  UNION ALL SELECT s_suppkey + 1000000, s_name, CAST(s_nationkey AS BIGINT), -s_acctbal FROM supplier WHERE s_nationkey < 5),
u AS (SELECT s_suppkey, CASE WHEN hit THEN 'moved' ELSE s_name END AS s_name, s_nationkey, CASE WHEN hit THEN s_acctbal * 2 ELSE s_acctbal END AS s_acctbal
  FROM (SELECT *, s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AS hit FROM s) m)
SELECT * FROM u WHERE NOT (s_acctbal < 0 AND s_suppkey < 1000000)""",
    "managed_upsert": """SELECT COALESCE(t.s_suppkey, i.k) AS s_suppkey, CAST(COALESCE(i.n, t.s_nationkey) AS BIGINT) AS s_nationkey,
  CASE WHEN i.k IS NULL THEN t.s_acctbal WHEN t.s_suppkey IS NULL THEN i.v ELSE t.s_acctbal + i.v END AS s_acctbal
FROM supplier t FULL OUTER JOIN (SELECT c_custkey + 50 AS k, c_nationkey AS n, c_acctbal AS v FROM customer) i ON t.s_suppkey = i.k""",
    "managed_alter": """SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name AS label, CAST(n_regionkey AS DOUBLE) AS n_regionkey,
  CASE WHEN n_regionkey > 2.5 THEN n_name ELSE 'none' END AS note FROM nation""",
    "managed_transaction": """SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE WHEN n_nationkey < 3 THEN 'first' ELSE n_name END AS n_name,
  CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation""",
    "managed_past": "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region",
    "kv_store_state": """SELECT CAST(c_custkey AS VARCHAR) AS kv_key, CASE c_custkey WHEN 1 THEN 'one' WHEN 3 THEN 'three' ELSE c_name END AS kv_value
FROM customer WHERE c_custkey <> 2 UNION ALL SELECT 'x', 'new'""",
}
