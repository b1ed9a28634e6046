"""Queries that run statements of every kind on a database of their own, with SQL for what must come out."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.engine import imports, recovery
from tidemark.engine.errors import SqlError
from tidemark.engine.kv import KVStore
from tidemark.engine.session import Database, Session
from tidemark.functions.walrecord import checksum, compact
from tidemark.session import scratch
from tidemark.sources import table


def _database(spark: SparkSession, folder: str = "", **keys: list[str]) -> Database:
    """A database with some of the folder's tables, loaded by the executors."""
    db = Database(spark, scratch(spark, "db"))
    for name, key in keys.items():
        db.load(name, table(spark, folder, name), key)
    return db


def _lines(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def _outcomes(spark: SparkSession, session: Session | Database, statements: dict[str, str]) -> DataFrame:
    """Whether each statement is accepted: name, outcome."""
    out = []
    for name, sql in statements.items():
        try:
            result = session.execute(sql)
            if result.frame is not None:
                result.frame.schema  # noqa: B018
            out.append((name, "accepted"))
        except SqlError:
            out.append((name, "refused"))
    return _lines(spark, out, "name string, outcome string")


#: Statements that the dialect leaves out, by the operator that refuses them. Those named ok_ are accepted.
REFUSED = {
    "star_except": "SELECT * EXCEPT (n_name) FROM nation", "star_replace": "SELECT * REPLACE (1 AS n_name) FROM nation",
    "expr_case": "SELECT CASE WHEN n_nationkey = 1 THEN 1 END FROM nation", "expr_cast": "SELECT CAST(n_nationkey AS TEXT) FROM nation",
    "expr_between": "SELECT n_name FROM nation WHERE n_nationkey BETWEEN 1 AND 2", "expr_function": "SELECT UPPER(n_name) FROM nation", "expr_concat": "SELECT n_name || 'x' FROM nation",
    "join_full": "SELECT 1 FROM nation n FULL OUTER JOIN region r ON n.n_regionkey = r.r_regionkey", "join_natural": "SELECT 1 FROM nation NATURAL JOIN region",
    "join_using": "SELECT 1 FROM nation n INNER JOIN nation m USING (n_nationkey)", "join_comma": "SELECT 1 FROM nation, region",
    "agg_window": "SELECT SUM(n_nationkey) OVER () FROM nation", "agg_filter": "SELECT COUNT(*) FILTER (WHERE n_nationkey > 1) FROM nation", "agg_nested": "SELECT SUM(COUNT(*)) FROM nation",
    "agg_in_where": "SELECT n_name FROM nation WHERE COUNT(*) > 1", "agg_unknown": "SELECT STDDEV(n_nationkey) FROM nation", "agg_group_alias": "SELECT n_regionkey AS k, COUNT(*) FROM nation GROUP BY k",
    "limit_offset": "SELECT n_name FROM nation LIMIT 3 OFFSET 2", "limit_fetch": "SELECT n_name FROM nation FETCH FIRST 3 ROWS ONLY",
    "subq_correlated": "SELECT n_name FROM nation n WHERE EXISTS (SELECT 1 FROM region r WHERE r.r_regionkey = n.n_regionkey)",
    "cte_recursive": "WITH RECURSIVE t AS (SELECT 1 AS a) SELECT a FROM t", "set_union": "SELECT 1 UNION SELECT 2",
    "ddl_view": "CREATE VIEW v AS SELECT 1", "ddl_temporary": "CREATE TEMPORARY TABLE x (id INTEGER)", "ddl_as_select": "CREATE TABLE x AS SELECT 1", "ddl_truncate": "TRUNCATE TABLE nation",
    "dml_returning": "INSERT INTO nation VALUES (90, 'x', 1) RETURNING n_name", "dml_ignore": "INSERT IGNORE INTO nation VALUES (90, 'x', 1)", "dml_update_from": "UPDATE nation SET n_name = r_name FROM region",
    "dml_delete_limit": "DELETE FROM nation LIMIT 1", "dml_replace": "REPLACE INTO nation VALUES (1, 'x', 1)",
    "tx_savepoint": "SAVEPOINT a", "tx_release": "RELEASE SAVEPOINT a", "connector": "SELECT * FROM read_csv('x')",
    "ok_select": "SELECT n_name FROM nation", "ok_star": "SELECT * FROM nation", "ok_describe": "DESCRIBE nation", "ok_show": "SHOW TABLES",
}


def refused_statements(spark: SparkSession, folder: str) -> DataFrame:
    """What the dialect leaves out is refused, not passed over."""
    return _outcomes(spark, _database(spark, folder, nation=["n_nationkey"], region=["r_regionkey"]).session(), REFUSED)


def insert_values(spark: SparkSession, folder: str) -> DataFrame:
    """CREATE TABLE, then INSERT of several rows, with columns left out that have a default or none."""
    db = _database(spark)
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, label TEXT DEFAULT 'none', price FLOAT, ok BOOLEAN DEFAULT TRUE)")
    db.execute("CREATE TABLE IF NOT EXISTS t (id INTEGER)")
    db.execute("INSERT INTO t VALUES (1, 'a', 1.5, FALSE), (2, NULL, 2, NULL)")
    db.execute("INSERT INTO t (price, id) VALUES (-3, 3), (NULL, 4)")
    return db.execute("SELECT * FROM t").frame


def insert_select(spark: SparkSession, folder: str) -> DataFrame:
    """INSERT ... SELECT from the table itself."""
    db = _database(spark, folder, nation=None)
    db.execute("INSERT INTO nation (n_name, n_nationkey) SELECT n_name, n_nationkey + 100 FROM nation WHERE n_regionkey = 1")
    return db.execute("SELECT n_nationkey, n_name, n_regionkey FROM nation").frame


def dropped_table(spark: SparkSession, folder: str) -> DataFrame:
    """SHOW TABLES after DROP TABLE, also of one that is not there or is referenced."""
    db = _database(spark, folder, region=["r_regionkey"], nation=["n_nationkey"])
    db.execute("ALTER TABLE nation ADD CONSTRAINT f FOREIGN KEY (n_regionkey) REFERENCES region(r_regionkey)")
    db.execute("CREATE TABLE t (id INTEGER)")
    for sql in ("DROP TABLE t", "DROP TABLE IF EXISTS t", "DROP TABLE t", "DROP TABLE region"):
        try:
            db.execute(sql)
        except SqlError:
            continue
    return _lines(spark, [(n,) for n in db.execute("SHOW TABLES").lines], "name string")


def table_indexes(spark: SparkSession, folder: str) -> DataFrame:
    """SHOW INDEXES: automatic ones of keys, one created, one dropped, one refused."""
    db = _database(spark)
    db.execute("CREATE TABLE p (id INTEGER PRIMARY KEY)")
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, code TEXT UNIQUE, a INTEGER, b INTEGER REFERENCES p(id))")
    db.execute("CREATE INDEX by_a ON t (a, code)")
    db.execute("CREATE UNIQUE INDEX gone ON t (a)")
    db.execute("DROP INDEX gone ON t")
    for sql in ("CREATE INDEX by_a ON t (b)", "DROP INDEX t_pk ON t", "CREATE INDEX x ON t (nothing)"):
        try:
            db.execute(sql)
        except SqlError:
            continue
    return _lines(spark, db.execute("SHOW INDEXES FROM t").values, "name string, columns string, is_unique boolean")


def indexed_range(spark: SparkSession, folder: str) -> DataFrame:
    """A range read from a table whose files are clustered by an index."""
    db = _database(spark)
    db.execute("CREATE TABLE o (o_orderkey INTEGER PRIMARY KEY, o_custkey INTEGER, o_orderstatus TEXT, o_totalprice FLOAT)")
    db.execute("CREATE INDEX by_status ON o (o_orderstatus, o_totalprice)")
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    db.append("o", table(spark, folder, "orders").select(*columns))
    return db.execute("SELECT o_orderkey, o_custkey, o_totalprice FROM o WHERE o_orderstatus = 'F' AND o_totalprice >= 150000").frame


def bloom_point(spark: SparkSession, folder: str) -> DataFrame:
    """One row, by a unique key whose files carry bloom filters, and one key that is not there."""
    db = _database(spark, folder, customer=["c_custkey"])
    return db.execute("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (77, 999999999)").frame


def explained_scan(spark: SparkSession, folder: str) -> DataFrame:
    """What EXPLAIN says about reading a table by key, by range and by a column without an index."""
    db = _database(spark)
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, a INTEGER, b INTEGER)")
    db.execute("CREATE INDEX by_a ON t (a)")
    db.execute("INSERT INTO t VALUES (1, 1, 1)")
    conditions = {"key": "id = 1", "range": "a > 0 AND b = 1", "neither": "b = 1", "either": "id = 1 OR b = 1", "key range": "id > 0"}
    rows = [(n, db.execute(f"EXPLAIN DELETE FROM t WHERE {c}").lines[0]) for n, c in conditions.items()]
    return _lines(spark, rows, "name string, scan string")


def described_table(spark: SparkSession, folder: str) -> DataFrame:
    """DESCRIBE after changes of defaults, nullability, types and constraints."""
    db = _database(spark)
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, a INTEGER NOT NULL, b TEXT UNIQUE, c INTEGER)")
    db.execute("ALTER TABLE t ALTER COLUMN a DROP NOT NULL, ALTER COLUMN c SET DATA TYPE FLOAT, ALTER COLUMN c SET NOT NULL, ADD COLUMN d BOOLEAN NOT NULL DEFAULT FALSE, DROP CONSTRAINT t_b_uk")
    return _lines(spark, db.execute("DESCRIBE t").values, "name string, type string, nullable string, primary_key string, is_unique string")


def altered_defaults(spark: SparkSession, folder: str) -> DataFrame:
    """Rows inserted before and after defaults were set and dropped; an ALTER that fails half-way changes nothing."""
    db = _database(spark)
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, a INTEGER, b TEXT DEFAULT 'x')")
    db.execute("INSERT INTO t (id) VALUES (1)")
    db.execute("ALTER TABLE t ALTER COLUMN a SET DEFAULT 7, ALTER COLUMN b DROP DEFAULT")
    db.execute("INSERT INTO t (id) VALUES (2)")
    try:
        db.execute("ALTER TABLE t ADD COLUMN c INTEGER, ALTER COLUMN a SET NOT NULL")
    except SqlError:
        pass
    return db.execute("SELECT * FROM t").frame


def kept_constraints(spark: SparkSession, folder: str) -> DataFrame:
    """Which writes each kind of constraint lets pass, and what dropping one allows."""
    db = _database(spark)
    db.execute("CREATE TABLE p (id INTEGER PRIMARY KEY)")
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, a INTEGER NOT NULL, b TEXT UNIQUE, q INTEGER CHECK (q > 0), r INTEGER, CONSTRAINT to_p FOREIGN KEY (r) REFERENCES p(id))")
    db.execute("INSERT INTO p VALUES (1)")
    writes = {
        "whole": "INSERT INTO t VALUES (1, 1, 'x', 1, 1)", "nulls": "INSERT INTO t VALUES (2, 1, NULL, NULL, NULL)", "nulls again": "INSERT INTO t VALUES (3, 1, NULL, NULL, NULL)",
        "not null": "INSERT INTO t VALUES (4, NULL, 'y', 1, 1)", "left out": "INSERT INTO t (id) VALUES (5)", "primary key": "INSERT INTO t VALUES (1, 1, 'z', 1, 1)", "null key": "INSERT INTO t VALUES (NULL, 1, 'z', 1, 1)",
        "unique": "INSERT INTO t VALUES (6, 1, 'x', 1, 1)", "check": "INSERT INTO t VALUES (7, 1, 'w', 0, 1)", "foreign key": "INSERT INTO t VALUES (8, 1, 'v', 1, 2)", "one of two": "INSERT INTO t VALUES (9, 1, 'u', 1, 1), (10, NULL, 't', 1, 1)",
        "update to null": "UPDATE t SET a = NULL WHERE id = 1", "parent": "DELETE FROM p", "drop": "ALTER TABLE t DROP CONSTRAINT to_p", "foreign key dropped": "INSERT INTO t VALUES (8, 1, 'v', 1, 2)", "parent dropped": "DELETE FROM p",
        "add over bad rows": "ALTER TABLE t ADD CONSTRAINT again FOREIGN KEY (r) REFERENCES p(id)", "type": "INSERT INTO t VALUES ('x', 1, 'q', 1, 1)",
    }
    return _outcomes(spark, db, writes)


def prepared_statements(spark: SparkSession, folder: str) -> DataFrame:
    """SET, PREPARE, EXECUTE ... USING and DEALLOCATE in one session."""
    s = _database(spark, folder, nation=["n_nationkey"]).session()
    s.execute("SET @text = 'SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = ? AND n_nationkey > ?'")
    s.execute("PREPARE q FROM @text")
    s.execute("PREPARE w FROM 'UPDATE nation SET n_name = ? WHERE n_nationkey = ?'")
    for name, value in (("r", "1"), ("k", "2"), ("n", "'it''s'"), ("which", "3")):
        s.execute(f"SET @{name} = {value}")
    s.execute("EXECUTE w USING @n, @which")
    s.execute("DEALLOCATE PREPARE w")
    try:
        s.execute("EXECUTE w USING @n, @which")
    except SqlError:
        return s.execute("EXECUTE q USING @r, @k").frame
    raise AssertionError("a statement that was given up still runs")


def statement_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Statements parted by semicolons, one of them inside a text, in one session with a transaction."""
    db = _database(spark)
    db.execute_batch("CREATE TABLE t (id INTEGER, a TEXT); BEGIN; INSERT INTO t VALUES (1, 'a;b'); COMMIT; BEGIN; DELETE FROM t; ROLLBACK; INSERT INTO t VALUES (2, 'c');")
    return db.execute("SELECT * FROM t").frame


def upsert_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """An upsert whose keys meet several times in the batch, over all orders: each row changes what came before it."""
    db = _database(spark)
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, n INTEGER, last INTEGER)")
    db.execute("INSERT INTO t VALUES (1, 100, 0), (-1, 5, 0)")
    db.append("t", table(spark, folder, "customer").where("c_custkey > 10").selectExpr("c_custkey AS id", "1000L AS n", "0L AS last"))
    db.load("o", table(spark, folder, "orders").selectExpr("o_custkey AS k", "o_orderkey AS v"))
    db.execute("INSERT INTO t SELECT k, 1, v FROM o ORDER BY v ON DUPLICATE KEY UPDATE n = n + 1, last = VALUES(last)")
    return db.execute("SELECT * FROM t").frame


def text_table(spark: SparkSession, folder: str) -> DataFrame:
    """A result as a table of characters, by line."""
    text = _database(spark, folder, region=["r_regionkey"]).execute("SELECT r_regionkey, r_name, NULL AS nothing, r_regionkey > 1 AS big FROM region WHERE r_regionkey < 2 ORDER BY r_regionkey").text()
    return _lines(spark, [(i, line.rstrip()) for i, line in enumerate(text.split("\n"))], "n int, line string")


def imported_json(spark: SparkSession, folder: str) -> DataFrame:
    """A table from its JSON description."""
    db = _database(spark)
    column = lambda name, kind, **more: {"name": name, "data_type": kind, "nullable": True, "primary_key": False, "unique": False} | more
    rows = [{"values": [{"Integer": 1}, {"Text": "one"}, {"Float": 1.5}]}, {"values": [{"Integer": 2}, "Null", {"Float": -2.0}]}]
    value = {"schema": {"name": "Things", "columns": [column("ID", "INTEGER", primary_key=True, nullable=False), column("label", "TEXT"), column("price", "FLOAT")]}, "rows": rows}
    imports.table_from_json(db, json.dumps(value))
    return db.execute("SELECT * FROM things").frame


def replayed_log(spark: SparkSession, folder: str) -> DataFrame:
    """Tables from a log of commits: SQL texts and statement trees; a commit that comes again is passed over."""
    db = _database(spark)

    def line(version: int, statements: list[dict]) -> str:
        body = "[" + ",".join(f'{{"Sql":{compact(s["Sql"])}}}' if "Sql" in s else json.dumps(s, separators=(",", ":")) for s in statements) + "]"
        numbers = [version - 1, version, 1_700_000_000_000 + version]
        return f'{{"format_version":2,"base_version":{numbers[0]},"commit_version":{version},"timestamp_millis":{numbers[2]},"statements":{body},"checksum":{checksum(numbers, body)}}}'

    tree = {"Update": {"table_name": "t", "assignments": [["a", {"Literal": {"Text": "two"}}]], "selection": {"Binary": {"left": {"Column": {"qualifier": None, "name": "id"}}, "op": {"Compare": "Equal"}, "right": {"Literal": {"Integer": 2}}}}}}
    first = line(1, [{"Sql": "CREATE TABLE t (id INTEGER PRIMARY KEY, a TEXT)"}, {"Sql": "INSERT INTO t VALUES (1, 'x'), (2, 'y'), (3, 'z')"}])
    second, third = line(2, [{"Bound": tree}]), line(3, [{"Sql": "DELETE FROM t WHERE id = 3"}])
    imports.replay(db, [first, second, second, "", third, "{broken", line(4, [{"Sql": "DELETE FROM t"}])])
    return db.execute("SELECT * FROM t").frame


def kv_reads(spark: SparkSession, folder: str) -> DataFrame:
    """GET, GET_MANY, LEN, IS_EMPTY and DELETE of a store."""
    kv = KVStore(spark, scratch(spark, "kv"))
    rows = [("empty", str(kv.is_empty()).lower())]
    kv.load(table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("kv_key"), F.col("c_name").alias("kv_value")))
    kv.set("é blank", "ü")
    rows += [("get", kv.get("7")), ("get other", kv.get("é blank")), ("get none", kv.get("none"))]
    rows += [(f"many {k}", v) for k, v in kv.get_many(["9", "none", "8", "9"])]
    rows += [("deleted", str(kv.delete("7")).lower()), ("deleted again", str(kv.delete("7")).lower()), ("len", str(len(kv))), ("empty now", str(kv.is_empty()).lower())]
    return _lines(spark, rows, "name string, value string")


def kv_cleared(spark: SparkSession, folder: str) -> DataFrame:
    """A store after CLEAR and writes around it, opened anew."""
    place = scratch(spark, "kv")
    kv = KVStore(spark, place)
    kv.load(table(spark, folder, "nation").select(F.col("n_name").alias("kv_key"), F.col("n_nationkey").cast("string").alias("kv_value")))
    kv.snapshot()
    kv.set("before", "1")
    kv.clear()
    kv.set_many({"a": "1", "b": "2"})
    kv.set_async("c", "3")
    kv.delete("a")
    kv.close()
    return KVStore(spark, place).state().select("kv_key", "kv_value")


def restored_point(spark: SparkSession, folder: str) -> DataFrame:
    """A table and a store brought back from a backup to an exact point."""
    root, copy, back = (scratch(spark, n) for n in ("live", "backup", "restored"))
    db, kv = Database(spark, f"{root}/sql"), KVStore(spark, f"{root}/kv")
    db.load("nation", table(spark, folder, "nation"), ["n_nationkey"])
    kv.set_many({"one": "1", "two": "2"})
    db.execute("DELETE FROM nation WHERE n_regionkey = 1")
    kv.set("two", "22")
    point = recovery.RecoveryPoint(db.store.latest().version, kv.current_sequence)
    db.execute("DELETE FROM nation")
    kv.clear()
    kv.close()
    recovery.backup(spark, root, copy)
    recovery.restore(spark, copy, back, recovery.RecoveryPoint.parse(str(point)))
    rows = Database(spark, f"{back}/sql").execute("SELECT n_nationkey AS k, n_name AS v FROM nation").frame
    pairs = KVStore(spark, f"{back}/kv").state().select(F.lit("kv").alias("part"), F.col("kv_key").alias("k"), F.col("kv_value").alias("v"))
    return rows.select(F.lit("sql").alias("part"), F.col("k").cast("string").alias("k"), "v").unionByName(pairs)


def parsed_points(spark: SparkSession, folder: str) -> DataFrame:
    """Times and points as text."""
    texts = ["1970-01-01T00:00:00Z", "2024-02-29T12:30:15.250+02:00", "2026-02-29T00:00:00Z", "2024-04-31T00:00:00Z", "2024-01-01 00:00:00Z", "sql:7,kv:3", "kv:3, sql:7", "sql:7"]
    out = []
    for text in texts:
        try:
            out.append((text, str(recovery.RecoveryPoint.parse(text) if ":" in text[:4] else recovery.parse_rfc3339(text))))
        except SqlError:
            out.append((text, "refused"))
    return _lines(spark, out, "written string, read string")


QUERIES = {
    f.__name__: f
    for f in (
        refused_statements, insert_values, insert_select, dropped_table, table_indexes, indexed_range, bloom_point, explained_scan, described_table, altered_defaults, kept_constraints,
        prepared_statements, statement_batch, upsert_conflicts, text_table, imported_json, replayed_log, kv_reads, kv_cleared, restored_point, parsed_points,
    )
}


def _values(columns: str, rows: Iterable[tuple]) -> str:
    """SQL for constant rows."""
    lit = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({columns})"


_REFUSED_WRITES = ("not null", "left out", "primary key", "null key", "unique", "check", "foreign key", "one of two", "update to null", "parent", "add over bad rows", "type")
_PASSED_WRITES = ("whole", "nulls", "nulls again", "drop", "foreign key dropped", "parent dropped")

ORACLE = {
    "refused_statements": _values("name, outcome", [(n, "accepted" if n.startswith("ok_") else "refused") for n in REFUSED]),
    "insert_values": "SELECT CAST(id AS BIGINT) AS id, label, CAST(price AS DOUBLE) AS price, ok FROM (VALUES (1, 'a', 1.5, FALSE), (2, NULL, 2.0, NULL), (3, 'none', -3.0, TRUE), (4, 'none', NULL, TRUE)) t(id, label, price, ok)",
    "insert_select": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation UNION ALL SELECT n_nationkey + CAST(100 AS BIGINT), n_name, NULL FROM nation WHERE n_regionkey = 1",
    "dropped_table": _values("name", [("nation",), ("region",)]),
    "table_indexes": _values("name, columns, is_unique", [("t_pk", "id", True), ("t_code_uk", "code", True), ("t_b_fk", "b", False), ("by_a", "a, code", False)]),
    "indexed_range": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 150000",
    "bloom_point": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (77, 999999999)",
    "explained_scan": _values("name, scan", [
        ("key", "IndexScan(table=t, index=t_pk, bloom=id)"), ("range", "IndexScan(table=t, index=by_a, clustered=a)"), ("neither", "SeqScan(table=t)"), ("either", "SeqScan(table=t)"), ("key range", "SeqScan(table=t)"),
    ]),
    "described_table": _values("name, type, nullable, primary_key, is_unique", [
        ("id", "INTEGER", "NO", "YES", "YES"), ("a", "INTEGER", "YES", "NO", "NO"), ("b", "TEXT", "YES", "NO", "NO"), ("c", "FLOAT", "NO", "NO", "NO"), ("d", "BOOLEAN", "NO", "NO", "NO"),
    ]),
    "altered_defaults": "SELECT CAST(id AS BIGINT) AS id, CAST(a AS BIGINT) AS a, b FROM (VALUES (1, NULL, 'x'), (2, 7, NULL)) t(id, a, b)",
    "kept_constraints": _values("name, outcome", [*((n, "refused") for n in _REFUSED_WRITES), *((n, "accepted") for n in _PASSED_WRITES)]),
    "prepared_statements": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE n_nationkey WHEN 3 THEN 'it''s' ELSE n_name END AS n_name FROM nation WHERE n_regionkey = 1 AND n_nationkey > 2",
    "statement_batch": "SELECT CAST(id AS BIGINT) AS id, a FROM (VALUES (1, 'a;b'), (2, 'c')) t(id, a)",
    "upsert_conflicts": """WITH o AS (SELECT o_custkey AS id, COUNT(*) AS m, MAX(o_orderkey) AS last FROM orders GROUP BY o_custkey),
t AS (SELECT 1 AS id, 100 AS n UNION ALL SELECT -1, 5 UNION ALL SELECT c_custkey, 1000 FROM customer WHERE c_custkey > 10)
SELECT CAST(COALESCE(t.id, o.id) AS BIGINT) AS id, CAST(CASE WHEN t.id IS NULL THEN o.m ELSE t.n + COALESCE(o.m, 0) END AS BIGINT) AS n,
  CAST(COALESCE(o.last, 0) AS BIGINT) AS last FROM t FULL JOIN o ON t.id = o.id""",
    "text_table": """WITH w AS (SELECT MAX(LENGTH(r_name)) AS n FROM (SELECT r_name FROM region WHERE r_regionkey < 2 UNION ALL SELECT 'r_name') x),
r AS (SELECT '+-------------+' || REPEAT('-', CAST(n AS BIGINT) + 2) || '+---------+-------+' AS rule, n FROM w)
SELECT 0 AS n, rule AS line FROM r UNION ALL SELECT 1, '| r_regionkey | ' || RPAD('r_name', CAST(n AS INTEGER), ' ') || ' | nothing | big   |' FROM r UNION ALL SELECT 2, rule FROM r
UNION ALL SELECT 3 + r_regionkey, '| ' || r_regionkey || '           | ' || RPAD(r_name, CAST(n AS INTEGER), ' ') || ' | NULL    | FALSE |' FROM region, r WHERE r_regionkey < 2
UNION ALL SELECT 5, rule FROM r UNION ALL SELECT 6, '2 row(s)'""",
    "imported_json": "SELECT CAST(id AS BIGINT) AS id, label, CAST(price AS DOUBLE) AS price FROM (VALUES (1, 'one', 1.5), (2, NULL, -2.0)) t(id, label, price)",
    "replayed_log": "SELECT CAST(id AS BIGINT) AS id, a FROM (VALUES (1, 'x'), (2, 'two')) t(id, a)",
    "kv_reads": """WITH c AS (SELECT c_custkey AS k, c_name AS v FROM customer)
SELECT 'empty' AS name, 'true' AS value UNION ALL SELECT 'get', v FROM c WHERE k = 7 UNION ALL SELECT 'get other', 'ü' UNION ALL SELECT 'get none', NULL
UNION ALL SELECT 'many 9', v FROM c WHERE k = 9 UNION ALL SELECT 'many 8', v FROM c WHERE k = 8 UNION ALL SELECT 'many 9', v FROM c WHERE k = 9
UNION ALL SELECT 'deleted', 'true' UNION ALL SELECT 'deleted again', 'false' UNION ALL SELECT 'len', CAST(COUNT(*) AS VARCHAR) FROM c UNION ALL SELECT 'empty now', 'false'""",
    "kv_cleared": _values("kv_key, kv_value", [("b", "2"), ("c", "3")]),
    "restored_point": "SELECT 'sql' AS part, CAST(n_nationkey AS VARCHAR) AS k, n_name AS v FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'kv', 'one', '1' UNION ALL SELECT 'kv', 'two', '22'",
    "parsed_points": _values("written, read", [
        ("1970-01-01T00:00:00Z", "0"), ("2024-02-29T12:30:15.250+02:00", "1709202615250"), ("2026-02-29T00:00:00Z", "refused"), ("2024-04-31T00:00:00Z", "refused"),
        ("2024-01-01 00:00:00Z", "refused"), ("sql:7,kv:3", "sql:7,kv:3"), ("kv:3, sql:7", "sql:7,kv:3"), ("sql:7", "refused"),
    ]),
}
