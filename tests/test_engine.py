from __future__ import annotations

import base64
import json
import os
import socket
import struct
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from tidemark.engine import cli, http, recovery, wire
from tidemark.engine.errors import AnalysisError, ConflictError, ConstraintError, SqlError, Unsupported
from tidemark.engine.kv import KVStore
from tidemark.engine.session import Database


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, str(tmp_path / "db"))


def run(db, *statements):
    for s in statements:
        out = db.execute(s)
    return out


def test_constraints(db):
    run(
        db,
        "CREATE TABLE parents (code TEXT UNIQUE, enabled BOOLEAN)",
        "CREATE TABLE children (id INT PRIMARY KEY, parent_code TEXT, quantity INT NOT NULL CHECK (quantity > 0), FOREIGN KEY (parent_code) REFERENCES parents(code))",
        "INSERT INTO parents VALUES ('p', TRUE), (NULL, FALSE), (NULL, FALSE)",
        "INSERT INTO children VALUES (1, 'p', 1), (2, NULL, 1)",
    )
    for bad in (
        "INSERT INTO children VALUES (3, 'p', 0)", "INSERT INTO children VALUES (3, 'q', 1)", "INSERT INTO children VALUES (1, 'p', 1)", "INSERT INTO children VALUES (4, 'p', 1), (4, 'p', 1)",
        "INSERT INTO children VALUES (3, 'p', NULL)", "DELETE FROM parents WHERE code = 'p'", "UPDATE parents SET code = 'z' WHERE code = 'p'", "INSERT INTO parents VALUES ('p', TRUE)",
        "UPDATE children SET quantity = quantity - 1", "UPDATE children SET id = 1", "INSERT INTO children SELECT id + 10, 'nope', 1 FROM children", "DROP TABLE parents",
    ):
        with pytest.raises(ConstraintError):
            db.execute(bad)
    for bad in ("INSERT INTO children VALUES (1)", "INSERT INTO children (id, id) VALUES (1, 2)", "INSERT INTO children (nope) VALUES (1)", "INSERT INTO children VALUES ('x', 'p', 1)", "UPDATE children SET nope = 1", "UPDATE children SET id = 'x'"):
        with pytest.raises(AnalysisError):
            db.execute(bad)
    assert db.execute("SELECT COUNT(*), SUM(quantity) FROM children").rows() == [(2, 2)]
    assert db.execute("DELETE FROM children").count == 2
    assert db.execute("DELETE FROM parents WHERE code = 'p'").count == 1


def test_insert_select_upsert_and_alter(db):
    run(db, "CREATE TABLE source (id INT PRIMARY KEY, name TEXT)", "CREATE TABLE target (id INT PRIMARY KEY, name TEXT)", "INSERT INTO source VALUES (1, 'one'), (2, 'two')")
    assert db.execute("INSERT INTO target SELECT id, name FROM source").count == 2
    assert db.execute("INSERT INTO target VALUES (2, 'deux') ON DUPLICATE KEY UPDATE name = VALUES(name)").count == 2
    assert db.execute("INSERT INTO target VALUES (2, 'deux') ON DUPLICATE KEY UPDATE name = VALUES(name)").count == 0
    run(db, "ALTER TABLE target ADD COLUMN active BOOLEAN NOT NULL DEFAULT TRUE", "ALTER TABLE target RENAME COLUMN name TO label")
    with pytest.raises(ConstraintError):
        db.execute("ALTER TABLE target MODIFY COLUMN label INT")
    assert db.execute("SELECT label, active FROM target WHERE id = 2").rows() == [("deux", True)]
    assert db.execute("INSERT INTO source SELECT id + 10, name FROM source").count == 2
    with pytest.raises(SqlError):  # all or nothing
        db.execute("ALTER TABLE target DROP COLUMN active, DROP COLUMN nope")
    assert [r[0] for r in db.execute("DESCRIBE target").rows()] == ["id", "label", "active"]
    run(db, "ALTER TABLE target ALTER COLUMN active DROP NOT NULL", "ALTER TABLE target CHANGE id key_id FLOAT", "INSERT INTO target (key_id, active) VALUES (3, NULL)")
    assert db.execute("SELECT key_id, label, active FROM target ORDER BY key_id").rows() == [(1.0, "one", True), (2.0, "deux", True), (3.0, None, None)]


def test_upsert_conflicts_inside_the_batch(db):
    run(db, "CREATE TABLE u (id INT PRIMARY KEY, email TEXT UNIQUE, hits INT)", "INSERT INTO u VALUES (1, 'a', 0)")
    assert db.execute("INSERT INTO u VALUES (2, 'b', 1), (2, 'c', 9), (3, 'c', 1) ON DUPLICATE KEY UPDATE hits = hits + 1").count == 4
    assert db.execute("INSERT INTO u VALUES (1, 'z', 9), (9, 'z', 9) ON DUPLICATE KEY UPDATE email = VALUES(email), hits = hits + 1").count == 4
    assert db.execute("SELECT * FROM u ORDER BY id").rows() == [(1, "z", 2), (2, "b", 2), (3, "c", 1)]
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO u VALUES (1, 'b', 1) ON DUPLICATE KEY UPDATE hits = 5")
    run(db, "CREATE TABLE w (id INT PRIMARY KEY, v INT, n INT)", "INSERT INTO w VALUES (1, 10, 0)")
    assert db.execute("INSERT INTO w SELECT id, hits, 0 FROM u ON DUPLICATE KEY UPDATE v = v + VALUES(v), n = v").count == 4
    assert db.execute("SELECT * FROM w ORDER BY id").rows() == [(1, 12, 12), (2, 2, 0), (3, 1, 0)]


def test_alter_constraints_and_indexes(db):
    run(
        db,
        "CREATE TABLE parent (id INT PRIMARY KEY)",
        "CREATE TABLE child (id INT PRIMARY KEY, parent_id INT, label TEXT)",
        "INSERT INTO parent VALUES (1)",
        "INSERT INTO child VALUES (1, 1, 'a')",
        "ALTER TABLE child ADD CONSTRAINT child_fk FOREIGN KEY (parent_id) REFERENCES parent(id), ADD CONSTRAINT lbl UNIQUE (label), ADD CHECK (label != 'x')",
    )
    for bad in ("INSERT INTO child VALUES (2, 9, 'b')", "INSERT INTO child VALUES (2, 1, 'a')", "INSERT INTO child VALUES (2, 1, 'x')", "ALTER TABLE child DROP COLUMN label", "ALTER TABLE parent DROP COLUMN id"):
        with pytest.raises(SqlError):
            db.execute(bad)
    run(db, "ALTER TABLE child RENAME COLUMN label TO tag", "ALTER TABLE child DROP FOREIGN KEY child_fk")
    assert db.execute("INSERT INTO child VALUES (2, 9, 'b')").count == 1
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO child VALUES (3, 1, 'x')")
    run(db, "CREATE INDEX by_tag ON child (tag, id)", "CREATE INDEX IF NOT EXISTS by_tag ON child (tag)")
    assert db.execute("SHOW INDEXES FROM child").lines == ["child_pk (id) UNIQUE", "lbl (tag) UNIQUE", "by_tag (tag, id)"]
    with pytest.raises(SqlError):
        db.execute("DROP INDEX child_pk ON child")
    with pytest.raises(ConstraintError):
        run(db, "INSERT INTO child VALUES (5, 9, 'c')", "CREATE UNIQUE INDEX one ON child (parent_id)")
    run(db, "DROP INDEX by_tag ON child", "ALTER TABLE child DROP CHECK child_check", "INSERT INTO child VALUES (6, 1, 'x')", "ALTER TABLE child DROP PRIMARY KEY")
    with pytest.raises(Unsupported):
        db.execute("ALTER TABLE child ADD CHECK (id > (SELECT 1))")
    assert "IndexScan(table=child, index=lbl" in "\n".join(db.execute("EXPLAIN SELECT * FROM child WHERE tag = 'a'").lines)


def test_transactions(db, spark):
    run(db, "CREATE TABLE t (id INT PRIMARY KEY, v TEXT)", "INSERT INTO t VALUES (1, 'a')")
    a, b, c = db.session(), db.session(), db.session()
    for s in (a, b, c):
        s.execute("BEGIN")
    with pytest.raises(SqlError):
        a.execute("BEGIN")
    a.execute("UPDATE t SET v = 'mine'")
    assert a.execute("SELECT v FROM t").rows() == [("mine",)] and b.execute("SELECT v FROM t").rows() == [("a",)]
    a.execute("CREATE TABLE extra (x INT)")
    assert db.tables() == ["t"]
    b.execute("INSERT INTO t VALUES (2, 'b')")
    a.execute("COMMIT")
    with pytest.raises(ConflictError):
        b.execute("COMMIT")
    c.execute("COMMIT")  # it only read
    assert db.execute("SELECT * FROM t").rows() == [(1, "mine")] and db.tables() == ["extra", "t"]
    a.execute("START TRANSACTION")
    a.execute("DELETE FROM t")
    a.execute("ROLLBACK")
    a.execute("ROLLBACK")
    a.execute("COMMIT")
    again = Database(spark, db.root)
    assert again.execute("SELECT * FROM t").rows() == [(1, "mine")]
    with pytest.raises(SqlError):
        db.execute("BEGIN")


def test_failed_statement_leaves_a_transaction_usable(db):
    run(db, "CREATE TABLE t (id INT PRIMARY KEY)")
    s = db.session()
    s.execute("BEGIN")
    s.execute("INSERT INTO t VALUES (1)")
    with pytest.raises(ConstraintError):
        s.execute("INSERT INTO t VALUES (2), (1)")
    s.execute("INSERT INTO t VALUES (3)")
    s.execute("COMMIT")
    assert db.execute("SELECT id FROM t ORDER BY id").rows() == [(1,), (3,)]


def test_prepared_statements_and_variables(db):
    run(db, "CREATE TABLE t (id INT PRIMARY KEY, v TEXT)")
    s = db.session()
    s.execute("PREPARE ins FROM 'INSERT INTO t VALUES (?, ?)'")
    s.execute("SET @id = 1")
    s.execute("SET @v = 'safe '' value'")
    assert s.execute("EXECUTE ins USING @id, @v").count == 1
    assert s.execute_prepared("ins", [2, None]).count == 1
    s.execute("SET @q = 'SELECT v FROM t WHERE id = ?'")
    s.execute("PREPARE sel FROM @q")
    assert s.execute("EXECUTE sel USING @id").rows() == [("safe ' value",)]
    for bad in ("EXECUTE ins USING @id", "EXECUTE nope", "EXECUTE sel USING @missing", "PREPARE x FROM 'BEGIN'", "PREPARE x FROM @id"):
        with pytest.raises(SqlError):
            s.execute(bad)
    s.execute("DEALLOCATE PREPARE sel")
    with pytest.raises(SqlError):
        s.execute("EXECUTE sel USING @id")


def test_crash_before_the_manifest_changes_nothing(db, spark, monkeypatch):
    run(db, "CREATE TABLE t (id INT PRIMARY KEY)", "INSERT INTO t VALUES (1)")
    monkeypatch.setattr(db.store.folder, "create", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        db.execute("INSERT INTO t VALUES (2)")
    again = Database(spark, db.root)
    assert again.execute("SELECT id FROM t").rows() == [(1,)]
    newest = max(os.listdir(os.path.join(db.root, "manifests")))
    with open(os.path.join(db.root, "manifests", newest), "a") as f:
        f.write("x")  # a damaged manifest is passed over
    assert again.tables() == ["t"] and again.execute("SELECT COUNT(*) FROM t").rows() == [(0,)]


def test_key_value_store(spark, tmp_path):
    kv = KVStore(spark, str(tmp_path / "kv"))
    assert kv.is_empty() and kv.get("a") is None
    kv.set("a", "1")
    kv.set_many({"b": "2", "c": "é"})
    kv.set_async("d", "4")
    kv.set("d", "5")  # after the buffered one
    assert kv.get_many(["d", "zz", "a"]) == [("d", "5"), ("a", "1")]
    assert kv.delete("a") and not kv.delete("a")
    assert len(kv) == 3 and kv.wal_size() == 6 and kv.current_sequence == 6
    assert kv.snapshot() == 6 and kv.wal_size() == 0
    again = KVStore(spark, str(tmp_path / "kv"))
    assert again.current_sequence == 6 and again.get("c") == "é"
    again.clear()
    again.load(spark.createDataFrame([("k", "1"), ("k", "2"), (None, "x"), ("n", None)], "kv_key string, kv_value string"))
    assert [tuple(r)[::3] for r in again.state().select("kv_key", "sequence", "operation", "kv_value").collect()] == [("k", "2")]


def test_backup_restore_and_prune(spark, tmp_path):
    root = str(tmp_path / "data")
    db, kv = Database(spark, f"{root}/sql"), KVStore(spark, f"{root}/kv")
    run(db, "CREATE TABLE items (id INT PRIMARY KEY)", "INSERT INTO items VALUES (1)", "INSERT INTO items VALUES (2)")
    kv.set_many({"one": "1", "two": "2", "three": "3"})
    point = recovery.RecoveryPoint(3, 2)
    run(db, "DELETE FROM items")
    kv.set("two", "x")
    assert recovery.backup(spark, root, str(tmp_path / "backup")) == recovery.RecoveryPoint(4, 4)
    with pytest.raises(SqlError):
        recovery.backup(spark, root, str(tmp_path / "backup"))
    assert recovery.restore(spark, str(tmp_path / "backup"), str(tmp_path / "r1"), point) == point
    assert Database(spark, str(tmp_path / "r1/sql")).execute("SELECT COUNT(*) FROM items").rows() == [(2,)]
    assert KVStore(spark, str(tmp_path / "r1/kv")).get_many(["two", "three"]) == [("two", "2")]
    recovery.restore(spark, str(tmp_path / "backup"), str(tmp_path / "r2"))
    assert Database(spark, str(tmp_path / "r2/sql")).execute("SELECT COUNT(*) FROM items").rows() == [(0,)]
    early = recovery.restore(spark, str(tmp_path / "backup"), str(tmp_path / "r3"), 1000)
    assert early == recovery.RecoveryPoint(0, 0)
    with pytest.raises(SqlError):
        recovery.restore(spark, str(tmp_path / "backup"), str(tmp_path / "r4"), recovery.RecoveryPoint(9, 0))
    lock = recovery.hold(recovery.Folder(spark, root))
    with pytest.raises(SqlError):
        recovery.prune(spark, root, 10**15)
    lock.close()
    kv.snapshot()
    gone = recovery.prune(spark, root, 10**15)
    assert gone and recovery.prune(spark, root, 10**15, apply=True) == gone
    assert db.execute("SELECT COUNT(*) FROM items").rows() == [(0,)] and KVStore(spark, f"{root}/kv").get("two") == "x"
    victim = next(f for f in recovery.Folder(spark, str(tmp_path / "backup")).walk() if f.endswith(".parquet"))
    with open(tmp_path / "backup" / victim, "ab") as f:
        f.write(b"x")
    with pytest.raises(SqlError, match="damaged"):
        recovery.restore(spark, str(tmp_path / "backup"), str(tmp_path / "r5"))


def test_times_and_points():
    p = recovery.parse_rfc3339
    assert p("1970-01-01T00:00:01.25Z") == 1250 and p("1970-01-01T01:00:00+01:00") == 0 and p("2024-02-29t00:00:00z") == 1709164800000
    for bad in ("2026-02-29T00:00:00Z", "2026-04-31T00:00:00Z", "2026-01-01T00:00:00.Z", "2026-01-01 00:00:00Z", "2026-01-01T00:00:00", "2026-01-01T24:00:00Z", "2026-01-01T00:00:00+24:00"):
        with pytest.raises(SqlError):
            p(bad)
    assert recovery.RecoveryPoint.parse("kv:3, sql:7") == recovery.RecoveryPoint(7, 3)
    for bad in ("sql:1", "sql:1,kv:x", "sql:1,kv:2,x:3", ""):
        with pytest.raises(SqlError):
            recovery.RecoveryPoint.parse(bad)


def test_upsert_in_order_of_the_batch(db):
    run(db, "CREATE TABLE t (id INT UNIQUE, n INT CHECK (n < 100), label TEXT)", "INSERT INTO t VALUES (1, 1, 'a'), (2, 2, 'b'), (NULL, 0, 'none')")
    run(db, "CREATE TABLE b (id INT, n INT, label TEXT)", "INSERT INTO b VALUES (1, 5, 'x'), (3, 1, 'y'), (1, 5, 'x'), (3, 1, 'z'), (NULL, 7, 'p'), (NULL, 8, 'q')")
    upsert = "INSERT INTO t SELECT id, n, label FROM b ON DUPLICATE KEY UPDATE n = n + VALUES(n), label = VALUES(label)"
    assert db.execute(upsert).count == 2 + 2 + 1 + 2 + 2
    want = [(None, 0, "none"), (None, 7, "p"), (None, 8, "q"), (1, 11, "x"), (2, 2, "b"), (3, 2, "z")]
    assert db.execute("SELECT * FROM t ORDER BY id, n").rows() == want
    for broken in ("n = 60 + n", "n = 1 / (n - n)"):
        with pytest.raises(SqlError):
            db.execute(upsert.replace("n = n + VALUES(n)", broken))
    assert db.execute("SELECT * FROM t ORDER BY id, n").rows() == want


def test_records_of_the_key_value_log_carry_their_checksum(spark, tmp_path):
    kv = KVStore(spark, str(tmp_path / "kv"))
    odd = {"a": "plain", 'q"uote': "back\\slash", "ctl\n\t\r\b\f": "\x01\x1f\x7f", "é ü": "日本 🙂 </x> & /"}
    kv.set_many(odd)
    kv.load(spark.createDataFrame([*odd.items(), ("n", None)], "kv_key string, kv_value string"))
    kv.delete("a")
    kv.clear()
    assert kv.damaged().count() == 0 and kv.log().count() == 10
    seg = kv.segments()[0]
    bad = spark.read.parquet(kv.files.uri(seg[2])).withColumn("kv_value", F.concat("kv_value", F.lit("!"))).collect()
    kv.files.delete(seg[2])
    spark.createDataFrame(bad, kv.log().schema).write.parquet(kv.files.uri(seg[2]))
    assert kv.damaged().count() == 4
    with pytest.raises(SqlError, match="4 records"):
        kv.check()


def test_http(db, spark, tmp_path):
    run(db, "CREATE TABLE t (id INT, f FLOAT)", "INSERT INTO t VALUES (1, 2.5)")
    server = http.server(db, KVStore(spark, str(tmp_path / "kv")), "u", "p")
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def call(method, path, body=None, auth="u:p"):
        req = urllib.request.Request(base + path, None if body is None else json.dumps(body).encode(), method=method)
        req.add_header("Authorization", "Basic " + base64.b64encode(auth.encode()).decode())
        try:
            with urllib.request.urlopen(req) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        data = lambda *args: (lambda status, body: (status, body["data"]) if body["success"] else (status, body["error"]))(*call(*args))
        assert call("GET", "/health", auth="x:y") == (200, {"success": True, "data": {"status": "healthy", "version": http.VERSION}})
        assert call("GET", "/kv/a", auth="x:y") == (401, {"success": False, "error": "Unauthorized"})
        assert data("PUT", "/kv/a%20b", {"value": "1"})[0] == 200 and data("GET", "/kv/a%20b") == (200, {"key": "a b", "value": "1", "exists": True})
        assert data("GET", "/kv/zz") == (404, {"key": "zz", "value": None, "exists": False}) and data("PUT", "/kv/a", {"value": 1})[0] == 400
        assert data("POST", "/kv/mset", {"pairs": [{"key": "x", "value": "0"}, {"key": "x", "value": "1"}]}) == (200, {"requested": 2, "set": 1})
        assert data("POST", "/kv/mget", {"keys": ["q", "x"]})[1] == [{"key": "q", "value": None, "exists": False}, {"key": "x", "value": "1", "exists": True}]
        info = data("GET", "/kv/info")[1]
        assert info["keys_count"] == 2 and not info["is_empty"] and info["wal_size_bytes"] > 0
        assert data("DELETE", "/kv/x") == (200, {"key": "x", "deleted": True}) and data("DELETE", "/kv/x")[0] == 404 and data("POST", "/kv/clear")[1] == {"cleared": True}
        status, body = data("POST", "/sql/execute", {"query": "SELECT * FROM t"})
        assert status == 200 and body["rows"] == [[1, 2.5]] and body["columns"] == ["id", "f"] and body["message"] == "1 row(s) returned"
        assert data("POST", "/sql/execute", {"query": "SELECT * FROM t WHERE id > 5"})[1]["rows"] == []
        assert data("POST", "/sql/execute", {"query": "SELECT id / 0 FROM t"})[0] in (400, 500)
        assert data("POST", "/sql/execute", {"query": "BEGIN"})[0] == 400 and data("POST", "/sql/execute", {})[0] == 400
        assert data("GET", "/sql/tables")[1] == {"tables": ["t"], "count": 1}
        with urllib.request.urlopen(urllib.request.Request(base + "/kv/a", method="OPTIONS")) as r:
            assert r.status == 200 and r.headers["Access-Control-Allow-Origin"] == r.headers["Access-Control-Allow-Methods"] == "*"
    finally:
        server.shutdown()


class Client:
    """Just enough of a client to speak with the server."""

    def __init__(self, port, user="u", password="p"):
        self.s = socket.create_connection(("127.0.0.1", port), 30)
        hello = self.packet()
        at = hello.index(0, 1) + 5
        salt = hello[at : at + 8] + hello[at + 27 : at + 39]
        answer = wire.scramble(password, salt)
        self.put(struct.pack("<IIB", 0x8200, 1 << 24, 33) + bytes(23) + user.encode() + b"\0" + bytes([len(answer)]) + answer, 1)
        self.login = self.packet()

    def packet(self):
        head = self.exactly(4)
        return self.exactly(int.from_bytes(head[:3], "little"))

    def exactly(self, n):
        out = b""
        while len(out) < n:
            part = self.s.recv(n - len(out))
            if not part:
                raise ConnectionError
            out += part
        return out

    def put(self, body, seq=0):
        self.s.sendall(len(body).to_bytes(3, "little") + bytes([seq]) + body)

    def result(self):
        first = self.packet()
        if first[0] in (0, 0xFF):
            return first
        for _ in range(first[0]):
            self.packet()
        self.packet()
        rows = []
        while True:
            p = self.packet()
            if p[0] == 0xFE and len(p) < 9:
                return rows
            rows.append(p)

    def query(self, sql):
        self.put(b"\x03" + sql.encode())
        r = self.result()
        if isinstance(r, bytes):
            return r
        out = []
        for p in r:
            row, at = [], 0
            while at < len(p):
                if p[at] == 0xFB:
                    row.append(None)
                    at += 1
                else:
                    n, at = wire.read_number(p, at)
                    row.append(p[at : at + n].decode())
                    at += n
            out.append(tuple(row))
        return out


def test_wire(db):
    run(db, "CREATE TABLE t (id INT PRIMARY KEY, name TEXT, f FLOAT, active BOOLEAN)")
    server = wire.serve_background(db, "u", "p")
    port = server.server_address[1]
    try:
        assert Client(port, password="wrong").login[0] == 0xFF
        c = Client(port)
        assert c.login[0] == 0
        assert c.query("SET NAMES utf8")[0] == 0 and c.query("SELECT @@max_allowed_packet") == [("16777215",)]
        assert c.query("INSERT INTO t VALUES (1, 'Alice', 1.5, TRUE), (2, NULL, NULL, FALSE)")[1] == 2
        assert c.query("SELECT * FROM t ORDER BY id") == [("1", "Alice", "1.5", "1"), ("2", None, None, "0")]
        assert b"23000" in c.query("INSERT INTO t VALUES (1, 'x', 1, TRUE)") and b"42000" in c.query("SELEC")
        assert c.query("SHOW INDEXES FROM t") == [("t_pk", "id", "1")] and c.query("SHOW WARNINGS") == []
        c.put(b"\x16SELECT id, name, f, active FROM t WHERE id = ? OR name = ?")
        ok = c.packet()
        statement = struct.unpack_from("<I", ok, 1)[0]
        assert ok[0] == 0 and struct.unpack_from("<H", ok, 7)[0] == 2
        for _ in range(3):
            c.packet()
        c.put(b"\x17" + struct.pack("<IBI", statement, 0, 1) + b"\x00\x01" + bytes([8, 0, 0xFD, 0]) + struct.pack("<q", 1) + b"\x03abc")
        (row,) = c.result()
        assert row == b"\x00\x00" + struct.pack("<q", 1) + b"\x05Alice" + struct.pack("<d", 1.5) + b"\x01"
        c.put(b"\x17" + struct.pack("<IBI", statement, 0, 1) + b"\x02\x01")
        assert c.packet()[0] == 0xFF  # a packet that ends early
        c.put(b"\x0e")
        assert c.packet()[0] == 0
        c.query("BEGIN")
        c.query("DELETE FROM t")
        c.s.close()  # an open transaction ends with its connection
        assert Client(port).query("SELECT COUNT(*) FROM t") == [("2",)]
    finally:
        server.shutdown()


def test_shells(db, spark, tmp_path):
    said = []
    cli.sql_shell(db.session(), ["CREATE TABLE t (id INT,\n", "v TEXT);\n", "INSERT INTO t VALUES (1, NULL);", "SELECT *\n", "FROM t;", "SELECT nope;", "SHOW TABLES;", "exit", "SELECT 1;"], said.append)
    assert said[:2] == ["Table 't' created", "1 row(s) affected"] and said[3].startswith("Error") and said[4:] == ["t"]
    assert said[2] == "+----+------+\n| id | v    |\n+----+------+\n| 1  | NULL |\n+----+------+\n1 row(s)"
    said.clear()
    cli.kv_shell(KVStore(spark, str(tmp_path / "kv")), ["SET a b c", "GET a", "GET z", "LEN", "DEL a", "nope", "quit"], said.append)
    assert said == ["OK", "b c", "(nil)", "1", "OK", "unknown command nope"]
    assert [r.kind for r in db.execute_batch("SHOW TABLES; SELECT ';'")] == ["tables", "select"]
