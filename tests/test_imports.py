from __future__ import annotations

import json

import brute
import pytest

from tidemark.engine import imports
from tidemark.engine.errors import SqlError
from tidemark.engine.kv import KVStore
from tidemark.engine.session import Database
from tidemark.functions import walrecord
from tidemark.sources import table
from tidemark.streaming.fold import FoldedTable


def line(base, statements):
    body = json.dumps(statements, ensure_ascii=False, separators=(",", ":"))
    crc = walrecord.checksum([base, base + 1, 5], body)
    return f'{{"format_version":2,"base_version":{base},"commit_version":{base + 1},"timestamp_millis":5,"statements":{body},"checksum":{crc}}}'


def test_replay(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    one = lambda op, n: {"Binary": {"left": {"Column": {"qualifier": None, "name": "id"}}, "op": {"Compare": op}, "right": {"Literal": {"Integer": n}}}}
    insert = {"Insert": {"table_name": "t", "columns": ["id", "v"], "source": {"Values": [[{"Literal": {"Integer": 2}}, {"Literal": {"Text": "b"}}]]}, "on_duplicate": [["v", {"Incoming": "v"}]]}}
    lines = [
        line(0, [{"Sql": "CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT)"}, {"Sql": "INSERT INTO t VALUES (1, 'a;é')"}]), "",
        line(0, [{"Sql": "INSERT INTO t VALUES (9, 'again')"}]),
        line(1, [{"Bound": insert}, {"Bound": {"Update": {"table_name": "t", "assignments": [["v", {"Literal": {"Text": "z"}}]], "selection": one("Equal", 1)}}}]),
        line(2, [{"Bound": {"Delete": {"table_name": "t", "selection": one("GreaterThan", 1)}}}]),
        line(3, [{"Sql": "INSERT INTO t VALUES (3, 'c')"}])[:-1] + " ",
        line(3, [{"Sql": "INSERT INTO t VALUES (4, 'd')"}]),
    ]
    assert imports.replay(db, lines[:4]) == 2
    assert db.execute("SELECT * FROM t ORDER BY id").rows() == [(1, "z"), (2, "b")]
    assert imports.replay(db, lines, after=2) == 3
    assert db.execute("SELECT * FROM t").rows() == [(1, "z")]
    with pytest.raises(SqlError, match="continues"):
        imports.replay(db, [line(7, [])], after=3)


def test_tables_from_json(spark, tmp_path):
    column = {"nullable": True, "primary_key": False, "unique": False, "default": None}
    value = {
        "schema": {"name": "Old", "columns": [column | {"name": "id", "data_type": "Integer", "primary_key": True}, column | {"name": "f", "data_type": "Float", "default": {"Float": 1.5}}]},
        "rows": [{"values": [{"Integer": 1}, {"Float": 2.0}]}, {"values": [{"Integer": 2}, "Null"]}],
    }
    folder = tmp_path / "tables"
    folder.mkdir()
    (folder / "old.json").write_text(json.dumps(value))
    db = Database(spark, str(tmp_path / "db"))
    assert imports.tables_from_folder(db, str(folder)) == ["old"]
    db.execute("INSERT INTO old (id) VALUES (3)")
    assert db.execute("SELECT * FROM old ORDER BY id").rows() == [(1, 2.0), (2, None), (3, 1.5)]
    with pytest.raises(SqlError):
        db.execute("INSERT INTO old (id) VALUES (3)")


def test_kv_log_lines(spark, small, tmp_path):
    lines = table(spark, small, "wal_lines").where("engine = 'kv' AND node_id = 'n00001'")
    kv = KVStore(spark, str(tmp_path / "kv"))
    imports.load_kv_log(kv, lines)
    best, clear = {}, 0
    for r in lines.collect():
        if r.raw_line and r.raw_line.strip(" \t\r\n") and brute.reason(r.raw_line, "kv") is None:
            v = json.loads(r.raw_line)
            op = v["operation"]
            if op == "Clear":
                clear = max(clear, v["sequence"])
            else:
                key = next(iter(op.values()))["key"]
                best[key] = max(best.get(key, (0,)), (v["sequence"], op.get("Set", {}).get("value")), key=lambda x: x[0])
    want = {k: v for k, (s, v) in best.items() if s > clear and v is not None}
    assert {r.kv_key: r.kv_value for r in kv.state().collect()} == want and want


def test_streamed_fold(spark, tmp_path):
    schema = "k string, seq long, op string, v string"
    batches = [
        [("a", 1, "Set", "1"), ("b", 4, "Delete", None)],
        [("b", 3, "Set", "late"), ("a", 2, "Set", "2"), ("a", 2, "Set", "2"), ("c", 1, "Set", "c")],
        [("c", 2, "Delete", None), ("a", 1, "Set", "1")],
    ]
    source = str(tmp_path / "in")
    folded = FoldedTable(spark, str(tmp_path / "state"), ["k"], ["seq"], "op", ["v"], 4)
    assert folded.state() is None
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        query = folded.start(spark.readStream.schema(schema).parquet(source), str(tmp_path / "checkpoint"), availableNow=True)
        query.awaitTermination()
    assert [tuple(r) for r in folded.state().select("k", "seq", "v").collect()] == [("a", 2, "2")]
    assert folded.state(tombstones=True).count() == 3
    assert not folded.apply(spark.createDataFrame([("z", 1, "Set", "z")], schema), 2)  # committed before
    assert folded.apply(spark.createDataFrame([], schema), 9) and folded.state().count() == 1
