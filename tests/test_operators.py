from __future__ import annotations

import datetime as dt
import json

import brute
import pytest
from pyspark.sql import functions as F

from tidemark.functions import intervals as iv
from tidemark.functions import logsql, walrecord
from tidemark.operators import badrows, dedup, fold, incremental, references
from tidemark.plans import general
from tidemark.sources import table
from tidemark.streaming.incremental import LogProcessor

KV = "node_id string, sequence long, operation string, kv_key string, kv_value string"
SQL = "node_id string, commit_version long, statements string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- change fold


def test_fold_is_commutative_and_keeps_tombstones(spark):
    schema = "k string, seq long, op string, v string"
    first = spark.createDataFrame([("a", 1, "Set", "x"), ("b", 5, "Delete", None), ("a", 1, "Set", "x")], schema)
    late = spark.createDataFrame([("b", 3, "Set", "old"), ("a", 2, "Set", "y"), ("c", None, "Set", "z")], schema)
    args = (["k"], ["seq"], "op", ["v"])
    one = fold.fold_changes(late, *args, base=fold.fold_changes(first, *args))
    two = fold.fold_changes(first, *args, base=fold.fold_changes(late, *args))
    assert rows(one) == rows(two) == rows(fold.fold_changes(first.union(late), *args))
    assert rows(one.where("op != 'Delete'")) == [("a", 2, "Set", "y")]
    assert rows(fold.fold_changes(first.limit(0), *args)) == []


def test_kv_state_clear_nulls_and_extra_columns(spark):
    log = spark.createDataFrame(
        [
            ("n", 1, "Set", "a", "1"), ("n", 2, "Clear", None, None), ("n", 3, "Set", "A", ""), ("n", 4, "Set", "b ", "x" * 100_000),
            ("n", 5, "Delete", "zz", None), ("m", 1, "Set", "a", "1"), (None, 9, "Set", "q", "1"), ("n", 6, "Set", None, "1"), ("n", 6, None, "a", "1"),
        ],
        KV,
    ).withColumn("__salt", F.lit(1)).withColumn("version", F.lit("clash"))
    got = rows(fold.kv_state(log, payload=()))
    assert got == [("m", "a", 1), ("n", "A", 3), ("n", "b ", 4)]
    assert fold.kv_state(log.limit(0)).count() == 0


def test_sql_state_against_sequential_replay(spark, small):
    log = table(spark, small, "sql_wal")
    want = brute.sql_state([tuple(r) for r in log.select("node_id", "commit_version", "statements").collect()])
    got = {(r.node_id, r.tbl, r.row_id): r.version for r in fold.sql_state(log).collect()}
    assert got == want


def test_sql_state_ranges_and_order(spark):
    s = lambda *texts: json.dumps([{"Sql": t} for t in texts])
    log = spark.createDataFrame(
        [
            ("n", 3, s("DELETE FROM t WHERE id >= 5")),
            ("n", 1, s("INSERT INTO t VALUES (1), (5), (6), (1000000)")),
            ("n", 4, s("INSERT INTO t VALUES (6)")),
            ("n", 5, s("UPDATE t SET x = 1 WHERE id > 2 AND id < 100 OR NOT id <> 1")),
            ("n", 2, s("UPDATE t SET x = 1")),
            ("n", 6, s("DELETE FROM t", "INSERT INTO t VALUES (-7)")),
            ("n", 5, s("UPDATE t SET x = 1 WHERE id > 2 AND id < 100 OR NOT id <> 1")),
            ("m", 1, s("INSERT INTO t VALUES (1)")), ("m", 2, s("UPDATE t SET x = 2 WHERE id = 99")), ("m", 3, None), ("m", 4, "[]"),
        ],
        SQL,
    )
    assert rows(fold.sql_state(log.where("commit_version < 6"))) == [("m", "t", 1, 1), ("n", "t", 1, 5), ("n", "t", 6, 5)]
    assert rows(fold.sql_state(log)) == [("m", "t", 1, 1), ("n", "t", -7, 6)]
    assert fold.sql_state(log.limit(0)).count() == 0
    with pytest.raises(Exception, match="commit 9"):
        fold.sql_state(spark.createDataFrame([("n", 9, s("MERGE INTO t"))], SQL)).count()


@pytest.mark.parametrize("cut_at", [1, 2, 3, 4, 5])
def test_any_split_of_a_statement_log(spark, cut_at):
    s = lambda *texts: json.dumps([{"Sql": t} for t in texts])
    log = spark.createDataFrame(
        [
            ("n", 1, s("INSERT INTO t VALUES (1), (5), (600)")), ("n", 2, s("UPDATE t SET x = 1 WHERE id < 9")), ("n", 3, s("DELETE FROM t WHERE id > 3")),
            ("n", 4, s("INSERT INTO t VALUES (5); UPDATE t SET x = 2 WHERE id = 600")), ("n", 5, s("INSERT INTO t VALUES (9); DELETE FROM t WHERE id = 9")), ("m", 3, s("INSERT INTO t VALUES (5)")),
        ],
        SQL,
    )
    want = [("m", "t", 5, 3), ("n", "t", 1, 2), ("n", "t", 5, 4)]
    low, high = log.where(f"commit_version <= {cut_at}"), log.where(f"commit_version >= {cut_at}")
    assert rows(fold.sql_state(log)) == want
    assert rows(fold.sql_state(low, fold.sql_fold(high))) == want
    assert rows(fold.sql_state(high, fold.sql_fold(low, fold.sql_fold(high)))) == want


def test_a_clear_is_remembered_between_batches(spark):
    schema = "node_id string, sequence long, operation string, kv_key string, kv_value string"
    first = spark.createDataFrame([("n", 2, "Set", "k", "old"), ("n", 9, "Clear", None, None), ("n", 12, "Set", "z", "1"), ("n", 11, "Delete", "y", None)], schema)
    late = spark.createDataFrame([("n", 4, "Set", "q", "late"), ("n", 10, "Set", "y", "late"), ("n", 13, "Set", "k", "new")], schema)
    want = [("n", "k", 13, "new"), ("n", "z", 12, "1")]
    for a, b in ((first, late), (late, first)):
        state = fold.kv_fold(a)
        assert rows(fold.kv_state(b, state)) == want
        assert rows(fold.kv_state(b, fold.kv_fold(b, fold.kv_fold(a, state)))) == want
    assert rows(fold.kv_state(late.limit(0), fold.kv_fold(first))) == [("n", "z", 12, "1")]


def test_statement_effects():
    e = logsql.sql_effects
    assert e("/* c */ UPDATE `shop`.`T` SET label = 'WHERE id = 9; --' WHERE 7 = id -- x") == [("t", "U", 7, 7)]
    assert e("insert into T (qty, ID) values (1, -2), (3, 4) on duplicate key update qty = values(qty)") == [("t", "I", -2, -2), ("t", "I", 4, 4)]
    assert e("DELETE FROM t WHERE id IN (3, NULL, 4) AND id != 3") == [("t", "D", 4, 4)]
    assert e("DELETE FROM t WHERE NOT id IN (3, NULL)") == []
    assert e("DELETE FROM t WHERE id BETWEEN 2 AND 3.5") == [("t", "D", 2, 3)]
    assert e("UPDATE t SET a = 'it''s', b = \"x\\\"y\"") == [("t", "U", iv.LOW, iv.HIGH)]
    assert e("UPDATE t SET id = id, a = 2 WHERE id = 4") == e("UPDATE t SET id = 4 WHERE id = 4") == [("t", "U", 4, 4)]
    moved = ("UPDATE t SET id = 5 WHERE id = 4", "UPDATE t SET id = id + 1", "INSERT INTO t VALUES (1) ON DUPLICATE KEY UPDATE id = 3")
    tails = ("DELETE FROM t LIMIT 1", "UPDATE t SET a = 1 LIMIT 1", "DELETE FROM t WHERE id = 3 LIMIT 1", "INSERT INTO t VALUES (1) RETURNING id", "UPDATE t u SET a = 1")
    for bad in (*moved, *tails, "UPDATE t SET a = 1 WHERE qty = 3", "INSERT INTO t SELECT 1", "DELETE FROM t WHERE id = "):
        with pytest.raises(logsql.Unsupported):
            e(bad)


@pytest.mark.parametrize("lo,hi", [(0, 0), (-3, 40), (5, 4096), (-70000, 123456), (iv.LOW, iv.HIGH), (17, iv.HIGH)])
def test_blocks_cover_exactly(lo, hi):
    cover = iv.blocks(lo, hi)
    spans = sorted((p << level, ((p + 1) << level) - 1) if level < 64 else (iv.LOW, iv.HIGH) for level, p in cover)
    assert spans[0][0] == lo and spans[-1][1] == hi
    assert all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:], strict=False))


# -- deduplication


def test_one_copy_of_each_message(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (3, "a", 4), (4, None, 1), (5, None, 1), (6, "b", 9)], "d long, m string, t long").withColumn("__kept", F.lit(0))
    assert rows(dedup.surplus(df, ["m"], "d", ["d"])) == [(2,), (3,)]
    assert rows(dedup.surplus(df, ["m"], "d", ["t", "d"])) == [(1,), (2,)]
    assert rows(dedup.keepers(df.drop("__kept"), ["m"], ["d"], ["d"])) == [("a", 1), ("b", 6), (None, 4)]
    assert dedup.surplus(df.limit(0), ["m"], "d", ["d"]).count() == 0


# -- references


def test_orphans_by_time(spark, monkeypatch):
    t = lambda d: dt.datetime(2025, 1, d)
    child = spark.createDataFrame(
        [(1, 7, t(5), "x"), (2, 7, t(2), "x"), (3, 8, t(5), "x"), (4, None, t(5), "x"), (1, 7, t(5), "late"), (5, 7, t(10), "x"), (6, 7, None, "x"), (7, 9, t(5), "x")],
        "id long, ref long, at timestamp, __since string",
    )
    parent = spark.createDataFrame(
        [(7, t(3), t(6)), (7, t(3), t(6)), (7, t(20), None), (9, None, None), (None, t(1), None)], "id long, since timestamp, until timestamp"
    )
    ref = lambda parent, name="p", column="ref": references.Reference(name, column, parent, "id", "since", "until")
    ids = lambda *args: rows(references.orphans(*args).select("ref_table", "id"))
    want = [("p", 2), ("p", 3), ("p", 5), ("p", 7)]
    for most in (references.skew.BROADCAST_ROWS, 0):  # broadcast, or shuffled with hot references in pieces
        monkeypatch.setattr(references.skew, "BROADCAST_ROWS", most)
        monkeypatch.setattr(references.skew, "HOT_LEAST", 1)
        assert ids(child, "id", "at", [ref(parent)]) == want
        assert ids(child.limit(0), "id", "at", [ref(parent)]) == []
        assert ids(child, "id", "at", [ref(parent.limit(0))]) == [("p", n) for n in (1, 2, 3, 5, 7)]
        both = child.withColumn("other", F.when(F.col("id") < 3, "7"))
        assert ids(both, "id", "at", [ref(parent), ref(parent, "q", "other")]) == [*want, ("q", 2)]


# -- incremental


def test_not_taken_against_brute_force(spark, small):
    for name, version, point in (("kv_wal", "sequence", "kv_sequence"), ("sql_wal", "commit_version", "sql_commit_version")):
        log = table(spark, small, name).select("node_id", version, "arrived_at")
        runs = table(spark, small, "recovery_points").where("status = 'ok'")
        ok = [(r.node_id, r.started_at, r[point]) for r in runs.collect() if r[point] is not None]
        first = {}
        for node, v, at in (tuple(r) for r in log.collect()):
            first[node, v] = min(at, first.get((node, v), at))
        want = {(n, v) for (n, v), at in first.items() if not any(n == m and at <= s and v <= p for m, s, p in ok)}
        got = incremental.not_taken(log, runs, ["node_id"], version, "arrived_at", "started_at", point)
        assert {tuple(r) for r in got.collect()} == want
        assert got.count() == len(want)
        assert incremental.not_taken(log, runs.limit(0), ["node_id"], version, "arrived_at", "started_at", point).count() == len(first)
        assert incremental.not_taken(log.limit(0), runs, ["node_id"], version, "arrived_at", "started_at", point).count() == 0


def test_not_taken_whatever_the_clocks(spark):
    t = lambda y: dt.datetime(y, 1, 1)
    log = spark.createDataFrame([("a", i, t(2020)) for i in range(5)] + [("a", 9, t(9998)), ("a", 10, None), ("b", 1, t(2020))], "node string, seq long, at timestamp")
    runs = spark.createDataFrame([("a", t(9999), 3), ("a", t(2021), 4), ("a", t(1), 99), ("a", None, 7)], "node string, started timestamp, point long")
    got = incremental.not_taken(log, runs, ["node"], "seq", "at", "started", "point")
    assert rows(got) == [("a", 10), ("a", 9), ("b", 1)]


def test_many_steps_are_shuffled(spark, monkeypatch):
    log = spark.range(500).selectExpr("'a' AS node", "id % 100 AS seq", "id AS at")
    runs = spark.range(0, 500, 5).selectExpr("'a' AS node", "id AS started", "(1000 - id) DIV 13 AS point")
    want = rows(incremental.not_taken(log, runs, ["node"], "seq", "at", "started", "point"))
    first = {i % 100: i % 100 for i in range(500)}
    assert want == [("a", n) for n, at in sorted(first.items()) if not any(at <= s and n <= (1000 - s) // 13 for s in range(0, 500, 5))]
    monkeypatch.setattr(incremental, "BROADCAST_ROWS", 3)
    assert rows(incremental.not_taken(log, runs, ["node"], "seq", "at", "started", "point")) == want


def test_processor_replays_and_misses_nothing(spark, tmp_path):
    schema = "node string, seq long, v string, d long"
    log = spark.createDataFrame([("a", 1, "x", 1), ("a", 2, "y", 2), ("a", 2, "y2", 3), ("b", 1, "z", 4)], schema)
    p = LogProcessor(spark, str(tmp_path / "state"), ["node"], "seq", "d")

    def broken(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        p.run(log, broken)
    assert p.pending() == 0
    more = log.union(spark.createDataFrame([("a", 5, "later", 5)], schema))  # the plan still ends at delivery 4
    assert p.run(more, lambda df: df) == 0
    assert rows(p.results().select("node", "seq", "v")) == [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")]
    late = more.union(spark.createDataFrame([("b", 0, "late", 6), ("a", 3, "gap", 7), ("a", 1, "again", 8), ("c", 1, "no time", None)], schema))
    assert p.run(late, lambda df: df) == 1
    assert rows(p.results().select("node", "seq")) == [("a", 1), ("a", 2), ("a", 3), ("a", 5), ("b", 0), ("b", 1), ("c", 1)]
    assert p.run(late, lambda df: df) == -1
    last = late.union(spark.createDataFrame([("a", 4, "fills", 9), ("c", 7, "new", 10)], schema))
    with pytest.raises(RuntimeError):
        p.run(last, broken)
    with pytest.raises(ValueError, match="lack seq"):
        p.run(last, lambda df: df.drop("seq"))
    assert p.run(last, lambda df: df.where("node = 'a'")) == 2  # what the function drops is taken in all the same
    assert p.run(last, lambda df: df) == -1
    assert [tuple(r) for r in p.results().where("seq > 3").select("node", "seq").orderBy("seq").collect()] == [("a", 4), ("a", 5)]
    assert p.run(last.limit(0), lambda df: df) in (-1, 3)  # a log that lost its rows adds none
    assert p.results().count() == 8


def test_processor_takes_over_the_runs_of_another(spark, tmp_path):
    log = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("a", 3, 30), ("a", 2, 40), ("b", 1, 15)], "node string, seq long, d long")
    runs = spark.createDataFrame([("a", 25, 2), ("b", 12, 9), ("b", None, 9)], "node string, started long, point long")
    p = LogProcessor(spark, str(tmp_path / "state"), ["node"], "seq", "d")
    p.adopt(runs, "started", "point")
    assert p.run(log, lambda df: df.select("node", "seq")) == 0
    assert rows(p.results()) == [("a", 3), ("b", 1)]
    more = log.union(spark.createDataFrame([("a", 1, 50), ("a", 4, 51), ("b", 0, 52)], log.schema))
    assert p.run(more, lambda df: df.select("node", "seq")) == 1
    assert rows(p.results()) == [("a", 3), ("a", 4), ("b", 0), ("b", 1)]
    with pytest.raises(ValueError, match="before the first batch"):
        p.adopt(runs, "started", "point")


# -- broken lines


def test_bad_lines_against_standard_parser(spark, small):
    lines = table(spark, small, "wal_lines")
    want = {}
    for r in lines.collect():
        if r.raw_line is not None and r.raw_line.strip(" \t\r\n") and (why := brute.reason(r.raw_line, r.engine)):
            want[r.line_id] = why
    assert {r.line_id: r.reason for r in badrows.bad_lines(lines).collect()} == want
    good = {r.line_id for r in badrows.good_lines(lines).collect()}
    there = {r.line_id for r in lines.collect() if r.raw_line is not None and r.raw_line.strip(" \t\r\n")}
    assert good == there - set(want)


def record(**change):
    value = {"format_version": 2, "sequence": 1, "timestamp_millis": 2, "operation": {"Set": {"key": "é/\n", "value": '"'}}}
    op = json.dumps(value["operation"], ensure_ascii=False, separators=(",", ":"))
    value["checksum"] = walrecord.checksum([1, 2], op)
    return json.dumps(value | change, ensure_ascii=False, separators=(",", ":"))


@pytest.mark.parametrize(
    "line,reason",
    [
        (record(), None),
        (" \t" + record() + "\r\n", None),
        (record().replace("é", "\\u00e9").replace(":", " : "), None),
        (record()[:-1], "syntax"),
        (record() + "x", "syntax"),
        ("[" + record() + "]", "syntax"),
        (record().replace("2,", "02,", 1), "syntax"),
        (record() + " ", "syntax"),
        ("{}", "fields"),
        (record(extra=1), "fields"),
        (record()[:-1] + ',"sequence":1}', "fields"),
        (record(sequence=1.0), "value"),
        (record(sequence="1"), "value"),
        (record(sequence=-1), "value"),
        (record(sequence=2**64), "value"),
        (record(checksum=2**32), "value"),
        (record(operation="clear"), "value"),
        (record(operation={"Set": {"key": "a"}}), "value"),
        (record(operation={"Delete": {"key": None}}), "value"),
        (record(format_version=1), "version"),
        (record(sequence=3), "checksum"),
        ("[" * 50_000, "syntax"),
        (record(operation={"Set": {"key": "a" * 300_000, "value": "\\" * 5000}}), "checksum"),
    ],
)
def test_reasons(spark, line, reason):
    assert walrecord.diagnose(line, "kv")[0] == reason
    df = spark.createDataFrame([(1, "kv", line, "n", "n")], "line_id long, engine string, raw_line string, node_id string, reason string")
    assert [r.reason for r in badrows.bad_lines(df).collect()] == ([reason] if reason else [])


def test_blank_lines_are_no_lines(spark):
    df = spark.createDataFrame([(1, "kv", None, "n"), (2, "kv", "", "n"), (3, "sql", " \t\r\n", "n")], "line_id long, engine string, raw_line string, node_id string")
    assert badrows.bad_lines(df).count() == 0 and badrows.good_lines(df).count() == 0


def test_found_queries_have_their_columns(spark, small):
    want = {
        "p1_found": ["engine", "node_id", "state_key", "version"],
        "p2_found": ["engine", "delivery_id"],
        "p3_found": ["ref_table", "period", "order_id"],
        "p4_found": ["engine", "node_id", "version"],
        "p5_found": ["line_id", "reason"],
    }
    for name, columns in want.items():
        df = general.QUERIES[name](spark, small)
        assert df.columns == columns
        assert df.count() == df.distinct().count() > 0
