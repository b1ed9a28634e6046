from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.engine import ast as A
from tidemark.engine.errors import AnalysisError, ParseError, SqlError, Unsupported
from tidemark.engine.evaluate import evaluate, like, truth
from tidemark.engine.lexer import split_statements
from tidemark.engine.parser import Parser, parse
from tidemark.engine.planner import Source
from tidemark.engine.tables import run_query
from tidemark.plans import catalogue


@pytest.fixture(scope="module")
def q(spark):
    tables = {
        "t": spark.createDataFrame(
            [(1, 1.5, "a", True, 1), (2, None, "B", False, 2), (None, 2.0, None, None, 3), (0, -1.0, "", True, 4), (2, 2.0, "a\\b_%\n", False, 5)],
            "i long, f double, s string, b boolean, k long",
        ),
        "e": spark.createDataFrame([], "i long, s string"),
        "scores": spark.createDataFrame([("a", 10), ("a", 20), ("b", None)], "team string, score long"),
        "users": spark.createDataFrame([(1, "A"), (2, "B")], "id long, name string"),
        "orders": spark.createDataFrame([(1, 1, 10.0), (2, 1, 20.0)], "id long, user_id long, amount double"),
    }
    lookup = lambda n: Source(tables[n]) if n in tables else None
    return lambda sql, *params: [tuple(r) for r in run_query(spark, sql, lookup, list(params)).collect()]


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT 1 UNION SELECT 2", "SELECT a FROM t, u", "SELECT * FROM t NATURAL JOIN u", "SELECT * FROM t JOIN u USING (a)", "SELECT * FROM t FULL JOIN u ON 1 = 1",
        "SELECT a BETWEEN 1 AND 2 FROM t", "SELECT CASE WHEN a THEN 1 END FROM t", "SELECT CAST(a AS INT) FROM t", "SELECT a % 2 FROM t", "SELECT a DIV 2 FROM t",
        "SELECT a <=> b FROM t", "SELECT a || b FROM t", "SELECT a LIKE 'x' ESCAPE '!' FROM t", "SELECT UPPER(a) FROM t", "SELECT COUNT(a, b) FROM t",
        "SELECT SUM(a) OVER () FROM t", "SELECT a FROM t GROUP BY ROLLUP(a)", "SELECT a FROM t GROUP BY a WITH ROLLUP", "SELECT a FROM t LIMIT 1 OFFSET 2", "SELECT a FROM t LIMIT 1, 2",
        "SELECT a FROM t ORDER BY a NULLS LAST", "SELECT DISTINCT ON (a) b FROM t", "WITH RECURSIVE x AS (SELECT 1) SELECT 1", "SELECT * FROM (SELECT 1)", "SELECT * FROM f(1)",
        "SELECT a.b.c FROM t", "SELECT * EXCEPT (a) FROM t", "SELECT a IS TRUE FROM t", "SELECT (1, 2)", "CREATE TABLE t AS SELECT 1", "CREATE TABLE t (a DATE)",
        "CREATE TABLE t (a INT, INDEX (a))", "CREATE TABLE t (a INT REFERENCES p(a) ON DELETE CASCADE)", "DROP TABLE a, b", "ALTER TABLE IF EXISTS t ADD a INT",
        "ALTER TABLE t ADD a INT FIRST", "ALTER TABLE t DROP COLUMN a CASCADE", "INSERT IGNORE INTO t VALUES (1)", "REPLACE INTO t VALUES (1)", "UPDATE t SET (a, b) = (1, 2)",
        "UPDATE t u SET a = 1", "UPDATE t SET a = 1 FROM u", "UPDATE t SET a = 1 LIMIT 1", "DELETE FROM t ORDER BY a", "DELETE FROM t USING u", "ROLLBACK TO SAVEPOINT x",
        "SET x = 1", "SHOW GRANTS", "MERGE INTO t", "SELECT 0x1F", "SELECT 9223372036854775808", "SELECT", "SELECT 1 FROM", "SELECT 'open", "SELECT 1; SELECT 2",
    ],
)
def test_rejected(sql):
    with pytest.raises(ParseError):
        parse(sql)


def test_texts_and_names():
    assert parse("SELECT 'it''s', \"a\", N'n', 'x\\'y' -- c\n FROM `A b`").query.source == A.TableRef("a b", None)
    assert [i.expr.value for i in parse("SELECT 'it''s', \"a\", N'n', 'x\\'y'").query.items] == ["it's", "a", "n", "x'y"]
    assert parse("select X.Y As Z from DB.T x").query.items[0] == A.Item(A.Column("x", "y"), "z")
    assert split_statements("SELECT ';'; -- a;b\n SELECT 2;;") == ["SELECT ';'", "-- a;b\n SELECT 2"]
    assert A.from_json(A.to_json(Parser("NOT a IN (1, 2.5) AND b LIKE 'x%'").expr())) == Parser("NOT a IN (1, 2.5) AND b LIKE 'x%'").expr()
    assert isinstance(parse("CREATE TABLE t (a INT DEFAULT -1)"), A.CreateTable)


@pytest.mark.parametrize(
    "where,keys",
    [
        ("i", [1, 2, 5]), ("f", [1, 3, 4, 5]), ("s", [1, 2, 5]), ("b", [1, 4]), ("NOT i", [4]), ("i = NULL", []), ("i != 'x'", [1, 2, 4, 5]), ("i = 'x'", []),
        ("NOT (i < 'x')", [1, 2, 4, 5]), ("b = 1", []), ("b != 1", [1, 2, 4, 5]), ("i IN (1, NULL)", [1]), ("i NOT IN (1, NULL)", []), ("i IN ('1', 2)", [2, 5]), ("i IN (1.0, 2)", [1, 2, 5]),
        ("s LIKE 'b'", [2]), ("s LIKE 'A\\b\\_%%'", []), ("s LIKE 'a_b%'", [5]), ("i LIKE '1'", []), ("i NOT LIKE '1'", [1, 2, 4, 5]), ("s LIKE NULL", []),
        ("i IS NULL OR f IS NULL", [2, 3]), ("i > 1 AND f", [5]), ("TRUE OR i", [1, 2, 3, 4, 5]), ("i / 2 = 0", [1, 4]), ("-i / 2 = -1", [2, 5]), ("f > i", [1]),
        ("i IN (SELECT i FROM t WHERE b)", [1, 4]), ("i NOT IN (SELECT i FROM e)", [1, 2, 3, 4, 5]), ("i NOT IN (SELECT i FROM t WHERE k = 3)", []),
        ("EXISTS (SELECT 1 FROM e)", []), ("NOT EXISTS (SELECT 1 FROM e)", [1, 2, 3, 4, 5]), ("(SELECT MAX(i) FROM e) IS NULL", [1, 2, 3, 4, 5]), ("s = 'A'", []), ("NULL", []),
    ],
)
def test_conditions(q, where, keys):
    assert sorted(r[0] for r in q(f"SELECT k FROM t WHERE {where}")) == keys


@pytest.mark.parametrize(
    "sql,error",
    [
        ("SELECT s + 1 FROM t", AnalysisError), ("SELECT -b FROM t", AnalysisError), ("SELECT SUM(s) FROM t", AnalysisError), ("SELECT x FROM t", AnalysisError),
        ("SELECT k FROM t a JOIN t b ON a.k = b.k", AnalysisError), ("SELECT a.k FROM t a JOIN t a ON 1 = 1", AnalysisError), ("SELECT * FROM nope", AnalysisError),
        ("SELECT z.* FROM t", AnalysisError), ("SELECT k FROM t ORDER BY nope", AnalysisError), ("SELECT k FROM t HAVING k > 1", AnalysisError),
        ("SELECT SUM(COUNT(*)) FROM t", AnalysisError), ("SELECT k FROM t WHERE COUNT(*) > 1", AnalysisError), ("SELECT (SELECT i, s FROM t)", AnalysisError),
        ("SELECT k FROM t WHERE k = ?", ParseError), ("SELECT i / 0 FROM t", Exception), ("SELECT f / 0.0 FROM t", Exception), ("SELECT (SELECT k FROM t)", Exception),
        ("SELECT k + 9223372036854775807 FROM t", Exception), ("SELECT k FROM t WHERE k IN (SELECT x.k FROM e x)", AnalysisError),
    ],
)
def test_errors(q, sql, error):
    with pytest.raises(error):
        q(sql)


def test_aggregates_and_order(q):
    assert q("SELECT team, COUNT(*), SUM(score), AVG(score) FROM scores GROUP BY team HAVING COUNT(*) > 1") == [("a", 2, 30, 15.0)]
    assert q("SELECT team FROM scores GROUP BY team ORDER BY COUNT(*) DESC") == [("a",), ("b",)]
    assert q("SELECT team FROM scores GROUP BY team HAVING COUNT(*) > 0 ORDER BY MAX(score)") == [("b",), ("a",)]
    assert q("SELECT COUNT(*), SUM(i), MIN(s), AVG(DISTINCT i) FROM e") == [(0, None, None, None)]
    assert q("SELECT COUNT(*) FROM e GROUP BY i") == []
    assert q("SELECT COUNT(DISTINCT i), SUM(DISTINCT f), MAX(b), COUNT(i) + 1 FROM t") == [(3, 2.5, True, 5)]
    assert q("SELECT k FROM t ORDER BY i, k") == [(3,), (4,), (1,), (2,), (5,)]
    assert q("SELECT k FROM t ORDER BY i DESC, k DESC") == [(5,), (2,), (1,), (4,), (3,)]
    assert q("SELECT DISTINCT i FROM t ORDER BY k DESC LIMIT 3") == [(2,), (0,), (None,)]
    assert q("SELECT DISTINCT i FROM t ORDER BY f DESC, k") == [(None,), (2,), (1,), (0,)]
    assert q("SELECT k AS i, i AS z FROM t ORDER BY i, k LIMIT 2") == [(3, None), (4, 0)]  # the source column wins
    assert q("SELECT i, s, COUNT(*) FROM t WHERE i = 2 GROUP BY i") == [(2, "B", 2)]  # first row of the group
    assert q("SELECT i, COUNT(*) AS n FROM t GROUP BY t.i ORDER BY n DESC, i") == [(2, 2), (None, 1), (0, 1), (1, 1)]
    assert q("SELECT 1 AS x, 1 AS x, k FROM t WHERE k = ? AND s = ?", 1, "a") == [(1, 1, 1)]
    assert q("SELECT k FROM t WHERE i = ?", None) == []


def test_joins_and_ctes(q):
    totals = "WITH totals AS (SELECT user_id, SUM(amount) AS total FROM orders GROUP BY user_id) SELECT u.name, t.total FROM users u LEFT JOIN totals t ON u.id = t.user_id"
    assert sorted(q(totals)) == [("A", 30.0), ("B", None)]
    assert q("SELECT u.id, o.amount FROM users u JOIN orders o ON u.id = o.user_id ORDER BY o.amount DESC LIMIT 1") == [(1, 20.0)]
    assert sorted(q("SELECT l.id, r.id FROM users l RIGHT JOIN (SELECT * FROM orders) r ON l.id = r.id + 1"), key=str) == [(2, 1), (None, 2)]
    assert len(q("SELECT * FROM users a JOIN users b")) == 4
    assert sorted(q("WITH users AS (SELECT 7 AS id), v(n) AS (SELECT id FROM users) SELECT n FROM v")) == [(7,)]
    assert q("SELECT a.i FROM t a JOIN t b ON a.i = b.i AND a.k < b.k WHERE a.f IS NULL") == [(2,)]
    with pytest.raises(AnalysisError):
        q("WITH v(a, b) AS (SELECT 1) SELECT a FROM v")


def test_plans_push_filters_and_prune(spark, small):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = catalogue.QUERIES["scan_index_range"](spark, small)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), IsNotNull(o_totalprice), EqualTo(o_orderstatus,F), GreaterThanOrEqual(o_totalprice,150000.0)]" in plan
    read = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "o_orderdate" not in read and "o_orderpriority" not in read
    assert "TakeOrderedAndProject" in catalogue.QUERIES["topn"](spark, small)._jdf.queryExecution().toString()


literal = st.one_of(st.none(), st.booleans(), st.integers(-3, 3), st.sampled_from([0.0, 1.0, -2.5]), st.sampled_from(["", "a", "A%", "b_"]))
column = st.sampled_from(["i", "f", "s", "b"])


def spell(v):
    return {None: "NULL", True: "TRUE", False: "FALSE"}.get(v, f"'{v}'" if isinstance(v, str) else repr(v)) if v is None or isinstance(v, bool) else (f"'{v}'" if isinstance(v, str) else repr(v))


@st.composite
def condition(draw, depth=2):
    kind = draw(st.sampled_from(["cmp", "null", "like", "in", "truth"] + (["and", "or", "not"] * 2 if depth else [])))
    if kind in ("and", "or"):
        return f"({draw(condition(depth - 1))} {kind.upper()} {draw(condition(depth - 1))})"
    if kind == "not":
        return f"(NOT {draw(condition(depth - 1))})"
    c = draw(column)
    if kind == "cmp":
        return f"({c} {draw(st.sampled_from(['=', '!=', '<', '<=', '>', '>=']))} {draw(st.one_of(column, literal.map(spell)))})"
    if kind == "null":
        return f"({c} IS {draw(st.sampled_from(['', 'NOT ']))}NULL)"
    if kind == "like":
        return f"({c} {draw(st.sampled_from(['', 'NOT ']))}LIKE {spell(draw(st.sampled_from(['a', '%', 'a%', '_', 'A_%'])))})"
    if kind == "in":
        return f"({c} {draw(st.sampled_from(['', 'NOT ']))}IN ({', '.join(spell(v) for v in draw(st.lists(literal, min_size=1, max_size=3)))}))"
    return c


ROW = st.tuples(st.one_of(st.none(), st.integers(-3, 3)), st.one_of(st.none(), st.sampled_from([0.0, 1.0, -2.5])), st.one_of(st.none(), st.sampled_from(["", "a", "Ab", "b_"])), st.one_of(st.none(), st.booleans()))


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(conditions=st.lists(condition(), min_size=4, max_size=4), data=st.lists(ROW, min_size=1, max_size=8))
def test_lowering_agrees_with_evaluation(spark, conditions, data):
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(data)], "i long, f double, s string, b boolean, k long")
    items = ", ".join(f"{c} AS c{n}" for n, c in enumerate(conditions))
    got = {r.k: r for r in run_query(spark, f"SELECT k, {items} FROM t", lambda _: Source(df)).collect()}
    for k, r in enumerate(data):
        row = dict(zip("ifsb", r, strict=True))
        for n, c in enumerate(conditions):
            want = evaluate(Parser(c).expr(), row)
            assert truth(got[k][f"c{n}"]) == truth(want), (c, row)


def test_like_rules():
    assert like("Hello World", "hello%") and like("cat", "c_t") and not like("cat", "d%") and like("a\nb", "a%b") and like("a\\b", "a\\b")


def test_evaluate_constants():
    e = lambda s: evaluate(Parser(s).expr())
    assert e("-7 / 2") == -3 and e("7 / 2.0") == 3.5 and e("1 + NULL") is None and e("NULL OR TRUE") is True and e("NULL AND FALSE") is False
    with pytest.raises(SqlError):
        e("1 / 0")
    with pytest.raises(Unsupported):
        e("ABS(1)")
