"""Queries of the dialect, by operator, with the SQL that another engine needs for the same result.

An entry is the text in the dialect and, where it differs, the text for the other engine: there LIKE is spelt ILIKE,
``/`` of whole numbers ``//``, whole numbers are BIGINT, and NULLs sort first only if told so. Floating sums are
rounded on both sides, as the order of addition differs; the dialect itself has no functions, so the rounding is done
on the DataFrame.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.engine import constraints, dml
from tidemark.engine.tables import query_folder
from tidemark.operators.fold import fold_changes
from tidemark.operators.fold import kv_state as kv_alive
from tidemark.sources import table

#: name: dialect text | (dialect text, other text) | (dialect text, other text or None, {column: digits})
SELECTS: dict[str, str | tuple] = {
    # scans
    "scan_all": "SELECT * FROM nation",
    "scan_point": "SELECT * FROM orders WHERE o_orderkey = 77",
    "scan_index_range": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 150000",
    "select_no_from": ("SELECT 1 AS one, 'x' AS t, TRUE AS b", "SELECT CAST(1 AS BIGINT) AS one, 'x' AS t, TRUE AS b"),
    "derived_table": "SELECT d.k, d.n FROM (SELECT n_regionkey AS k, n_name AS n FROM nation WHERE n_nationkey > 5) d WHERE d.k = 2",
    # projection and filter
    "proj_alias": "SELECT c_custkey AS id, c_name AS nm FROM customer",
    "proj_qualified_star": "SELECT n.* FROM nation n INNER JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA'",
    "filter_cmp": "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 30 AND l_quantity < 32 AND l_tax != 0.02",
    "filter_bool": "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice > 100000) AND o_custkey <= 900",
    "filter_is_null": "SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000 WHERE o.o_orderkey IS NULL",
    "filter_is_not_null": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000 WHERE o.o_orderkey IS NOT NULL",
    "filter_like_prefix": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'LARGE%'",
    "filter_like_suffix": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%RING'",
    "filter_like_underscore": "SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'brand__'",
    "filter_not_like": "SELECT p_partkey FROM part WHERE p_name NOT LIKE '%ring%'",
    "filter_in_list": "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('FURNITURE', 'BUILDING')",
    "filter_not_in_list": "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (1, 2, 3)",
    "filter_not_in_null": "SELECT n_name FROM nation WHERE n_nationkey NOT IN (1, NULL)",
    "filter_in_null": "SELECT n_name FROM nation WHERE n_nationkey IN (1, NULL)",
    "filter_eq_null": "SELECT n_name FROM nation WHERE n_nationkey = NULL",
    "filter_unlike_types": ("SELECT n_nationkey FROM nation WHERE n_name != 5 AND NOT (n_name = 5)", "SELECT n_nationkey FROM nation"),
    "expr_arith": ("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity > 49", None, {"net": 4}),
    "expr_intdiv": (
        "SELECT o_orderkey, o_custkey / 7 AS b, -o_custkey / 7 AS nb FROM orders",
        "SELECT o_orderkey, o_custkey // 7 AS b, -o_custkey // 7 AS nb FROM orders",
    ),
    "expr_unary": (
        "SELECT n_nationkey, -n_nationkey AS neg, +n_regionkey AS pos FROM nation",
        "SELECT n_nationkey, CAST(-n_nationkey AS BIGINT) AS neg, CAST(n_regionkey AS BIGINT) AS pos FROM nation",
    ),
    "expr_truthy": ("SELECT n_name FROM nation WHERE n_regionkey AND n_name", "SELECT n_name FROM nation WHERE n_regionkey <> 0 AND n_name <> ''"),
    # joins
    "join_inner": "SELECT o.o_orderkey, c.c_name FROM orders o INNER JOIN customer c ON o.o_custkey = c.c_custkey",
    "join_left": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 300000) o ON c.c_custkey = o.o_custkey",
    "join_right": "SELECT o.o_orderkey, c.c_custkey FROM (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 300000) o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey",
    "join_theta": "SELECT s.s_suppkey, n.n_nationkey FROM supplier s INNER JOIN nation n ON s.s_nationkey < n.n_nationkey",
    "join_theta_left": "SELECT n.n_nationkey, s.s_suppkey FROM nation n LEFT JOIN supplier s ON s.s_nationkey > n.n_nationkey",
    "join_theta_right": "SELECT s.s_suppkey, n.n_nationkey FROM supplier s RIGHT JOIN nation n ON s.s_nationkey > n.n_nationkey",
    "join_multi_key": "SELECT a.l_orderkey, a.l_linenumber FROM lineitem a INNER JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_partkey < b.l_partkey",
    "join_cross": "SELECT n.n_nationkey, r.r_regionkey FROM nation n CROSS JOIN region r",
    "join_mixed_numeric": "WITH p AS (SELECT p_size AS k, COUNT(*) AS parts FROM part GROUP BY p_size), l AS (SELECT l_quantity AS k, COUNT(*) AS lines FROM lineitem GROUP BY l_quantity) SELECT p.parts, l.k, l.lines FROM p INNER JOIN l ON p.k = l.k",
    "join_residual": "SELECT o.o_orderkey, c.c_custkey FROM orders o INNER JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 30",
    "join_three_way": "SELECT c.c_custkey, n.n_name, r.r_name FROM customer c INNER JOIN nation n ON c.c_nationkey = n.n_nationkey INNER JOIN region r ON n.n_regionkey = r.r_regionkey",
    "join_self": "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a INNER JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey",
    # aggregation
    "agg_group": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS cnt, AVG(l_quantity) AS avg_q FROM lineitem GROUP BY l_returnflag, l_linestatus", None, {"avg_q": 6}),
    "agg_global": "SELECT COUNT(*) AS cnt, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders",
    "agg_empty": "SELECT COUNT(o_custkey) AS cnt, SUM(o_totalprice) AS s, MIN(o_orderstatus) AS m FROM orders WHERE o_orderstatus = 'zzz'",
    "agg_count_null": "SELECT c.c_mktsegment, COUNT(*) AS all_rows, COUNT(o.o_orderkey) AS matched FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000 GROUP BY c.c_mktsegment",
    "agg_sum_int": ("SELECT o_orderstatus, SUM(o_custkey) AS s FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(SUM(o_custkey) AS BIGINT) AS s FROM orders GROUP BY o_orderstatus"),
    "agg_sum_float": ("SELECT o_orderstatus, SUM(o_totalprice) AS s FROM orders GROUP BY o_orderstatus", None, {"s": 2}),
    "agg_minmax_text": "SELECT c_nationkey, MIN(c_name) AS lo, MAX(c_mktsegment) AS hi FROM customer GROUP BY c_nationkey",
    "agg_minmax_bool": "SELECT o_orderstatus, MAX(o_totalprice > 200000) AS any_big FROM orders GROUP BY o_orderstatus",
    "agg_distinct": (
        "SELECT COUNT(DISTINCT o_custkey) AS dc, SUM(DISTINCT o_custkey) AS ds, AVG(DISTINCT o_custkey) AS da FROM orders",
        "SELECT COUNT(DISTINCT o_custkey) AS dc, CAST(SUM(DISTINCT o_custkey) AS BIGINT) AS ds, AVG(DISTINCT o_custkey) AS da FROM orders",
        {"da": 6},
    ),
    "agg_expr": ("SELECT l_returnflag, SUM(l_extendedprice * (1 - l_discount)) / COUNT(*) AS avg_net FROM lineitem GROUP BY l_returnflag", None, {"avg_net": 4}),
    "agg_group_expr": ("SELECT o_custkey / 100 AS bucket, COUNT(*) AS cnt FROM orders GROUP BY o_custkey / 100", "SELECT o_custkey // 100 AS bucket, COUNT(*) AS cnt FROM orders GROUP BY o_custkey // 100"),
    "agg_group_null": "SELECT o.o_orderstatus, COUNT(*) AS cnt FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000 GROUP BY o.o_orderstatus",
    "agg_having": "SELECT o_custkey, COUNT(*) AS cnt FROM orders GROUP BY o_custkey HAVING COUNT(*) > 15",
    "agg_having_only": "SELECT COUNT(*) AS cnt FROM orders HAVING COUNT(*) > 1000000",
    "agg_bare_col": (
        "SELECT o_custkey, o_orderstatus, COUNT(*) AS cnt FROM orders GROUP BY o_custkey",
        "SELECT o_custkey, ARG_MIN(o_orderstatus, o_orderkey) AS o_orderstatus, COUNT(*) AS cnt FROM orders GROUP BY o_custkey",
    ),
    "agg_detected": ("SELECT 1 + MAX(n_nationkey) AS m FROM nation", "SELECT CAST(1 + MAX(n_nationkey) AS BIGINT) AS m FROM nation"),
    "agg_group_ordinal": ("SELECT COUNT(*) AS n FROM nation GROUP BY 1", "SELECT COUNT(*) AS n FROM nation"),
    # distinct, order, limit
    "sort_ordinal": ("SELECT n_nationkey, n_name FROM nation ORDER BY 1 DESC", "SELECT n_nationkey, n_name FROM nation"),
    "distinct_cols": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "sort_multi": "SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey ASC, c_acctbal DESC, c_custkey",
    "sort_hidden_col": "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20",
    "sort_alias": "SELECT o_orderkey, o_totalprice * 2 AS dbl FROM orders ORDER BY dbl DESC, o_orderkey LIMIT 15",
    "sort_by_agg": "SELECT o_custkey, COUNT(*) AS count FROM orders GROUP BY o_custkey ORDER BY COUNT(*) DESC, o_custkey LIMIT 10",
    "sort_nulls": (
        "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000 ORDER BY o.o_orderkey, c.c_custkey LIMIT 25",
        "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000 ORDER BY o.o_orderkey NULLS FIRST, c.c_custkey LIMIT 25",
    ),
    "topn": "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 10",
    "limit_ordered": "SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 7",
    "limit_zero": "SELECT n_nationkey, n_name FROM nation LIMIT 0",
    "distinct_sort_hidden": (
        "SELECT DISTINCT c_nationkey FROM customer ORDER BY c_acctbal DESC LIMIT 5",
        "SELECT c_nationkey FROM (SELECT c_nationkey, MAX(c_acctbal) AS k FROM customer GROUP BY c_nationkey) t ORDER BY k DESC, c_nationkey LIMIT 5",
    ),
    # subqueries and CTEs
    "subq_scalar": "SELECT o_orderkey, (SELECT MAX(c_custkey) FROM customer) AS mx FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)",
    "subq_repeated": "SELECT n_nationkey FROM nation WHERE n_regionkey = (SELECT MIN(r_regionkey) FROM region) OR n_nationkey = (SELECT MIN(r_regionkey) FROM region)",
    "subq_scalar_empty": "SELECT n_nationkey, (SELECT r_name FROM region WHERE r_regionkey = 99) AS missing FROM nation",
    "subq_in": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    "subq_not_in": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)",
    "subq_not_in_null": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o.o_custkey FROM region r LEFT JOIN orders o ON r.r_regionkey = o.o_orderkey AND o.o_totalprice < 0)",
    "subq_exists": "SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM region WHERE r_name = 'ASIA')",
    "subq_not_exists": "SELECT n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM region WHERE r_name = 'nowhere')",
    "subq_in_having": "SELECT o_custkey, COUNT(*) AS cnt FROM orders GROUP BY o_custkey HAVING COUNT(*) > (SELECT COUNT(*) FROM region) * 3",
    "cte_simple": (
        "WITH f AS (SELECT o_custkey, SUM(o_totalprice) AS t FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) SELECT c.c_custkey, f.t AS t FROM customer c LEFT JOIN f ON c.c_custkey = f.o_custkey",
        None,
        {"t": 2},
    ),
    "cte_collist": "WITH v(k, n) AS (SELECT n_nationkey, n_name FROM nation) SELECT k, n FROM v WHERE k > 20",
    "cte_chain": "WITH a AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation), b AS (SELECT r, COUNT(*) AS cnt FROM a GROUP BY r) SELECT b.r, b.cnt, region.r_name FROM b INNER JOIN region ON b.r = region.r_regionkey",
    "cte_twice": "WITH t AS (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey) SELECT x.k, y.k AS k2 FROM t x INNER JOIN t y ON x.n = y.n WHERE x.k < y.k AND x.n > 18",
    "cte_shadow": "WITH nation AS (SELECT r_regionkey AS n_nationkey FROM region) SELECT n_nationkey FROM nation",
    # whole workloads
    "flagship": (
        "SELECT c.c_mktsegment, COUNT(*) AS cnt, SUM(o.o_totalprice) AS total FROM customer c INNER JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderstatus = 'F' GROUP BY c.c_mktsegment HAVING COUNT(*) > 0 ORDER BY total DESC",
        None,
        {"total": 2},
    ),
    "bench_cte_in": (
        "WITH paid AS (SELECT o_custkey, SUM(o_totalprice) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) SELECT c.c_custkey, p.total AS total FROM customer c LEFT JOIN paid p ON c.c_custkey = p.o_custkey WHERE c.c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250) ORDER BY p.total DESC, c.c_custkey LIMIT 25",
        "WITH paid AS (SELECT o_custkey, SUM(o_totalprice) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) SELECT c.c_custkey, p.total AS total FROM customer c LEFT JOIN paid p ON c.c_custkey = p.o_custkey WHERE c.c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250) ORDER BY p.total DESC NULLS LAST, c.c_custkey LIMIT 25",
        {"total": 2},
    ),
}


def select(name: str) -> Callable[[SparkSession, str], DataFrame]:
    entry = SELECTS[name]
    text, digits = (entry, {}) if isinstance(entry, str) else (entry[0], entry[2] if len(entry) > 2 else {})

    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = query_folder(spark, folder, text)
        return df.withColumns({c: F.round(c, n) for c, n in digits.items()}) if digits else df

    run.__name__, run.__doc__ = name, text
    return run


def other_text(name: str) -> str:
    entry = SELECTS[name]
    text, digits = (entry, {}) if isinstance(entry, str) else (entry[1] or entry[0], entry[2] if len(entry) > 2 else {})
    text = re.sub(r"\bLIKE\b", "ILIKE", text)
    if digits:
        text = f"SELECT * REPLACE ({', '.join(f'ROUND({c}, {n}) AS {c}' for c, n in digits.items())}) FROM ({text}) q"
    return text


def prepared_bind(spark: SparkSession, folder: str) -> DataFrame:
    """A statement with parameters."""
    return query_folder(spark, folder, "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = ? AND c_acctbal > ?", [7, 1000.0])


def _image(name: str, key: list[str], statement: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return dml.image(spark, folder, statement).select(*key)

    run.__name__, run.__doc__ = name, f"The table after {statement}"
    return run


update_image = _image("update_image", ["s_suppkey", "s_acctbal"], "UPDATE supplier SET s_acctbal = s_acctbal + 10 WHERE s_nationkey = 3")
update_subq_image = _image(
    "update_subq_image",
    ["s_suppkey", "s_acctbal"],
    "UPDATE supplier SET s_acctbal = (SELECT MAX(c_acctbal) FROM customer) WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
)
delete_image = _image("delete_image", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], "DELETE FROM supplier WHERE s_acctbal < 1000")


def upsert_image(spark: SparkSession, folder: str) -> DataFrame:
    """The table after an upsert of rows, some of which are there."""
    target = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    rows = query_folder(spark, folder, "SELECT c_custkey + 50 AS k, c_acctbal AS v FROM customer")
    return dml.upsert_image(spark, target, rows, ["k"], "INSERT INTO t (k, v) VALUES (1, 1) ON DUPLICATE KEY UPDATE v = v + VALUES(v)")


def fk_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose reference is missing."""
    child = table(spark, folder, "customer").select("c_custkey")
    parent = query_folder(spark, folder, "SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
    return constraints.missing_parents(child, ["c_custkey"], parent, ["o_custkey"])


def unique_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that occur more than once."""
    return constraints.repeated_keys(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


def check_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Rows for which a check is false."""
    return constraints.failed_check(spark, table(spark, folder, "lineitem"), "l_discount <= 0.09").select("l_orderkey", "l_discount")


def kv_state(spark: SparkSession, folder: str) -> DataFrame:
    """The last operation of each key of an operation log."""
    return fold_changes(table(spark, folder, "events"), ["user_id"], ["event_id"], "event_type", []).select(
        "user_id", F.col("event_type").alias("last_op"), F.col("event_id").alias("seq")
    )


def kv_state_after_clear(spark: SparkSession, folder: str) -> DataFrame:
    """The keys of an operation log in which every error clears the store."""
    log = table(spark, folder, "events").select(
        F.lit("n").alias("node_id"), F.col("event_id").alias("sequence"), F.when(F.col("event_type") == "error", "Clear").otherwise("Set").alias("operation"), F.col("user_id").alias("kv_key"), F.col("event_type").alias("kv_value")
    )
    return kv_alive(log).select(F.col("kv_key").alias("user_id"), F.col("sequence").alias("seq"), F.col("kv_value").alias("last_op"))


def pitr_cut(spark: SparkSession, folder: str) -> DataFrame:
    """The state of each key at a point in the log, a quarter of the way."""
    events = table(spark, folder, "events")
    point = events.agg(F.floor(F.max("event_id") / 4)).scalar()
    return fold_changes(events.where(F.col("event_id") <= point), ["user_id"], ["event_id"], "event_type", []).select("user_id", F.col("event_id").alias("seq"))


QUERIES = {name: select(name) for name in SELECTS} | {
    f.__name__: f
    for f in (
        prepared_bind, update_image, update_subq_image, delete_image, upsert_image, fk_violations, unique_violations,
        check_violations, kv_state, kv_state_after_clear, pitr_cut,
    )
}

ORACLE = {name: other_text(name) for name in SELECTS} | {
    "prepared_bind": "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7 AND c_acctbal > 1000.0",
    "update_image": "SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN s_acctbal + 10 ELSE s_acctbal END AS s_acctbal FROM supplier",
    "update_subq_image": "SELECT s_suppkey, CASE WHEN s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) THEN (SELECT MAX(c_acctbal) FROM customer) ELSE s_acctbal END AS s_acctbal FROM supplier",
    "delete_image": "SELECT * FROM supplier WHERE NOT COALESCE(s_acctbal < 1000, FALSE)",
    "upsert_image": "SELECT COALESCE(t.s_suppkey, i.k) AS k, CASE WHEN i.k IS NULL THEN t.s_acctbal WHEN t.s_suppkey IS NULL THEN i.v ELSE t.s_acctbal + i.v END AS v FROM supplier t FULL OUTER JOIN (SELECT c_custkey + 50 AS k, c_acctbal AS v FROM customer) i ON t.s_suppkey = i.k",
    "fk_violations": "SELECT c.c_custkey FROM customer c ANTI JOIN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) o ON c.c_custkey = o.o_custkey",
    "unique_violations": "SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1",
    "check_violations": "SELECT l_orderkey, l_discount FROM lineitem WHERE NOT COALESCE(l_discount <= 0.09, TRUE)",
    "kv_state": "SELECT user_id, ARG_MAX(event_type, event_id) AS last_op, MAX(event_id) AS seq FROM events GROUP BY user_id",
    "kv_state_after_clear": "SELECT user_id, MAX(event_id) AS seq, ARG_MAX(event_type, event_id) AS last_op FROM events WHERE event_type <> 'error' AND event_id > (SELECT COALESCE(MAX(event_id), 0) FROM events WHERE event_type = 'error') GROUP BY user_id",
    "pitr_cut": "SELECT user_id, MAX(event_id) AS seq FROM events WHERE event_id <= (SELECT MAX(event_id) // 4 FROM events) GROUP BY user_id",
}
