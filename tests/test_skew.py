from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import skew


@pytest.fixture(scope="module")
def sides(spark):
    """A third of the rows have one key; some keys are on one side only, some are null."""
    big = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 97 == 0, F.lit(None)).otherwise(F.col("id") % 50).cast("long").alias("k"), F.col("id").alias("v")
    )
    small = spark.createDataFrame([(7, "hot"), (7, "again"), (3, "x"), (999, "none"), (None, "null")], "k long, name string")
    return big, small


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_every_way_of_joining_agrees(sides, how):
    big, small = sides
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    want = rows(big.join(small, "k", how))
    assert rows(skew.join_counted(big, small, ["k"], how, F.col("v"))) == want
    spread = skew.join_counted(big, small, ["k"], how, F.col("v"), most=0)
    assert rows(spread) == want
    assert "BroadcastHashJoin" not in spread._jdf.queryExecution().executedPlan().toString()
    left, right = skew.salted(big, small, ["k"], F.col("v"), skew.hot_keys(big, ["k"], 8, 0))
    assert rows(left.join(right, ["k", skew.SALT], how).drop(skew.SALT)) == want


def test_hot_keys_are_spread(sides):
    big, small = sides
    hot = skew.hot_keys(big, ["k"], 20, 0)
    assert [tuple(r) for r in hot.collect()] == [(7, 7)]
    left, right = skew.salted(big, small, ["k"], F.col("v"), hot)
    pieces = left.where("k = 7").groupBy(skew.SALT).count().collect()
    assert len(pieces) == 7 and max(r["count"] for r in pieces) < 1000 / 7 * 2
    assert right.where("k = 7").count() == 2 * 7 and right.where("k = 999").count() == 1
    assert skew.hot_keys(big.limit(0), ["k"]).count() == 0
    assert skew.hot_keys(big, ["k"]).count() == 0  # a thousand rows are no burden
    assert skew.hot_keys(big, ["k"], 10_000, 0).count() == 50  # no most of keys
