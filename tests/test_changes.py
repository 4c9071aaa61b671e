"""Change sets by key and as bags, also with nulls and hot rows."""

import pytest
from pyspark.errors import PySparkException

from tripleloom.operators.changes import snapshot_changes, snapshot_changes_bag

SCHEMA = "k int, v string, n int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_keyed(spark):
    old = frame(spark, [(1, "a", 1), (2, "b", None), (3, "c", 3), (None, "x", 1), (5, None, None)])
    new = frame(spark, [(1, "a", 1), (2, "b", 2), (4, "d", 4), (None, "y", 1), (5, None, None)])
    got = {tuple(r) for r in snapshot_changes(old, new, ["k"]).collect()}
    assert got == {
        ("update_preimage", 2, "b", None), ("update_postimage", 2, "b", 2), ("delete", 3, "c", 3),
        ("insert", 4, "d", 4), ("update_preimage", None, "x", 1), ("update_postimage", None, "y", 1)}
    assert snapshot_changes(old, old, ["k"]).count() == 0


def test_columns_may_come_in_another_order(spark):
    old = frame(spark, [(1, "a", 1)])
    assert snapshot_changes(old, old.select("n", "v", "k"), ["k"]).count() == 0
    assert snapshot_changes_bag(old, old.select("n", "v", "k")).count() == 0


def test_repeated_key_fails_instead_of_pairing(spark):
    twice = frame(spark, [(1, "a", 1), (1, "b", 1)])
    with pytest.raises(PySparkException, match="not unique"):
        snapshot_changes(twice, frame(spark, [(1, "a", 1)]), ["k"]).collect()


def test_bag(spark):
    old = frame(spark, [(1, "a", 1)] * 3 + [(2, None, None)])
    new = frame(spark, [(1, "a", 1)] + [(2, None, None)] * 4 + [(3, "c", 3)])
    got = {tuple(r) for r in snapshot_changes_bag(old, new).collect()}
    assert got == {("delete", 1, "a", 1, 2), ("insert", 2, None, None, 3), ("insert", 3, "c", 3, 1)}


def test_keyed_plan_shuffles_each_side_once(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        changes = snapshot_changes(orders, orders.filter("o_totalprice > 5"), ["o_orderkey"])
        plan = changes._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" in plan
