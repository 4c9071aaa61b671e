"""Change sets between two snapshots of orders, and what they do to a graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripleloom.catalog.oracle import distinct, map_sql
from tripleloom.catalog.registry import query, table
from tripleloom.catalog.rules import _KINDS, SALES_MAPS
from tripleloom.operators.changes import snapshot_changes, snapshot_changes_bag
from tripleloom.operators.delta import count_rows, graph_delta

# The new snapshot starts two years later, ends later, and has urgent open orders filled.
_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
_OLD = f"SELECT {_COLUMNS} FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'"
_NEW = f"""SELECT o_orderkey, o_custkey,
    CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
    o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01'"""


def _snapshots(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    names = _COLUMNS.split(", ")
    old = orders.filter(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")).select(*names)
    filled = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "O")
    new = orders.filter(F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz")).select(
        "o_orderkey", "o_custkey", F.when(filled, "F").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        "o_totalprice", "o_orderdate", "o_orderpriority")
    return old, new


def _shown(changes):
    """Times as text, which both engines spell alike."""
    return changes.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


_SHOWN = "SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate) FROM"


@query("snapshot_changes", f"""{_SHOWN} (
    WITH a AS ({_OLD}), b AS ({_NEW}), both_sides AS (
        SELECT a.o_orderkey AS k, a.o_orderstatus AS old_status, b.o_orderstatus AS new_status
        FROM a JOIN b USING (o_orderkey) WHERE a.o_orderstatus <> b.o_orderstatus)
    SELECT 'delete' AS _change_type, a.* FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)
    UNION ALL SELECT 'insert', b.* FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)
    UNION ALL SELECT 'update_preimage', a.* FROM a WHERE o_orderkey IN (SELECT k FROM both_sides)
    UNION ALL SELECT 'update_postimage', b.* FROM b WHERE o_orderkey IN (SELECT k FROM both_sides))""")
def keyed(spark, sf_dir):
    return _shown(snapshot_changes(*_snapshots(spark, sf_dir), ["o_orderkey"]))


_BAG = "SELECT * FROM"


@query("snapshot_changes_bag", f"""{_SHOWN} (
    WITH a AS ({_BAG} ({_OLD})), b AS ({_BAG} ({_NEW})),
    gone AS (SELECT * FROM a EXCEPT ALL SELECT * FROM b), come AS (SELECT * FROM b EXCEPT ALL SELECT * FROM a)
    SELECT 'delete' AS _change_type, *, count(*) AS copies FROM gone GROUP BY ALL
    UNION ALL SELECT 'insert', *, count(*) FROM come GROUP BY ALL)""")
def bag(spark, sf_dir):
    return _shown(snapshot_changes_bag(*_snapshots(spark, sf_dir)))


_MAPS = [tm for tm in SALES_MAPS if tm.table == "orders"]


def _set_sql(rows):
    return distinct(" UNION ALL ".join(map_sql(tm, f"({rows})", _KINDS) for tm in _MAPS))


@query("graph_delta", f"""
    WITH a AS ({_set_sql(_OLD)}), b AS ({_set_sql(_NEW)})
    SELECT 'add' AS change, * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
    UNION ALL SELECT 'remove', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def delta_of_graph(spark, sf_dir):
    """Triples to add and remove after the change of the orders, from the rows behind each triple."""
    old, new = _snapshots(spark, sf_dir)
    graph, counts = count_rows(spark, _MAPS, {"orders": old})
    delta = graph_delta(spark, _MAPS, graph, counts, {"orders": snapshot_changes(old, new, ["o_orderkey"])})
    return delta.added.triples().select(F.lit("add").alias("change"), "*").unionByName(
        delta.removed.triples().select(F.lit("remove").alias("change"), "*"))
