import re
from collections import Counter

import pytest

from tripleloom.catalog import QUERIES
from tripleloom.catalog.maps import register_graph
from tripleloom.catalog.standin import CODES, bronze_frames
from tripleloom.operators.triples import Options, View, _queried, as_frame, build_graph, unique_subjects
from tripleloom.operators.rules import ObjectMap, TriplesMap
from tripleloom.plans.register_mapping import REGISTER_MAPS
from tripleloom.plans import silver
from tripleloom.plans.silver import FACETS, SILVER, fan_out, silver_tables, spread_tables, wide_frames

SF = "/root/testdata/sf0.001"


def bag(frame):
    return Counter(map(tuple, frame.collect()))


def scans(frame, table):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(rf"FileScan parquet [^\n]*{table}\.parquet", plan))


def test_the_whole_register_reads_partners_once_and_branches_three_times(spark):
    counts = register_graph(spark, SF).distinct().predicate_counts()
    reasons = bronze_frames(spark, SF)["razao_situacao"]  # the stand-in takes these from the branches' table
    uses = 2 * scans(reasons, "orders")
    assert scans(counts, "lineitem") == 1 and scans(counts, "orders") - uses <= 3


def test_views_give_the_graph_of_the_tables(spark):
    bronze = bronze_frames(spark, SF)
    maps = [m for m in REGISTER_MAPS if m.table in FACETS][::3] + [m for m in REGISTER_MAPS if m.table == "RFB_PESSOA"]
    options = Options(null_iri=None, constants=True)
    one = build_graph(spark, maps, fan_out(bronze, CODES), options).distinct()
    each = build_graph(spark, maps, silver_tables(bronze, CODES), options).distinct()
    assert set(one.shapes) == set(each.shapes) and set(one.notes) == set(each.notes)
    assert bag(one.triples()) == bag(each.triples())


@pytest.fixture(scope="module")
def spread(spark, tmp_path_factory):
    bronze = bronze_frames(spark, SF)
    return bronze, spread_tables(bronze, CODES, str(tmp_path_factory.mktemp("spread")))


def test_spread_tables_are_the_tables(spark, spread):
    bronze, tables = spread
    assert list(tables) == list(SILVER)
    for name, frame in tables.items():
        expected = SILVER[name](bronze, CODES)
        assert frame.dtypes == expected.dtypes and bag(frame) == bag(expected), name


def test_spread_tables_do_not_read_the_source_again(spark, spread):
    _, tables = spread
    assert all(scans(tables[name], "lineitem") + scans(tables[name], "orders") == 0 for name in FACETS)


def test_wide_frames_look_up_only_what_is_taken(spark):
    bronze = bronze_frames(spark, SF)
    plan = wide_frames(bronze, CODES, ["RFB_TEM_ESTABELECIMENTO"])["estabelecimento"]._jdf.queryExecution().toString()
    assert "Join" not in plan and "nation" not in plan


def test_maps_over_views(spark):
    """A flag takes rows out, a null flag too; two views make one table; subjects of both are not held to be unique."""
    base = spark.createDataFrame(
        [(1, "a", "x", True), (2, "b", None, False), (3, "c", "y", None)], "n int, p string, q string, flag boolean")
    tm = TriplesMap("t", "SELECT * FROM t", "http://e/{ID}", objects=(ObjectMap(("http://e/v",), column="V"),))
    both = {"t": [View(base, {"ID": "p", "V": "n"}, "flag"), View(base, {"ID": "q", "V": "p"})]}
    got = {(r.s, r.o) for r in build_graph(spark, [tm], both, Options(null_iri=None)).distinct().triples().collect()}
    assert got == {("http://e/A", "1"), ("http://e/X", "a"), ("http://e/Y", "c")}
    assert as_frame(both["t"]).count() == 4
    assert unique_subjects(spark, [tm], both) == frozenset()
    assert unique_subjects(spark, [tm], {"t": both["t"][:1]}) == {"t"}


def test_the_declared_register_reads_partners_once_too(spark):
    """Each map's own SQL used to scan its table by itself: partners eleven times, with a shuffle for each set of rows."""
    counts = QUERIES["register_declared"](spark, SF)
    reasons = bronze_frames(spark, SF)["razao_situacao"]
    assert scans(counts, "lineitem") == 1 and scans(counts, "orders") - 2 * scans(reasons, "orders") <= 3


def test_queries_over_views(spark):
    """A query that takes each row by itself shares the views' scan; others are run, over the same rows."""
    base = spark.createDataFrame(
        [(1, "a", "x", True), (2, "b", None, False), (3, "c", "y", None), (4, "d", "z", True)], "n int, p string, q string, flag boolean")
    both = {"t": [View(base, {"ID": "p", "n": "q", "V": "n"}, "flag"), View(base, {"ID": "q", "n": "p", "V": "n"})]}
    as_frame(both["t"]).createOrReplaceTempView("t")
    alone = ["SELECT * FROM t", "SELECT ID, t.V FROM t", "SELECT id, CASE n WHEN 'x' THEN 'one' END AS V FROM t",
             "SELECT *, CONCAT(ID, '-', n) AS W FROM t", "SELECT V AS ID, ID AS V FROM t", "select\n `ID` , v+1 v from T"]
    others = ["SELECT * FROM t WHERE V > 1", "SELECT ID, V FROM t AS u", "SELECT max(ID) AS ID, max(V) AS V FROM t",
              "SELECT DISTINCT ID, V FROM t", "SELECT ID, max(V) OVER (PARTITION BY 1) AS V FROM t",
              "SELECT ID, explode(array(V, V + 7)) AS V FROM t", "SELECT ID, (SELECT max(V) FROM t) AS V FROM t",
              "SELECT ID, V FROM t ORDER BY V LIMIT 2"]
    for sql in alone + others:
        maps = [TriplesMap(name, sql, f"http://e/{name}/{{ID}}", ("http://e/C",), (
            ObjectMap(("http://e/v",), column="V"), ObjectMap(("http://e/w",), column="W")), "t") for name in ("m", "k")]
        shared = build_graph(spark, maps, both, Options(source="query"))
        run = build_graph(spark, maps, lambda name: spark.table(name), Options(source="query"))
        assert set(shared.notes) == set(run.notes) and set(shared.shapes) == set(run.shapes), sql
        assert bag(shared.distinct().triples()) == bag(run.distinct().triples()), sql
        assert bool(_queried(spark, maps, both)) == (sql in alone), sql


def test_a_table_that_the_scan_splits_is_not_dealt(spark, monkeypatch):
    """Dealing tables of up to 128 MB a core sorted and shuffled all their rows into tasks that grew with the table."""
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    assert silver.dealt(orders) is not orders
    size = spark.sparkContext.defaultParallelism * 4 * 1024 * 1024
    monkeypatch.setattr(silver, "planned_bytes", lambda frame: size)
    assert silver.dealt(orders) is orders
