"""Graphs kept up to date by change sets."""

import pytest

from tripleloom.operators.changes import snapshot_changes, snapshot_changes_bag
from tripleloom.operators.delta import compact, count_rows, current, graph_delta
from tripleloom.operators.rules import ObjectMap, TriplesMap
from tripleloom.operators.triples import build_graph

MAPS = (
    TriplesMap("people", "SELECT * FROM t", "http://e/{ID}", classes=("http://e/Person",),
               objects=(ObjectMap(("http://e/name",), column="NAME"),)),
    TriplesMap("towns", "SELECT * FROM t", "http://t/{TOWN}", classes=("http://t/Town",),
               objects=(ObjectMap(("http://e/in",), column="LAND"),)),
    TriplesMap("lands", "SELECT * FROM u", "http://t/{TOWN}", classes=("http://t/Town",)),
)
T, U = "ID string, NAME string, TOWN string, LAND string", "TOWN string"


def frames(spark, t, u):
    return {"t": spark.createDataFrame(t, T), "u": spark.createDataFrame(u, U)}


def triples(graph):
    return sorted(map(tuple, graph.triples().collect()))


OLD = [("1", "a", "x", "l"), ("2", "b", "x", "l"), ("3", None, "y", "m"), ("4", "d", "z", ""), (None, "e", None, "l")]
NEW = [("1", "a", "x", "l"), ("2", "B", "y", "m"), ("4", "d", "z", "n"), ("5", "f", "w", "l")]
KEYED = {"t": lambda a, b: snapshot_changes(a, b, ["ID"]), "u": lambda a, b: snapshot_changes(a, b, ["TOWN"])}
COPIES = {"t": snapshot_changes_bag, "u": snapshot_changes_bag}


@pytest.mark.parametrize("made", [KEYED, COPIES], ids=["keyed", "copies"])
def test_old_graph_and_delta_give_the_rebuilt_graph(spark, made):
    steps = [(OLD, [("y",)]), (NEW, []), ([], [("z",)]), (OLD, [("y",)])]
    if made is COPIES:
        steps = [(t * 3 if i % 2 else t, u * 2) for i, (t, u) in enumerate(steps)]
    old = frames(spark, *steps[0])
    graph, stored = count_rows(spark, MAPS, old)
    for t, u in steps[1:]:
        new = frames(spark, t, u)
        delta = graph_delta(spark, MAPS, graph, stored, {k: made[k](old[k], new[k]) for k in old})
        before, after = (set(triples(build_graph(spark, MAPS, x).distinct())) for x in (old, new))
        assert triples(delta.added) == sorted(after - before)
        assert triples(delta.removed) == sorted(before - after)
        stored = spark.createDataFrame(stored.unionByName(delta.rows).collect(), "shape int, s string, o string, n long")
        assert triples(current(graph, stored)) == sorted(after)
        old = new
    counted = count_rows(spark, MAPS, old)[1]
    assert sorted(map(tuple, compact(stored).collect())) == sorted(map(tuple, counted.collect()))


def test_overlapping_prefixes(spark):
    maps = (TriplesMap("a", "SELECT * FROM u", "http://t/{TOWN}", classes=("http://c",)),
            TriplesMap("b", "SELECT * FROM u", "http://t/X{TOWN}", classes=("http://c",)))
    old, new = (spark.createDataFrame(rows, U) for rows in ([("XA",), ("B",)], [("A",), ("B",)]))
    graph, stored = count_rows(spark, maps, {"u": old})
    delta = graph_delta(spark, maps, graph, stored, {"u": snapshot_changes_bag(old, new)})
    assert [t[0] for t in triples(delta.added)] == ["http://t/A"] and [t[0] for t in triples(delta.removed)] == ["http://t/XXA"]


def test_changes_that_do_not_belong(spark):
    old = frames(spark, OLD, [])
    graph, stored = count_rows(spark, MAPS, old)
    twice = {k: snapshot_changes_bag(v.union(v).union(v), v.limit(0)) for k, v in old.items()}
    with pytest.raises(Exception, match="take away rows"):
        graph_delta(spark, MAPS, graph, stored, twice).removed.triples().collect()
    with pytest.raises(ValueError, match="columns"):
        graph_delta(spark, MAPS, graph, stored, {k: v.drop("NAME") for k, v in twice.items()})
