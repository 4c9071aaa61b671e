"""Reconciliation by what the writing run counted."""

import json

import pytest

from tripleloom import jobs
from tripleloom.operators import triples as module
from tripleloom.operators.rules import ObjectMap, TriplesMap
from tripleloom.operators.triples import Graph, Options, View, Watch, build_graph, reconcile_watched
from tripleloom.sources.sinks import stored_lines, write_ntriples

PEOPLE = TriplesMap("people", "SELECT * FROM t", "http://e/{ID}", classes=("http://e/Person",),
                    objects=(ObjectMap(("http://e/name",), column="NAME"),))
TOWNS = TriplesMap("towns", "SELECT * FROM t", "http://t/{TOWN}", classes=("http://t/Town",))
ABSENT = TriplesMap("absent", "SELECT * FROM t", "http://t/{NONE}", classes=("http://t/Town",))


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(str(i), f"name {i}", None if i % 4 == 0 else f"town {i % 3}") for i in range(100)]
    return {"t": spark.createDataFrame(rows, "ID string, NAME string, TOWN string").repartition(5)}


def report(spark, tables, path, options=Options(null_iri=None), maps=(PEOPLE, TOWNS, ABSENT)):
    rows = jobs.publish(spark, maps, tables, str(path), options, verify=True)
    line, = [json.loads(x) for f in (path / "written").glob("part*") for x in f.read_text().splitlines()]
    return {r.map: (r.rows_in, r.rows_with_subject, r.difference) for r in rows.collect()}, line


def test_counts_of_a_whole_run(spark, tables, tmp_path):
    rows, line = report(spark, tables, tmp_path)
    assert rows == {"people": (100, 100, 0), "towns": (100, 75, 25), "absent": (100, 0, 100)}
    assert line["triples"] == line["lines"] == line["stored_lines"] == 203 and line["difference"] == 0 and line["verified"]
    rows, _ = report(spark, tables, tmp_path / "none", Options())
    assert rows["towns"] == (100, 100, 0)


def test_rows_lost_before_the_triples_show(spark, tables, tmp_path, monkeypatch):
    real = module._Compiler.encoded

    def lossy(self, *given):
        self.frame = self.frame.filter("ID <> '7'")
        return real(self, *given)

    monkeypatch.setattr(module._Compiler, "encoded", lossy)
    rows, line = report(spark, tables, tmp_path)
    assert rows["people"] == (100, 99, 1) and line["difference"] == 0


def test_lines_lost_before_the_sink_show(spark, tables, tmp_path, monkeypatch):
    real = Graph.lines
    monkeypatch.setattr(Graph, "lines", lambda self: real(self).filter("NOT value LIKE '%name 7\"%'"))
    rows, line = report(spark, tables, tmp_path)
    assert rows["people"] == (100, 100, 0) and (line["triples"], line["lines"], line["difference"]) == (203, 202, 1)


def test_files_lost_after_the_run_show(spark, tables, tmp_path):
    watch = Watch()
    write_ntriples(build_graph(spark, [PEOPLE, TOWNS], tables, watch=watch).distinct(), f"{tmp_path}/x")
    assert stored_lines(spark, f"{tmp_path}/x").items() <= watch.written().items()
    next(p for p in (tmp_path / "x").glob("part*") if p.stat().st_size).unlink()
    found = stored_lines(spark, f"{tmp_path}/x")
    assert found["lines"] < watch.written()["lines"] and found["checksum"] != watch.written()["checksum"]


def test_views_unique_subjects_and_empty_tables(spark, tables, tmp_path):
    base = spark.createDataFrame([(1, "a", True), (2, "b", False), (3, "c", None)], "n int, p string, flag boolean")
    views = {"t": [View(base, {"ID": "p", "NAME": "n"}, "flag"), View(base, {"ID": "n", "NAME": "p"})]}
    watch = Watch()
    write_ntriples(build_graph(spark, [PEOPLE], views, watch=watch).distinct(), f"{tmp_path}/v")
    assert [tuple(r) for r in reconcile_watched(spark, [PEOPLE], views, watch).collect()] == [("t", "people", 4, 4, 0)]
    watch = Watch()  # a map whose triples stay out of the shuffle is scanned in two parts and counted in one
    graph = build_graph(spark, [PEOPLE, TOWNS], tables, Options(null_iri=None), frozenset(["people"]), watch)
    write_ntriples(graph.distinct(), f"{tmp_path}/u")
    assert watch.subjects() == {"people": (100, 100), "towns": (100, 75)} and watch.written()["triples"] == 203
    none = {"t": tables["t"].limit(0)}
    rows, line = report(spark, none, tmp_path / "e")
    assert set(rows.values()) == {(0, 0, 0)} and line["lines"] == 0


def test_rows_without_any_subject(spark, tmp_path):
    """Spark leaves out parts of a plan that turn out empty, and their counts with them."""
    for name, key in (("t", None), ("u", "1")):
        spark.createDataFrame([(key, "x")] * 50, "TOWN string, NAME string").write.parquet(f"{tmp_path}/{name}")
    tables = {name: spark.read.parquet(f"{tmp_path}/{name}") for name in "tu"}
    other = TriplesMap("other", "SELECT * FROM u", "http://u/{TOWN}", classes=("http://t/Town",))
    assert report(spark, tables, tmp_path / "one", maps=[TOWNS])[0] == {"towns": (50, 0, 50)}
    rows, line = report(spark, tables, tmp_path / "two", maps=[TOWNS, other])
    assert rows == {"towns": (50, 0, 50), "other": (50, 50, 0)} and line["stored_lines"] == 1
