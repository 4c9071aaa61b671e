"""Graphs written in committed passes."""

import json

import pytest

from tripleloom import jobs, session
from tripleloom.operators.rules import ObjectMap, TriplesMap
from tripleloom.operators.triples import Options, build_graph
from tripleloom.sources import passes as module
from tripleloom.sources.passes import write_in_passes

PEOPLE = TriplesMap("people", "SELECT * FROM t", "http://e/{ID}", classes=("http://e/Person",),
                    objects=(ObjectMap(("http://e/name",), column="NAME"),))
TOWNS = TriplesMap("towns", "SELECT * FROM t", "http://t/{TOWN}", classes=("http://t/Town",))
MAPS = (PEOPLE, TOWNS)
OPTIONS = Options(null_iri=None)


@pytest.fixture
def tables(spark, tmp_path):
    rows = [(str(i % 90), f"name {i}", None if i % 4 == 0 else f"town {i % 3}") for i in range(100)]
    spark.createDataFrame(rows, "ID string, NAME string, TOWN string").repartition(5).write.parquet(f"{tmp_path}/t")
    return {"t": spark.read.parquet(f"{tmp_path}/t")}


def lines(spark, path):
    return sorted(r.value for r in spark.read.text(str(path)).collect())


def files(folder):
    return {p.name: p.stat().st_mtime_ns for p in folder.iterdir()}


def test_a_killed_run_goes_on_where_it_ended(spark, tables, tmp_path, monkeypatch):
    want = sorted(r.value for r in build_graph(spark, MAPS, tables, OPTIONS).distinct().lines().collect())
    out, real, done = tmp_path / "out/triples", module._commit, []

    def dying(spark, fresh, place):
        if len(done) == 2:
            raise KeyboardInterrupt
        done.append(place)
        real(spark, fresh, place)

    monkeypatch.setattr(module, "_commit", dying)
    with pytest.raises(KeyboardInterrupt):
        write_in_passes(spark, MAPS, tables, str(out), OPTIONS, passes=4)
    before = {p: files(out / p) for p in ("pass=0", "pass=1")}
    staged = files(out / "_staged")
    assert not (out / "pass=2").exists() and len(lines(spark, out)) < len(want)
    monkeypatch.setattr(module, "_commit", real)
    monkeypatch.setattr(module, "stage", lambda *given: pytest.fail("the tables were scanned again"))
    assert staged
    graph, watch = write_in_passes(spark, MAPS, tables, str(out), OPTIONS, passes=4)
    assert {p: files(out / p) for p in ("pass=0", "pass=1")} == before
    assert lines(spark, out) == want and not (out / "_staged").exists()
    assert watch.written()["lines"] == watch.written()["triples"] == len(want)
    assert watch.subjects() == {"people": (100, 100), "towns": (100, 75)}
    write_in_passes(spark, MAPS, tables, str(out), OPTIONS, passes=4)  # all passes are there
    assert lines(spark, out) == want


def test_other_work_starts_anew(spark, tables, tmp_path):
    out = tmp_path / "out"
    write_in_passes(spark, MAPS, tables, str(out), OPTIONS, passes=3)
    write_in_passes(spark, (TOWNS,), tables, str(out), OPTIONS, passes=2)
    want = sorted(r.value for r in build_graph(spark, (TOWNS,), tables, OPTIONS).distinct().lines().collect())
    assert lines(spark, out) == want and sorted(p.name for p in out.glob("pass=*")) == ["pass=0", "pass=1"]
    with pytest.raises(ValueError):
        write_in_passes(spark, MAPS, tables, str(out), OPTIONS, passes=0)


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "ID string, NAME string, TOWN string").write.parquet(f"{tmp_path}/t")
    tables = {"t": spark.read.parquet(f"{tmp_path}/t")}
    _, watch = write_in_passes(spark, MAPS, tables, f"{tmp_path}/out", OPTIONS, passes=2)
    assert lines(spark, tmp_path / "out") == [] and watch.written()["lines"] == 0


def test_publish_in_passes_reports_like_publish_at_once(spark, tables, tmp_path):
    reports, written = [], []
    for name, passes in (("once", None), ("passes", 3)):
        out = tmp_path / name
        reports.append(sorted(map(tuple, jobs.publish(spark, MAPS, tables, str(out), OPTIONS, verify=True, passes=passes).collect())))
        written += [json.loads(x) for f in (out / "written").glob("part*") for x in f.read_text().splitlines()]
    assert reports[0] == reports[1] and written[0] == written[1]
    assert lines(spark, tmp_path / "once/triples") == lines(spark, tmp_path / "passes/triples")


def test_passes_bound_the_planned_bytes_of_a_task(monkeypatch):
    total = 100 * 10**12
    monkeypatch.setattr(session, "planned_bytes", lambda frame: total)
    passes = session.passes_needed([None], growth=jobs.TRIPLE_GROWTH)
    assert total * jobs.TRIPLE_GROWTH / passes / session.MOST_PARTITIONS <= session.MOST_TASK_BYTES
    monkeypatch.setattr(session, "planned_bytes", lambda frame: 10**12)
    assert session.passes_needed([None], growth=jobs.TRIPLE_GROWTH) == 1


def test_passes_stage_a_row_per_subject_and_compress_lines(spark, tables, tmp_path, monkeypatch):
    """Staging held every triple as a row, sorted by pass, and the lines could not be compressed."""
    staged = []
    real = module.stage

    def watched(graph, path, passes):
        real(graph, path, passes)
        staged.append((spark.read.parquet(path).count(), spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")))

    monkeypatch.setattr(module, "stage", watched)
    write_in_passes(spark, MAPS, tables, f"{tmp_path}/z", OPTIONS, passes=3, compression="gzip")
    assert staged == [(100 + 75, "0")]  # two triples of each person are one row
    want = sorted(r.value for r in build_graph(spark, MAPS, tables, OPTIONS).distinct().lines().collect())
    assert lines(spark, tmp_path / "z") == want
    assert {f.suffix for f in tmp_path.glob("z/pass=*/part*")} == {".gz"}


def test_overlapping_prefixes_are_staged_as_triples(spark, tmp_path):
    spark.createDataFrame([("AB", "B")] * 3, "a string, b string").write.parquet(f"{tmp_path}/t")
    maps = [TriplesMap("one", "SELECT * FROM t", "http://e/{a}", classes=("http://e/C",)),
            TriplesMap("two", "SELECT * FROM t", "http://e/A{b}", classes=("http://e/C",))]
    write_in_passes(spark, maps, {"t": spark.read.parquet(f"{tmp_path}/t")}, f"{tmp_path}/out", passes=2)
    assert len(lines(spark, tmp_path / "out")) == 1
