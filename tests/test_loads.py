"""Loads that fail or end half-way."""

from collections import Counter

import pytest

from tripleloom import jobs
from tripleloom.catalog.standin import bronze_frames
from tripleloom.sources import bronze as B
from tripleloom.sources import loads
from tripleloom.sources.loads import finish, load_whole, pending, read_changes

SF = "/root/testdata/sf0.001"
FILES = {"razao_situacao": "moti", "nat_ju": "natj", "qualif_socio": "qual", "simei": "simples"}


@pytest.fixture(scope="module")
def frames(spark):
    return {name: frame.toPandas() for name, frame in bronze_frames(spark, SF).items()}


def write(frames, data, part=slice(None)):
    for name, frame in frames.items():
        (data / name).mkdir(parents=True, exist_ok=True)
        frame[part].to_csv(data / name / f"K.{FILES.get(name, name)}.csv", sep=";", header=False, index=False)


def state(tmp_path):
    """Every file outside the input with its content."""
    return {str(p.relative_to(tmp_path)): p.read_bytes() for p in tmp_path.rglob("*") if p.is_file() and "data" not in p.parts[len(tmp_path.parts)]}


def places(tmp_path):
    return [f"{tmp_path}/{x}" for x in ("data", "bronze", "status")]


def bag(frame):
    return Counter(map(tuple, frame.collect()))


def test_a_missing_folder_changes_nothing(spark, tmp_path, frames):
    write(frames, tmp_path / "data")
    jobs.load(spark, *places(tmp_path))
    before = state(tmp_path)
    write(frames, tmp_path / "data", slice(1))
    (tmp_path / "data" / "simei").rename(tmp_path / "data" / "elsewhere")
    with pytest.raises(Exception, match="simei"):
        jobs.load(spark, *places(tmp_path), changes_dir=f"{tmp_path}/changes")
    assert state(tmp_path) == before


def test_a_first_load_that_fails_leaves_nothing(spark, tmp_path, frames):
    write(frames, tmp_path / "data")
    (tmp_path / "data" / "simei").rename(tmp_path / "data" / "elsewhere")
    with pytest.raises(Exception, match="simei"):
        jobs.load(spark, *places(tmp_path))
    assert state(tmp_path) == {}


def test_a_key_that_is_not_unique_loses_no_changes(spark, tmp_path, frames):
    write(frames, tmp_path / "data", slice(5))
    jobs.load(spark, *places(tmp_path))
    before = state(tmp_path)
    write(frames, tmp_path / "data", slice(2, None))
    with pytest.raises(Exception, match="is not unique"):
        jobs.load(spark, *places(tmp_path), changes_dir=f"{tmp_path}/changes", keys={"empresa": ["COD_NAT_JURIDICA"]})
    assert state(tmp_path) == before
    jobs.load(spark, *places(tmp_path), changes_dir=f"{tmp_path}/changes", keys={"empresa": ["CNPJ_BASICO"]})
    kinds = Counter(r._change_type for r in read_changes(spark, f"{tmp_path}/changes", "empresa").collect())
    assert kinds == {"delete": 2, "insert": len(frames["empresa"]) - 5}
    assert {r._change_type for r in read_changes(spark, f"{tmp_path}/changes", "pais").collect()} == {"insert", "delete"}


@pytest.mark.parametrize("moves", [0, 3, 11, 15])
def test_a_load_that_ends_between_its_moves_is_finished_by_the_next(spark, tmp_path, frames, monkeypatch, moves):
    some = {n: frames[n] for n in ("pais", "empresa", "municipio", "cnae", "nat_ju")}
    schemas = {n: B.SCHEMAS[n] for n in some}
    write(some, tmp_path / "data", slice(5))
    load_whole(spark, *places(tmp_path), schemas)
    write(some, tmp_path / "data", slice(2, 9))
    left, real = [moves], loads._move

    def move(spark_, old, new):
        if "/.load-" in old and not left[0]:
            raise KeyboardInterrupt
        left[0] -= "/.load-" in old
        real(spark_, old, new)

    monkeypatch.setattr(loads, "_move", move)
    changes = f"{tmp_path}/changes"
    if moves < 12:
        with pytest.raises(KeyboardInterrupt):
            load_whole(spark, *places(tmp_path), schemas, changes_dir=changes)
        assert pending(spark, f"{tmp_path}/bronze")["changes"] == changes
    else:
        load_whole(spark, *places(tmp_path), schemas, changes_dir=changes)
    monkeypatch.undo()
    finish(spark, f"{tmp_path}/bronze")
    assert pending(spark, f"{tmp_path}/bronze") is None and finish(spark, f"{tmp_path}/bronze") is None
    for name in some:
        rows = B.read_table(spark, f"{tmp_path}/bronze", name)
        assert rows.count() == 7
        kinds = Counter(r._change_type for r in read_changes(spark, changes, name).collect())
        assert kinds["delete"] == 2 and kinds["insert"] == 4, name
    assert not [p for p in tmp_path.rglob("*") if ".load-" in p.name or "pending" in p.name]


def test_added_rows_are_inserts(spark, tmp_path, frames):
    some = {n: frames[n] for n in ("pais", "municipio")}
    schemas = {n: B.SCHEMAS[n] for n in some}
    write(some, tmp_path / "data", slice(5))
    load_whole(spark, *places(tmp_path), schemas)
    write(some, tmp_path / "data", slice(3, 9))
    load_id = load_whole(spark, *places(tmp_path), schemas, append=True, changes_dir=f"{tmp_path}/changes",
                         keys={"pais": ["COD_PAIS"]})
    for name in some:
        table = B.read_table(spark, f"{tmp_path}/bronze", name)
        assert bag(table) == bag(spark.createDataFrame(some[name][:5]).union(spark.createDataFrame(some[name][3:9])))
        changes = read_changes(spark, f"{tmp_path}/changes", name)
        assert {r._change_type for r in changes.collect()} == {"insert"} and changes.count() == 6
        assert ("copies" in changes.columns) == (name == "municipio")
    manifest = B.load_manifest(spark, f"{tmp_path}/data", f"{tmp_path}/bronze", schemas, load_id=load_id)
    assert {r.record_count for r in manifest.collect()} == {6}
    with pytest.raises(ValueError, match="delta"):
        load_whole(spark, *places(tmp_path), schemas, fmt="delta", append=True)


def test_a_refresh_empties_tables_that_are_not_listed(spark, tmp_path, frames):
    some = {n: frames[n] for n in ("pais", "municipio")}
    write(some, tmp_path / "data")
    load_whole(spark, *places(tmp_path), {n: B.SCHEMAS[n] for n in some})
    load_whole(spark, *places(tmp_path), {"pais": B.SCHEMAS["pais"]})
    assert B.read_table(spark, f"{tmp_path}/bronze", "municipio").count() == 0
    assert B.read_table(spark, f"{tmp_path}/bronze", "pais").count() == 25


def test_rejected_records_add_up_to_the_lines(spark, tmp_path):
    folder = tmp_path / "data/municipio"
    folder.mkdir(parents=True)
    lines = ["1;a", "2", "3;c;more", '4;"d;e"', "", "5;", "6;f", "2"]
    (folder / "K.municipio.csv").write_text("\n".join(lines) + "\n")
    (folder / "K.municipio2.csv").write_text("7;g\n8;h;i;j\n")
    schemas = {"municipio": B.SCHEMAS["municipio"]}
    found = {}
    for rejects in (False, True):
        base = tmp_path / str(rejects)
        load_whole(spark, f"{tmp_path}/data", f"{base}/bronze", f"{base}/status", schemas, rejects=rejects)
        found[rejects] = sorted(map(tuple, B.read_table(spark, f"{base}/bronze", "municipio").collect()), key=str)
    assert found[False] == found[True]  # the rows stay as they are
    assert ("2", None) in found[True] and ("3", "c") in found[True]
    status = tmp_path / "True/status"
    bad = spark.read.json(f"{status}/rejected")
    assert sorted((r.file, r.record) for r in bad.collect()) == [
        ("K.municipio.csv", "2"), ("K.municipio.csv", "2"), ("K.municipio.csv", "3;c;more"), ("K.municipio2.csv", "8;h;i;j")]
    counts = {r.file: (r.record_count, r.rejected_count) for r in spark.read.json(f"{status}/rejected_per_file").collect()}
    assert counts == {"K.municipio.csv": (7, 3), "K.municipio2.csv": (2, 1)}  # blank lines are no records
    assert B.rejected_records(spark, f"{tmp_path}/False/bronze", schemas).count() == 0
