"""Delimited register files: reading rules, file choice, refresh, manifest, sinks."""

import json

import pytest

from tripleloom.functions.ntriples import prefix_lines
from tripleloom.operators.batches import batch_count, with_batch
from tripleloom.operators.rules import ObjectMap, TriplesMap
from tripleloom.operators.triples import build_graph
from tripleloom.plans.register_mapping import OUTPUT_PREFIXES
from tripleloom.session import scratch_dir
from tripleloom.sources import bronze as B
from tripleloom.sources.sinks import write_ntriples, write_prefixes, write_triples
from tripleloom.sources.tables import table_counts, table_loader, write_tables

LOOKUPS = {"pais": B.SCHEMAS["pais"], "cnae": B.SCHEMAS["cnae"]}


def put(base, table, name, text):
    folder = base / "data" / table
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(text if isinstance(text, bytes) else text.encode())


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("text,expected", [
    ("1\n", ("1", None)), ("1;a;b;c\n", ("1", "a")), ("1;\n", ("1", None)), ('1;""\n', ("1", None)),
    ('1;"q""q"\n', ("1", '"q""q"')), ('"x;y";"z"\n', ("x;y", "z")), ("1;São\n", ("1", "São")),
    (b"1;S\xe3o\n", ("1", "S�o")), ("1; a \n", ("1", " a ")),
])
def test_field_rules(spark, tmp_path, text, expected):
    put(tmp_path, "pais", "x.pais.csv", text)
    assert rows(B.scan_files(spark, f"{tmp_path}/data/pais", LOOKUPS["pais"]).drop(B.SOURCE_FILE)) == [expected]


def test_newline_in_quotes_splits_the_record_unless_asked(spark, tmp_path):
    put(tmp_path, "pais", "pais.csv", '1;"a\nb"\n')
    folder = f"{tmp_path}/data/pais"
    assert len(rows(B.scan_files(spark, folder, LOOKUPS["pais"]))) == 2
    whole = B.scan_files(spark, folder, LOOKUPS["pais"], multiLine=True).drop(B.SOURCE_FILE)
    assert rows(whole) == [("1", "a\nb")]


def test_encoding_can_be_given(spark, tmp_path):
    put(tmp_path, "pais", "pais.csv", b"1;S\xe3o\n")
    got = B.scan_files(spark, f"{tmp_path}/data/pais", LOOKUPS["pais"], encoding="ISO-8859-1").drop(B.SOURCE_FILE)
    assert rows(got) == [("1", "São")]


def test_files_are_chosen_by_any_fragment_in_their_name(spark, tmp_path):
    for name in ("F.K0.PAISES.csv", "k3.SOCIOcsv", "moti.csv", "other.csv", "pai.csv"):
        put(tmp_path, "pais", name, f"{name};x\n")
    put(tmp_path, "pais/older", "pais.csv", "nested;x\n")
    got = B.scan_files(spark, f"{tmp_path}/data/pais", LOOKUPS["pais"])
    assert {r.COD_PAIS for r in got.collect()} == {"F.K0.PAISES.csv", "k3.SOCIOcsv", "moti.csv"}
    assert all(r.COD_PAIS == r[B.SOURCE_FILE] for r in got.collect())
    assert rows(B.list_files(spark, f"{tmp_path}/data", ["pais"])) == [
        ("pais", "F.K0.PAISES.csv"), ("pais", "k3.SOCIOcsv"), ("pais", "moti.csv")]


def test_unmatched_files_are_not_opened(spark, tmp_path):
    put(tmp_path, "pais", "pais.csv", "1;a\n")
    put(tmp_path, "pais", "other.csv", "2;b\n" * 1000)
    frame = B.scan_files(spark, f"{tmp_path}/data/pais", LOOKUPS["pais"])
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().apply(0)
    assert scan.metrics().apply("numFiles").value() == 1


def test_load_refresh_append_and_manifest(spark, tmp_path):
    put(tmp_path, "pais", "pais1.csv", "1;a\n2;b\n")
    put(tmp_path, "pais", "pais2.csv", "1;a\n")
    put(tmp_path, "pais", "pais3.csv", "")
    put(tmp_path, "cnae", "cnae.csv", "9;z\n")
    data, bronze = f"{tmp_path}/data", f"{tmp_path}/bronze"
    for _ in range(2):
        B.load_tables(spark, data, bronze, LOOKUPS)
        assert rows(B.read_table(spark, bronze, "pais")) == [("1", "a"), ("1", "a"), ("2", "b")]
    manifest = B.load_manifest(spark, data, bronze, LOOKUPS)
    assert rows(manifest) == [("cnae", "cnae.csv", 1), ("pais", "pais1.csv", 2), ("pais", "pais2.csv", 1),
                              ("pais", "pais3.csv", 0)]
    assert rows(B.load_totals(manifest)) == [("cnae", 1), ("pais", 3)]
    B.write_manifest(manifest, f"{tmp_path}/status")
    lines = [json.loads(x) for f in (tmp_path / "status/status").glob("part*") for x in f.read_text().splitlines()]
    assert {x["record_count"] for x in lines} == {0, 1, 2} and all(len(x["date"]) == 19 for x in lines)
    write_tables({"unlisted": spark.createDataFrame([("x",)], "v string")}, bronze)
    assert B.clear_tables(spark, bronze, keep=LOOKUPS) == ["unlisted"]
    assert B.read_table(spark, bronze, "pais").count() == 3
    assert B.clear_tables(spark, bronze) == ["cnae", "pais", "unlisted"]
    assert rows(table_counts({n: table_loader(spark, bronze)(n) for n in ("cnae", "pais", "unlisted")})) == [
        ("cnae", 0), ("pais", 0), ("unlisted", 0)]
    B.load_tables(spark, data, bronze, LOOKUPS, mode="append")
    B.load_tables(spark, data, bronze, LOOKUPS, mode="append")
    assert B.read_table(spark, bronze, "pais").count() == 6


def test_manifest_reads_only_the_file_column(spark, tmp_path):
    put(tmp_path, "pais", "pais1.csv", "1;a\n")
    B.load_tables(spark, f"{tmp_path}/data", f"{tmp_path}/bronze", {"pais": LOOKUPS["pais"]})
    manifest = B.load_manifest(spark, f"{tmp_path}/data", f"{tmp_path}/bronze", ["pais"])
    assert "ReadSchema: struct<_source_file:string>" in manifest._jdf.queryExecution().executedPlan().toString()


def test_scratch_folder_follows_the_cluster_setting(spark):
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: {"spark.checkpoint.dir": "hdfs://shared/scratch/"}.get(key, default))

    assert scratch_dir(Cluster, "x").startswith("hdfs://shared/scratch/x-")
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")


def test_batches(spark):
    assert [batch_count(n) for n in (0, 199_999, 200_000, 400_001)] == [1, 1, 2, 3]
    frame = with_batch(spark.range(10_000), batch_rows=1000)
    sizes = [r["count"] for r in frame.groupBy("batch").count().collect()]
    assert sum(sizes) == 10_000 and len(sizes) == 11 and max(sizes) < 1200
    again = with_batch(spark.range(10_000), batch_rows=1000)
    assert frame.exceptAll(again).count() == 0
    assert with_batch(spark.range(0)).count() == 0


def test_graph_sinks(spark, tmp_path):
    table = spark.range(1000).selectExpr("id", "concat('v', id % 7) AS v")
    tm = TriplesMap("m", "SELECT * FROM T", "http://n/{id}", objects=(ObjectMap(("http://n/p",), column="v"),))
    graph = build_graph(spark, [tm], {"T": table}).distinct()
    for _ in range(2):
        write_ntriples(graph, f"{tmp_path}/nt", max_lines_per_file=100)
    files = list((tmp_path / "nt").glob("part*"))
    texts = [f.read_text().splitlines() for f in files]
    assert max(map(len, texts)) <= 100 and sum(map(len, texts)) == 1000
    assert "<http://n/8> <http://n/p> \"v1\" ." in {x for t in texts for x in t}
    write_triples(graph, f"{tmp_path}/table")
    assert spark.read.parquet(f"{tmp_path}/table").columns == ["s", "p", "o", "o_kind", "o_datatype"]
    write_prefixes(spark, OUTPUT_PREFIXES, f"{tmp_path}/prefixes")
    head = next((tmp_path / "prefixes").glob("part*")).read_text().splitlines()
    assert head == prefix_lines(OUTPUT_PREFIXES) and len(head) == 16
    assert head[0] == "@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> ."
