"""Inputs that once lost or merged rows, each through the public entry."""

import pytest
from pyspark.sql import functions as F

from tripleloom import jobs
from tripleloom.operators.rules import ObjectMap, TriplesMap, first_table
from tripleloom.operators.triples import Options, build_graph, reconcile
from tripleloom.plans.silver import SILVER, Codes
from tripleloom.session import MOST_PARTITIONS, fit_shuffle, scratch_dir
from tripleloom.sources import bronze as B
from tripleloom.sources.tables import previous_path, write_tables

CODES = Codes(head_office="1", company="1", person="2", foreigner="3", opted="S", home_country="BRASIL")


def bronze(spark, **given):
    """Bronze tables with the given rows, each a mapping of its columns."""
    return {name: spark.createDataFrame(
        [tuple(r.get(c) for c in schema.names) for r in given.get(name, [])],
        ", ".join(f"{c} string" for c in schema.names)) for name, schema in B.SCHEMAS.items()}


def silver(spark, name, **given):
    return SILVER[name](bronze(spark, **given), CODES)


def test_partners_without_number_stay_apart(spark):
    rows = [{"CNPJ_BASICO": "1", "TIPO_SOCIO": "1", "NOME_SOCIO": n} for n in ("ANA SA", "BIA SA")]
    found = silver(spark, "RFB_SOCIEDADE_COM_HOLDING", socio=rows).collect()
    assert {(r.ID_SOCIEDADE, r.ID_SOCIO) for r in found} == {("1_ANA SA", "ANA SA"), ("1_BIA SA", "BIA SA")}
    assert silver(spark, "RFB_TEM_SOCIEDADE_JURIDICA", socio=rows).count() == 2


def test_missing_parts_keep_their_place(spark):
    rows = [{"CNPJ_BASICO": "1", "SITUACAO": "A", "DATA_SITUACAO": "B"}, {"CNPJ_BASICO": "1", "SITUACAO": "A", "MOTIVO_SITUACAO": "B"}]
    ids = {r.ID_SITUACAO_CADASTRAL for r in silver(spark, "RFB_SITUACAO_CADASTRAL", estabelecimento=rows).collect()}
    assert ids == {"A_B_", "A__B"}


def test_telephones_without_area_code(spark):
    rows = [{"CNPJ_BASICO": "1", "CNPJ_ORDEM": "2", "CNPJ_DV": "3", "TELEFONE_1": "555", "DDD_2": "85"}]
    row = silver(spark, "RFB_ESTABELECIMENTO", estabelecimento=rows).first()
    assert (row.TELEFONE_1, row.TELEFONE_2, row.FAX) == ("555", None, None)


def test_both_tax_options_are_linked(spark):
    found = silver(spark, "RFB_EMPRESA", empresa=[{"CNPJ_BASICO": "1"}, {"CNPJ_BASICO": "2"}],
                   simei=[{"CNPJ_BASICO": "1", "OPC_SIMPLES": "S", "OPC_MEI": "S"}]).collect()
    assert {(r.CNPJ_RAIZ, r.ID_OPCAO_SIMPLES) for r in found} == {("1", "1_MEI"), ("1", "1_SIMPLES"), ("2", None)}


def test_activity_codes_are_trimmed(spark):
    rows = [{"CNPJ_BASICO": "1", "CNPJ_ORDEM": "2", "CNPJ_DV": "3", "CNAE_FISCAL_SEC": "1, 2,, 3 ,"}]
    found = silver(spark, "RFB_TEM_ATIV_ECONOMICA_SECUNDARIA", estabelecimento=rows).collect()
    assert sorted(r.CNAE for r in found) == ["1", "2", "3"]


def put(base, table, name, text):
    folder = base / "data" / table
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(text)


PAIS = {"pais": B.SCHEMAS["pais"]}


def test_manifest_of_odd_names_and_of_one_load(spark, tmp_path):
    put(tmp_path, "pais", "pais 1.csv", b"1;a\n2;b\n")
    put(tmp_path, "pais", "100%+pais.csv", b"3;c\n")
    data, out = f"{tmp_path}/data", f"{tmp_path}/bronze"
    B.load_tables(spark, data, out, PAIS)
    second = B.load_tables(spark, data, out, PAIS, mode="append")
    assert {(r.file, r.record_count) for r in B.load_manifest(spark, data, out, PAIS, load_id=second).collect()} == {
        ("pais 1.csv", 2), ("100%+pais.csv", 1)}
    (tmp_path / "data/pais/pais 1.csv").rename(tmp_path / "data/pais/elsewhere.csv")
    with pytest.raises(Exception, match="not in the folder"):
        B.load_manifest(spark, data, out, PAIS, load_id=second).collect()


def test_a_failed_refresh_leaves_the_old_rows(spark, tmp_path):
    put(tmp_path, "pais", "pais.csv", b"1;a\n")
    data, out = f"{tmp_path}/data", f"{tmp_path}/bronze"
    B.load_tables(spark, data, out, PAIS)
    with pytest.raises(Exception):
        B.load_tables(spark, data, out, PAIS, mode="overwrite", encoding="no such encoding")
    assert B.read_table(spark, out, "pais").collect()[0].NOME_PAIS == "a"
    broken = spark.range(1).select(F.raise_error(F.lit("no")).cast("string").alias("v"))
    with pytest.raises(Exception):
        write_tables({"pais": broken}, out)
    assert B.read_table(spark, out, "pais").count() == 1
    # A job that ended between the two renames: the next call starts from the rows that were there.
    (tmp_path / "bronze/pais").rename(previous_path(f"{out}/pais"))
    B.load_tables(spark, data, out, PAIS, keep_previous=True)
    assert spark.read.parquet(previous_path(f"{out}/pais")).count() == 1


def test_clearing_skips_what_is_no_table(spark, tmp_path):
    (tmp_path / "bronze/status").mkdir(parents=True)
    (tmp_path / "bronze/status/notes.txt").write_text("x")
    write_tables({"old": spark.range(3)}, f"{tmp_path}/bronze")
    assert B.clear_tables(spark, f"{tmp_path}/bronze") == ["old"]


def test_job_options_and_changes(spark, tmp_path, monkeypatch, capsys):
    for name in B.SCHEMAS:
        put(tmp_path, name, f"{name}.empr.csv", b"")
    put(tmp_path, "pais", "pais.csv", b"1;S\xe3o\n2;b\n")
    monkeypatch.setattr(jobs.SparkSession.builder.__class__, "getOrCreate", lambda self: spark, raising=False)
    args = ["load", "--data", f"{tmp_path}/data", "--bronze", f"{tmp_path}/bronze", "--status", f"{tmp_path}/status",
            "--encoding", "ISO-8859-1", "--changes", f"{tmp_path}/changes", "--key", "pais=COD_PAIS"]
    jobs.main([*args, "--preview"])
    assert "São" in capsys.readouterr().out
    put(tmp_path, "pais", "pais.csv", b"1;S\xe3o\n2;c\n3;d\n")
    jobs.main(args)
    changes = {(r._change_type, r.COD_PAIS, r.NOME_PAIS) for r in spark.read.parquet(f"{tmp_path}/changes/pais").collect()}
    assert changes == {("update_preimage", "2", "b"), ("update_postimage", "2", "c"), ("insert", "3", "d")}
    assert not (tmp_path / "bronze/.pais-previous").exists()
    jobs.main([*args[:7], "--append"])
    assert B.read_table(spark, f"{tmp_path}/bronze", "pais").count() == 6


@pytest.mark.parametrize("sql,name", [
    ("SELECT * FROM (SELECT a FROM t) x", "t"), ("select a from T, U", "T"), ("SELECT a FROM t;", "t"),
    ("SELECT a FROM `odd name`", "odd name"), ("SELECT 'x FROM y' AS a FROM t", "t"), ("SELECT * FROM t", "t"),
    ("WITH x AS (SELECT * FROM t) SELECT * FROM x", "t"), ("SELECT 1 AS a", None), ("SELECT a FROM db.t WHERE a IN (SELECT b FROM u)", "db.t")])
def test_table_of_a_query(spark, sql, name):
    assert first_table(sql.rstrip(";")) == name


def test_reconcile_counts_what_the_graph_reads(spark):
    spark.range(10).selectExpr("id AS k", "IF(id < 3, NULL, id) AS n").createOrReplaceTempView("ten")
    half = TriplesMap("half", "SELECT k, n FROM ten WHERE k < 5", "http://e/{k}", (), (ObjectMap(("http://p",), column="n"),))
    nulls = TriplesMap("nulls", "SELECT * FROM ten", "http://e/{n}", ("http://c",))
    both = [half, nulls]
    report = {r.map: (r.rows_in, r.rows_with_subject, r.difference)
              for r in reconcile(spark, both, spark.table, Options(source="query", null_iri=None)).collect()}
    assert report == {"half": (10, 5, 5), "nulls": (10, 7, 3)}
    partial = TriplesMap("part", "SELECT * FROM ten", "http://e/{k}/{absent}", ("http://c",))
    for run in (reconcile, build_graph):
        with pytest.raises(ValueError):
            run(spark, [partial], spark.table)


def test_shuffles_are_bounded_and_scratch_is_shared(spark, monkeypatch):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr("tripleloom.session.planned_bytes", lambda frame: 100 * 10**12)
    try:
        assert fit_shuffle(spark, [spark.range(1)], growth=8) == MOST_PARTITIONS
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Cluster.conf)

    with pytest.raises(ValueError, match="checkpoint"):
        scratch_dir(Cluster, "x")


def test_unique_keys_are_not_counted(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = [{"CNPJ_BASICO": str(i), "COD_NAT_JURIDICA": "1"} for i in range(9)]
        heads = [{"CNPJ_BASICO": "3", "CNPJ_ORDEM": "1", "CNPJ_DV": "0", "MATRIZ_FILIAL": "1"}]
        frame = silver(spark, "RFB_EMPRESA", empresa=rows, estabelecimento=heads, nat_ju=[{"CODIGO": "1", "NATUREZA_JURIDICA": "SA"}])
        assert frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 8
        assert {(r.CNPJ_RAIZ, r.ID_ESTABELECIMENTO_MATRIZ) for r in frame.collect() if r.NATUREZA_JURIDICA == "SA"} == {
            (str(i), "310" if i == 3 else None) for i in range(9)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
