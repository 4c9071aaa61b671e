"""The register's mapping has the published number of maps, rules and classes."""

from collections import Counter

from pyspark.sql import functions as F

from tripleloom.operators.rules import Template, rules_frame
from tripleloom.operators.triples import Options, build_graph, unique_subjects
from tripleloom.plans.register_mapping import (
    MAPPING_PREFIXES, OUTPUT_PREFIXES, REGISTER_MAPS, STATE_CODES, label_sql, state_code_sql)
from tripleloom.plans.silver import SILVER, Codes, dashed, silver_tables, state_code, state_name
from tripleloom.sources.bronze import SCHEMAS
from tripleloom.sources.tables import register_views

CODES = Codes(head_office="1", company="1", person="2", foreigner="3", opted="S", home_country="BRASIL")


def test_counts():
    objects = [o for m in REGISTER_MAPS for o in m.objects]
    assert len(REGISTER_MAPS) == 22 and len({m.table for m in REGISTER_MAPS}) == 19
    assert Counter(o.kind for o in objects) == {"column": 44, "template": 36, "constant": 1}
    assert sum(len(o.predicates) for o in objects) == 97
    assert sum(len(m.classes) for m in REGISTER_MAPS) == 35
    types = Counter((o.datatype or "none").rsplit("#")[-1] for o in objects if o.kind == "column")
    assert types == {"string": 30, "date": 11, "double": 1, "anyURI": 1, "none": 1}
    assert set(SILVER) == {m.table for m in REGISTER_MAPS}
    assert len(OUTPUT_PREFIXES) == 16 and len(MAPPING_PREFIXES) == 14 and len(STATE_CODES) == 27
    assert sum(len(s) for s in SCHEMAS.values()) == 67


def test_rules_as_a_table(spark):
    kinds = {r.kind: r["count"] for r in rules_frame(spark, REGISTER_MAPS).groupBy("kind").count().collect()}
    assert kinds == {"class": 35, "column": 54, "template": 42, "constant": 1}


def empty_bronze(spark, **rows):
    frames = {}
    for name, schema in SCHEMAS.items():
        given = [tuple(r.get(c) for c in schema.names) for r in rows.get(name, [])]
        frames[name] = spark.createDataFrame(given, ", ".join(f"{c} string" for c in schema.names))
    return frames


def test_silver_tables_have_every_column_the_mapping_reads(spark):
    tables = silver_tables(empty_bronze(spark), CODES)
    for m in REGISTER_MAPS:
        known = {c.lower() for c in tables[m.table].columns}
        needed = {v.lower() for v in Template(m.subject).variables}
        for o in m.objects:
            needed |= {o.column.lower()} if o.kind == "column" else set()
            needed |= {v.lower() for v in Template(o.template).variables} if o.kind == "template" else set()
        assert needed <= known, (m.name, needed - known)
    graph = build_graph(spark, REGISTER_MAPS, tables)
    assert [n.reason for n in graph.notes] == ["constant objects are off"]
    assert graph.distinct().triples().count() == 0
    # Encoded, not whole: the shuffle moves keys only.
    assert all(shape.subject for shape in graph.shapes)


def test_silver_edge_rows(spark):
    bronze = empty_bronze(
        spark,
        empresa=[{"CNPJ_BASICO": "1", "RAZAO_SOCIAL": "A", "CAPITAL_SOCIAL": "10,50", "COD_NAT_JURIDICA": "9"},
                 {"CNPJ_BASICO": "2", "RAZAO_SOCIAL": "B", "CAPITAL_SOCIAL": "x"}],
        estabelecimento=[
            {"CNPJ_BASICO": "1", "CNPJ_ORDEM": "01", "CNPJ_DV": "0", "MATRIZ_FILIAL": "1", "UF": "MS",
             "DATA_INICIO_ATIV": "00000000", "CNAE_FISCAL_SEC": "5,7"},
            {"CNPJ_BASICO": "1", "CNPJ_ORDEM": "02", "CNPJ_DV": "0", "MATRIZ_FILIAL": "1", "NM_CIDADE_EXTERIOR": "X",
             "COD_PAIS": "99"},
            {"CNPJ_BASICO": "3", "CNPJ_ORDEM": "01", "CNPJ_DV": "0", "MATRIZ_FILIAL": "2", "DATA_INICIO_ATIV": "20200131"}],
        nat_ju=[{"CODIGO": "9", "NATUREZA_JURIDICA": "one"}, {"CODIGO": "9", "NATUREZA_JURIDICA": "two"}],
        socio=[{"CNPJ_BASICO": "1", "TIPO_SOCIO": "1", "CNPJ_CPF_SOCIO": "12345678000199", "NOME_SOCIO": "H"},
               {"CNPJ_BASICO": "1", "TIPO_SOCIO": "2", "CNPJ_CPF_SOCIO": "***1", "NOME_SOCIO": "P", "FAIXA_ETARIA": "4",
                "CPF_REPRES": "***2", "NOME_REPRES": "R"}],
        simei=[{"CNPJ_BASICO": "1", "OPC_SIMPLES": "S", "OPC_MEI": "S", "DATA_OPC_MEI": "20100101"},
               {"CNPJ_BASICO": "2", "OPC_SIMPLES": "N", "DATA_OPC_SIMPLES": "20110101"}],
    )
    t = silver_tables(bronze, CODES)
    company = {r.CNPJ_RAIZ: r for r in t["RFB_EMPRESA"].collect()}
    assert len(company) == 2 and company["1"].CAPITAL_SOCIAL == 10.5 and company["2"].CAPITAL_SOCIAL is None
    assert company["1"].ID_ESTABELECIMENTO_MATRIZ == "1010" and company["1"].NATUREZA_JURIDICA == "one"
    assert {(r.CNPJ_RAIZ, r.ID_OPCAO_SIMPLES) for r in t["RFB_EMPRESA"].collect()} == {
        ("1", "1_MEI"), ("1", "1_SIMPLES"), ("2", None)}
    branch = {r.CNPJ: r for r in t["RFB_ESTABELECIMENTO"].collect()}
    assert branch["1010"].DATA_INICIO_ATIV is None and branch["3010"].RAZAO_SOCIAL is None
    assert str(branch["3010"].DATA_INICIO_ATIV) == "2020-01-31"
    assert sorted(r.CNAE for r in t["RFB_TEM_ATIV_ECONOMICA_SECUNDARIA"].collect()) == ["5", "7"]
    address = {r.ID_ENDERECO: r for r in t["RFB_ENDERECO"].collect()}
    assert set(address) == {"1010", "3010"}
    assert (address["1010"].ESTADO, address["1010"].UF, address["1010"].ENDERECO) == ("MATO_GROSSO DO SUL", "MS", None)
    abroad = t["RFB_ENDERECO_EXTERIOR"].collect()
    assert [(r.ID_ENDERECO, r.PAIS, r.ENDERECO) for r in abroad] == [("1020", None, None)]
    assert [r.ID_SOCIO for r in t["RFB_SOCIEDADE_COM_HOLDING"].collect()] == ["12345678"]
    people = {(r.ID_PESSOA, r.CPF, r.NOME, r.FAIXA_ETARIA) for r in t["RFB_PESSOA"].collect()}
    assert people == {("***1_P", "***1", "P", "4"), ("***2_R", "***2", "R", None)}
    options = {(r.ID_OPCAO_SIMPLES, str(r.DATA_OPCAO_SIMPLES)) for r in t["RFB_OPCAO_SIMPLES"].collect()}
    assert options == {("1_SIMPLES", "None"), ("1_MEI", "2010-01-01"), ("2_SIMPLES", "2011-01-01")}
    graph = build_graph(spark, REGISTER_MAPS, t)
    unique = unique_subjects(spark, REGISTER_MAPS, t)
    saving = build_graph(spark, REGISTER_MAPS, t, unique=unique)
    assert "Establishment" in unique and "has_subsidiary" not in unique
    assert sorted(saving.distinct().triples().collect()) == sorted(graph.distinct().triples().collect())


def test_query_mode_loses_the_columns_its_sql_leaves_out(spark):
    register_views(silver_tables(empty_bronze(spark), CODES))
    graph = build_graph(spark, REGISTER_MAPS, spark.table, Options(source="query", constants=True))
    lost = {(n.map, n.rule.rsplit("/")[-1]) for n in graph.notes}
    assert lost == {("Address", "{NOME_PAIS}"), ("Address", "{ID_CIDADE}"), ("AddressExt", "{NOME_PAIS}"),
                    ("AddressExt", "{CITY_EXT}"), ("Socio_RFB_PF", "{ID_URI}")}


def test_state_codes_both_ways(spark):
    rows = [(n,) for n in [*STATE_CODES, "ELSEWHERE", None]]
    frame = spark.createDataFrame(rows, "n string").select(
        "n", state_code(F.col("n")).alias("c"), F.expr(state_code_sql("n")).alias("sql"),
        state_name(state_code(F.col("n"))).alias("back"))
    for r in frame.collect():
        assert r.c == r.sql == STATE_CODES.get(r.n) and r.back == (r.n if r.n in STATE_CODES else None)


def test_label_is_null_with_any_part_null(spark):
    frame = spark.createDataFrame([("a", "b", "c"), ("a", None, "c"), ("", "b", "c")], "x string, y string, z string")
    got = frame.select(dashed("x", "y", "z").alias("a"), F.expr(label_sql(("x", "y", "z"))).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [("a-b-c", "a-b-c"), (None, None), ("-b-c", "-b-c")]
