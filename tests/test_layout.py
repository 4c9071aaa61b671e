"""Stored order and filters: look-ups read a fraction of the rows, measured by the scan's own count."""

import pytest
from pyspark.sql import functions as F

from tripleloom import jobs
from tripleloom.sources import bronze as B
from tripleloom.sources.layout import Layout, parse_layout
from tripleloom.sources.tables import replace_table, write_tables

ORDERS = "/root/testdata/sf0.1/orders.parquet"


def scanned(frame):
    """Rows of the answer, and rows that its scan gave to the filter above it."""
    rows = frame.collect()
    leaf = frame._jdf.queryExecution().executedPlan().collectLeaves().head()
    return rows, leaf.metrics().get("numOutputRows").get().value()


@pytest.fixture(scope="module")
def laid(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("laid"))
    orders = spark.read.parquet(ORDERS).repartition(4, "o_orderkey")
    layout = Layout(("o_custkey",), ("o_orderkey",), 256 * 1024)
    write_tables({"plain": orders, "laid": orders}, base, layouts={"laid": layout})
    return spark.read.parquet(f"{base}/plain"), spark.read.parquet(f"{base}/laid")


def test_same_rows(laid):
    plain, table = laid
    assert plain.schema == table.schema
    assert table.exceptAll(plain).isEmpty() and plain.count() == table.count()


@pytest.mark.parametrize("column", ["o_custkey", "o_orderkey"])
def test_look_up_reads_a_fraction(laid, column):
    plain, table = laid
    total = plain.count()
    value = plain.agg(F.percentile_approx(column, 0.37)).first()[0]
    rows, read = scanned(table.where(F.col(column) == value))
    wanted, read_plain = scanned(plain.where(F.col(column) == value))
    assert sorted(rows) == sorted(wanted) and rows
    assert read < total / 4 and read <= read_plain
    absent = table.where(F.col(column) == -5)
    assert scanned(absent) == ([], 0)


def test_a_hot_value_is_spread(spark, tmp_path):
    rows = spark.range(200_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"),
                                       F.col("id").alias("v"))
    merging = "spark.sql.adaptive.coalescePartitions.enabled"  # would make one file of so small a table
    spark.conf.set(merging, "false")
    try:
        replace_table(rows, f"{tmp_path}/t", layout=Layout(("k",)))
    finally:
        spark.conf.set(merging, "true")
    hot = spark.read.parquet(f"{tmp_path}/t").where("k = 'hot'").groupBy(F.input_file_name()).count().collect()
    assert len(hot) > 2 and sum(r["count"] for r in hot) == 66_667


def test_odd_tables(spark, tmp_path):
    rows = spark.createDataFrame([(None, "a"), ("1", None), ("1", None), ("", "b")], "k string, v string")
    replace_table(rows, f"{tmp_path}/t", layout=Layout(("k", "v"), ("v",)))
    assert spark.read.parquet(f"{tmp_path}/t").exceptAll(rows).isEmpty()
    assert spark.read.parquet(f"{tmp_path}/t").count() == 4
    replace_table(rows.limit(0), f"{tmp_path}/e", layout=Layout(("k",), ("v",)))
    assert spark.read.parquet(f"{tmp_path}/e").schema == rows.schema
    with pytest.raises(ValueError, match="w"):
        replace_table(rows, f"{tmp_path}/t", layout=Layout(("w",)))
    assert spark.read.parquet(f"{tmp_path}/t").count() == 4


def test_load_with_a_layout(spark, tmp_path):
    schema = {"pais": B.SCHEMAS["pais"]}
    (tmp_path / "data" / "pais").mkdir(parents=True)
    (tmp_path / "data" / "pais" / "K.pais.csv").write_text("".join(f"{i % 97};C{i}\n" for i in range(1000)))
    for mode, rows in (("overwrite", 1000), ("append", 2000)):
        B.load_tables(spark, f"{tmp_path}/data", f"{tmp_path}/bronze", schema, mode=mode,
                      layouts={"pais": parse_layout("COD_PAIS:NOME_PAIS")})
        assert B.read_table(spark, f"{tmp_path}/bronze", "pais").count() == rows
    assert B.load_manifest(spark, f"{tmp_path}/data", f"{tmp_path}/bronze", schema).count() > 0


def test_layout_argument():
    assert jobs._layout("empresa=CNPJ_BASICO:RAZAO_SOCIAL,PORTE") == (
        "empresa", Layout(("CNPJ_BASICO",), ("RAZAO_SOCIAL", "PORTE")))
    assert parse_layout(":EMAIL") == Layout((), ("EMAIL",))
