"""The three jobs end to end on files, and behaviour under skew."""

import json

import pytest
from pyspark.sql import functions as F

from tripleloom import jobs
from tripleloom.catalog.standin import CODES, bronze_frames
from tripleloom.operators.joins import hot_keys, left_lookup
from tripleloom.operators.rules import maps_to_json
from tripleloom.operators.triples import Options, build_graph
from tripleloom.plans.register_mapping import REGISTER_MAPS
from tripleloom.plans.silver import SILVER, silver_tables
from tripleloom.session import fit_shuffle

SF = "/root/testdata/sf0.001"
CODE_TEXT = "head_office=1,company=1,person=2,foreigner=3,opted=S,home_country=BRASIL"
FILES = {"razao_situacao": "moti", "nat_ju": "natj", "qualif_socio": "qual", "simei": "simples"}


def test_jobs_end_to_end(spark, tmp_path):
    frames = bronze_frames(spark, SF)
    for name, frame in frames.items():
        folder = tmp_path / "data" / name
        folder.mkdir(parents=True)
        frame.toPandas().to_csv(folder / f"K.{FILES.get(name, name)}.csv", sep=";", header=False, index=False)
    data, bronze, silver, out = (f"{tmp_path}/{x}" for x in ("data", "bronze", "silver", "out"))
    manifest = jobs.load(spark, data, bronze, f"{tmp_path}/status")
    assert {r.delta_table: r.record_count for r in manifest.collect()} == {n: f.count() for n, f in frames.items()}
    assert jobs._codes(CODE_TEXT) == CODES
    jobs.refine(spark, bronze, silver, CODES)
    report = jobs.publish_tables(spark, silver, out)
    assert report.count() == 22 and report.filter("difference <> 0").count() == 0
    lines = spark.read.text(f"{out}/triples")
    expected = build_graph(spark, REGISTER_MAPS, silver_tables(frames, CODES)).distinct().lines()
    assert lines.count() == lines.distinct().count()
    assert lines.exceptAll(expected).count() == 0 and expected.exceptAll(lines).count() == 0
    notes = [json.loads(x) for f in (tmp_path / "out/notes").glob("part*") for x in f.read_text().splitlines()]
    assert [n["map"] for n in notes] == ["Estrangeiro"]
    (tmp_path / "maps.json").write_text(maps_to_json(REGISTER_MAPS))
    maps = jobs.read_maps(spark, f"{tmp_path}/maps.json")
    assert maps == REGISTER_MAPS
    declared = jobs.publish_tables(spark, silver, f"{tmp_path}/declared", maps,
                                   Options(source="query", constants=True), check_unique=True)
    assert declared.count() == 22
    assert spark.read.text(f"{tmp_path}/declared/triples").filter("value LIKE '%e_estrangeiro%'").count() > 0


def test_shuffle_partitions_grow_with_the_tables(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    lineitem = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet")
    try:
        assert fit_shuffle(spark, [lineitem]) == int(before)
        assert fit_shuffle(spark, [lineitem], growth=1000) > 60
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture
def no_broadcast(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in old.items():
        spark.conf.set(key, value)


def test_hot_and_null_keys_are_spread_over_tasks(spark, no_broadcast):
    """One key has a third of the rows, null another third; no task gets either whole."""
    n = 90_000
    key = "CASE id % 3 WHEN 0 THEN 'hot' WHEN 1 THEN CAST(id % 1000 AS STRING) END"
    rows = spark.range(0, n, 1, 8).selectExpr("id", f"{key} AS k")
    names = spark.range(500).selectExpr("CAST(id AS STRING) AS k", "concat('n', id) AS name")
    names = names.unionAll(spark.sql("SELECT 'hot', 'HOT'")).groupBy("k").agg(F.min("name").alias("name"))
    spread = left_lookup(rows, {"k": names}, hot_rows=1000)
    sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == n and max(sizes) < n / 4
    plain = rows.join(names, "k", "left").select(spread.columns)
    assert spread.exceptAll(plain).count() == 0 and plain.exceptAll(spread).count() == 0
    assert spread.filter("name = 'HOT'").count() == n // 3
    assert {(r._hot, r._parts) for r in hot_keys(rows, "k", 1000).collect()} == {("hot", 30)}


def test_small_lookups_are_joined_plainly(spark):
    rows = spark.range(10).selectExpr("CAST(id AS STRING) AS k")
    plan = left_lookup(rows, {"k": rows.selectExpr("k", "k AS v").limit(3)})._jdf.queryExecution().executedPlan().toString()
    assert "_part" not in plan


def test_parts_of_distinct_rows_depend_on_the_row_only(spark, no_broadcast):
    rows = spark.range(0, 9000, 1, 4).selectExpr("id", "CAST(id % 2 AS STRING) AS k")
    names = spark.range(2).selectExpr("CAST(id AS STRING) AS k", "concat('n', id) AS name")
    spread = left_lookup(rows, {"k": names}, hot_rows=500, distinct_rows=True)
    sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 9000 and max(sizes) < 4500 and spread.filter("name = concat('n', k)").count() == 9000
    assert "rand(" not in spread._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["RFB_EMPRESA", "RFB_ESTABELECIMENTO", "RFB_SOCIEDADE_COM_HOLDING",
                                  "RFB_ESTRANGEIRO", "RFB_SITUACAO_CADASTRAL", "RFB_ENDERECO"])
def test_silver_is_the_same_when_nothing_can_be_broadcast(spark, no_broadcast, name):
    build = SILVER[name]
    shuffled = sorted(map(str, build(bronze_frames(spark, SF), CODES).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    assert sorted(map(str, build(bronze_frames(spark, SF), CODES).collect())) == shuffled
