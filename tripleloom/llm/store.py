"""Written tables between the steps of an operator, and other Spark helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.session import scratch_dir

#: Rows of one Arrow batch; texts can be long, so far fewer than Spark's own number.
BATCH_ROWS = 1000


_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(frame: DataFrame, label: str, release: bool = False) -> DataFrame:
    """The frame written to the shared scratch folder and read again.

    Later steps read the files, so that a lost executor costs no earlier step,
    and a step used twice runs once.  With ``release`` the shuffle files of the
    write, which nothing reads again, go when it has ended.
    """
    spark = frame.sparkSession
    path = scratch_dir(spark, f"llm-{label}")
    before = spark.conf.get(_RELEASE)
    spark.conf.set(_RELEASE, "true" if release else before)
    try:
        frame.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_RELEASE, before)
    return spark.read.schema(frame.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds the Arrow batches that Python tasks get."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
