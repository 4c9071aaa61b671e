"""Stored tables by name, for rule sources and for plain SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.session import run_together
from tripleloom.sources.layout import Layout


def table_loader(spark: SparkSession, base: str, fmt: str = "parquet") -> Callable[[str], DataFrame]:
    """Reads the table stored in the folder of its name under ``base``."""
    return lambda name: spark.read.format(fmt).load(f"{base.rstrip('/')}/{name}")


def register_views(tables: Mapping[str, DataFrame]) -> None:
    """Makes tables readable by name in ``spark.sql``."""
    for name, frame in tables.items():
        frame.createOrReplaceTempView(name)


def _path(spark: SparkSession, path: str):
    """Hadoop path and its file system, local or shared."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root, root.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, files = _path(spark, path)
    return files.exists(place)


def drop_tables(spark: SparkSession, path: str) -> None:
    """Deletes a folder of tables that are no longer read."""
    place, files = _path(spark, path)
    files.delete(place, True)


def previous_path(path: str) -> str:
    """Where ``replace_table`` keeps a table's previous rows; readers skip names with a leading dot."""
    base, _, name = path.rstrip("/").rpartition("/")
    return f"{base}/.{name}-previous"


def drop_previous(spark: SparkSession, path: str) -> None:
    place, files = _path(spark, previous_path(path))
    files.delete(place, True)


def replace_table(
    frame: DataFrame, path: str, fmt: str = "parquet", keep_previous: bool = False, layout: Layout = Layout()
) -> None:
    """Writes a table beside its old files and swaps them when all rows are written.

    A write that fails leaves the old table as it was.  The swap is two renames;
    a job that ends between them leaves the old rows in ``previous_path``, from
    where the next call brings them back first.
    """
    spark, path = frame.sparkSession, path.rstrip("/")
    base, _, name = path.rpartition("/")
    fresh = f"{base}/.{name}-{uuid.uuid4().hex}"
    (old, files), (new, _), (kept, _) = _path(spark, path), _path(spark, fresh), _path(spark, previous_path(path))
    if files.exists(kept) and not files.exists(old):
        files.rename(kept, old)
    layout.rows(frame).write.format(fmt).options(**layout.options()).save(fresh)
    files.delete(kept, True)
    if files.exists(old) and not files.rename(old, kept):
        raise OSError(f"cannot move {path}")
    if not files.rename(new, old):
        raise OSError(f"cannot move {fresh} to {path}; the old rows are in {previous_path(path)}")
    if not keep_previous:
        files.delete(kept, True)


def write_tables(
    tables: Mapping[str, DataFrame], base: str, fmt: str = "parquet", layouts: Mapping[str, Layout] | None = None
) -> None:
    """Replaces each named table under ``base`` when all its rows are written."""
    def write(name: str) -> None:
        replace_table(tables[name], f"{base.rstrip('/')}/{name}", fmt, layout=(layouts or {}).get(name, Layout()))

    run_together([partial(write, name) for name in tables])


def table_counts(tables: Mapping[str, DataFrame], names: Iterable[str] | None = None) -> DataFrame:
    """Rows per table; a columnar source answers from its footers."""
    parts = [
        tables[name].agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("source_table"), "row_count")
        for name in (names or tables)
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def preview(frame: DataFrame, *order: str, rows: int = 20) -> DataFrame:
    """The first rows by a key; plans as a top-k, not as a full sort."""
    return frame.orderBy(*order).limit(rows)
