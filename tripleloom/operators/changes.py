"""Change sets between two snapshots of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CHANGE = "_change_type"


def _null_free(frame: DataFrame, keys: Sequence[str], prefix: str) -> list[Column]:
    """Key values with nulls replaced, and which were null: plain equality on these is null-safe."""
    values, flags = [], []
    for i, key in enumerate(keys):
        dtype = frame.schema[key].dataType
        if isinstance(dtype, (T.NumericType, T.BooleanType)):
            stand_in = F.lit(0).cast(dtype)
        elif isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            stand_in = F.lit("1970-01-01").cast(dtype)
        else:
            stand_in = F.lit("").cast(dtype)
        values.append(F.coalesce(key, stand_in).alias(f"{prefix}_key{i}"))
        flags.append(F.col(key).isNull().alias(f"{prefix}_null{i}"))
    return values + flags


def _tagged(frame: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Join keys, whole row as a struct, and a check that the key is unique.

    The window needs the same distribution and order as the sort-merge join on
    the keys, so it adds no shuffle; ``row_number`` holds no group in memory.
    """
    row = F.struct(*[F.col(c) for c in frame.columns]).alias(name)
    keyed = frame.select(*_null_free(frame, keys, name), row)
    names = keyed.columns[:-1]
    copy = F.row_number().over(Window.partitionBy(*names).orderBy(*names))
    failure = F.raise_error(f"snapshot key {list(keys)} is not unique; use snapshot_changes_bag")
    is_first = F.when(F.col("_copy") == 1, F.lit(True)).otherwise(failure.cast("boolean"))
    return keyed.withColumn("_copy", copy).filter(is_first).drop("_copy")


def snapshot_changes(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Change feed rows that turn ``old`` into ``new``, by unique key.

    ``_change_type`` is ``insert``, ``delete``, ``update_preimage`` or
    ``update_postimage``; equal rows give nothing.  Nulls compare as equal.
    """
    left = _tagged(old, keys, "before")
    right = _tagged(new.select(*old.columns), keys, "after")
    same_key = F.lit(True)
    for mine, theirs in zip(left.columns[:-1], right.columns[:-1]):
        same_key = same_key & (F.col(mine) == F.col(theirs))
    joined = left.join(right, same_key, "full_outer").select("before", "after")
    changed = joined.filter(~F.col("before").eqNullSafe(F.col("after")))
    has_old, has_new = F.col("before").isNotNull(), F.col("after").isNotNull()
    first = F.struct(
        F.when(has_old & has_new, "update_preimage").when(has_old, "delete").otherwise("insert").alias(_CHANGE),
        F.coalesce("before", "after").alias("row"),
    )
    second = F.when(
        has_old & has_new,
        F.struct(F.lit("update_postimage").alias(_CHANGE), F.col("after").alias("row")),
    )
    spread = changed.select(F.inline(F.array(first, second)))
    return spread.filter(F.col(_CHANGE).isNotNull()).select(_CHANGE, "row.*")


def snapshot_changes_bag(old: DataFrame, new: DataFrame) -> DataFrame:
    """Row copies to insert and delete, for tables without a key.

    Equal rows are one result row with their number in ``copies``, so a row
    repeated without bound never has to be written out by one task.
    """
    columns = old.columns
    signed = old.withColumn("_sign", F.lit(-1)).unionByName(
        new.select(*columns).withColumn("_sign", F.lit(1))
    )
    balance = signed.groupBy(*columns).agg(F.sum("_sign").alias("_balance"))
    return balance.filter(F.col("_balance") != 0).select(
        F.when(F.col("_balance") > 0, "insert").otherwise("delete").alias(_CHANGE),
        *columns,
        F.abs("_balance").alias("copies"),
    )
