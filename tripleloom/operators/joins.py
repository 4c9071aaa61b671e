"""Left join to a table with one row per key, whatever the keys on the left."""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one key that one task may join.
HOT_ROWS = 2_000_000
# Null keys match nothing; they only have to be spread.
_NULL_PARTS = 1_000_000
_DRAWS = 2**30
# Sizes from here on are the optimizer's word for not known.
_UNKNOWN_BYTES = 2**60


def planned_bytes(frame: DataFrame) -> int:
    """The optimizer's size of a frame, the one its own broadcast choice uses."""
    return int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def stored_bytes(frame: DataFrame) -> int:
    """Size of the stored tables that a frame reads, once per scan; tables of unknown size count as nothing."""
    leaves = frame._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(size for size in sizes if size < _UNKNOWN_BYTES)


def broadcast_limit(frame: DataFrame) -> int:
    limit = frame.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(limit)


def hot_keys(frame: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows, and into how many parts to split each.

    Counting combines in the map tasks and reads the key column only.  There
    are at most rows / ``hot_rows`` such keys, which bounds the result.
    """
    sizes = frame.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.filter(F.col("_n") > hot_rows).select("_hot", F.ceil(F.col("_n") / hot_rows).alias("_parts"))


def left_lookup(
    frame: DataFrame, lookups: Mapping[str, DataFrame], hot_rows: int = HOT_ROWS, distinct_rows: bool = False,
    unique: Collection[str] = (),
) -> DataFrame:
    """``frame`` with the columns of each lookup, given by its key; one row per key in each.

    A lookup under the session's broadcast threshold is joined plainly and
    broadcast by Spark.  A larger one is shuffled, and there a hot key of
    ``frame`` is split into parts of about ``hot_rows`` rows, its lookup row
    repeated per part.  Adaptive skew handling would not do: it gives up when
    one side is an aggregate that shares its shuffle with the join.

    Each row draws its part once, so that a repeated task draws the same: at
    random over a stored table, whose copies of a row must spread too, or from
    the row itself when ``frame`` is computed and its rows are distinct.  Keys
    named in ``unique`` have no hot values in ``frame``: they are joined plainly,
    without counting their rows first.
    """
    small = {k: t for k, t in lookups.items() if k in unique or planned_bytes(t) <= broadcast_limit(frame)}
    large = {k: t for k, t in lookups.items() if k not in small}
    joined = frame
    if large:
        drawn = F.pmod(F.xxhash64(*frame.columns), F.lit(_DRAWS)) / _DRAWS if distinct_rows else F.rand(11)
        joined = frame.withColumn("_draw", drawn)
    for key, lookup in large.items():
        hot = F.broadcast(hot_keys(frame, key, hot_rows))
        parts = F.when(F.col(key).isNull(), F.lit(_NULL_PARTS)).otherwise(F.coalesce("_parts", F.lit(1)))
        left = joined.join(hot, F.col(key) == F.col("_hot"), "left")
        left = left.withColumn("_part", F.floor(F.col("_draw") * parts).cast("long")).drop("_hot", "_parts")
        every = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_parts"), F.lit(1)).cast("long") - 1)
        right = lookup.join(hot, F.col(key) == F.col("_hot"), "left")
        right = right.withColumn("_part", F.explode(every)).drop("_hot", "_parts")
        joined = left.join(right, [key, "_part"], "left").drop("_part")
    for key, lookup in small.items():
        joined = joined.join(lookup, key, "left")
    return joined.drop("_draw")
