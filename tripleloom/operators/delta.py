"""Graphs kept up to date by change sets of their tables.

A graph is a set, but a triple can come from many rows, so a deleted row need
not delete its triples.  The number of rows behind every triple is kept as
signed rows ``(shape, s, o, n)``; a triple is in the graph while its numbers add
up to more than zero.  A change set is turned into such rows by the mapping
itself, in one scan of the change set, and only triples that it touches are
looked up.  Applying it appends its rows to the stored ones; nothing that was
stored is written again until ``compact``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.operators.rules import TriplesMap
from tripleloom.operators.triples import Graph, Options, build_graph

CHANGE = "_change_type"
_WEIGHT = "_rows"
_TRIPLE = ["shape", "s", "o"]


@dataclass(frozen=True)
class Delta:
    """The triples that a change set adds and removes, and its signed rows ``(shape, s, o, n)``."""

    added: Graph
    removed: Graph
    rows: DataFrame


def weighted(changes: DataFrame) -> DataFrame:
    """Changed rows with the number of copies they add, or take away as a negative one."""
    copies = F.col("copies").cast("long") if "copies" in changes.columns else F.lit(1).cast("long")
    sign = F.when(F.col(CHANGE).isin("insert", "update_postimage"), copies).when(
        F.col(CHANGE).isin("delete", "update_preimage"), -copies)
    unknown = F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce(CHANGE, F.lit("null")))).cast("long")
    return changes.withColumn(_WEIGHT, F.coalesce(sign, unknown)).drop(CHANGE, "copies")


def _summed(graph: Graph) -> DataFrame:
    return graph.encoded.groupBy(*_TRIPLE).agg(F.sum(_WEIGHT).alias("n")).filter("n <> 0")


def count_rows(
    spark: SparkSession, maps: Sequence[TriplesMap], tables: Mapping[str, DataFrame], options: Options = Options()
) -> tuple[Graph, DataFrame]:
    """The graph of whole tables as a bag, and the number of rows behind each of its triples."""
    once = {name: frame.withColumn(_WEIGHT, F.lit(1).cast("long")) for name, frame in tables.items()}
    graph = build_graph(spark, maps, once, options, carry=(_WEIGHT,))
    return graph, _summed(graph)


def graph_delta(
    spark: SparkSession, maps: Sequence[TriplesMap], graph: Graph, stored: DataFrame, changes: Mapping[str, DataFrame],
    options: Options = Options(),
) -> Delta:
    """What the change sets of a graph's tables do to it.

    ``graph`` and ``stored`` are as of ``count_rows``, ``stored`` with the rows of
    later deltas appended.  ``changes`` has a change set for every table of the
    maps, by key or of row copies; one of an unchanged table is empty.  Change
    sets that take away more rows than there are raise when the result is read.
    """
    changed = build_graph(spark, maps, {name: weighted(c) for name, c in changes.items()}, options, carry=(_WEIGHT,))
    if changed.shapes != graph.shapes:
        raise ValueError("the change sets do not have the columns of the graph's tables")
    rows = _summed(changed)
    # Stored rows are only read where they are touched: a small change set is broadcast at run time.
    touched = stored.join(rows.select(*_TRIPLE), _TRIPLE, "left_semi")
    before = touched.groupBy(*_TRIPLE).agg(F.sum("n").alias("_before"))
    both = rows.join(before, _TRIPLE, "left").withColumn("_before", F.coalesce("_before", F.lit(0)))
    after = F.col("_before") + F.col("n")
    below = F.raise_error("the change sets take away rows that the graph does not have").cast("long")
    both = both.withColumn("_after", F.when(after < 0, below).otherwise(after))

    def of(condition: str) -> Graph:
        return replace(graph, repeated=both.filter(condition).select(*_TRIPLE), single=None, watch=None)

    return Delta(of("_before <= 0 AND _after > 0"), of("_before > 0 AND _after <= 0"), rows.select(*_TRIPLE, "n"))


def current(graph: Graph, stored: DataFrame) -> Graph:
    """The set of triples that stored rows, appended deltas included, hold."""
    return replace(graph, repeated=compact(stored).select(*_TRIPLE), single=None, watch=None)


def compact(stored: DataFrame) -> DataFrame:
    """One row per triple of the graph, in place of its signed rows."""
    return stored.groupBy(*_TRIPLE).agg(F.sum("n").alias("n")).filter("n > 0")
