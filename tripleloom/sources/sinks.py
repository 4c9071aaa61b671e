"""Writers of graphs and reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

from tripleloom.functions.ntriples import prefix_lines
from tripleloom.operators.triples import Graph, line_sums


# Bounds a file near half a gigabyte; far smaller files would be too many for a large graph.
LINES_PER_FILE = 5_000_000


def write_ntriples(graph: Graph, path: str, max_lines_per_file: int = LINES_PER_FILE,
                   compression: str | None = None) -> None:
    """Replaces ``path`` by part files of N-Triples, written in parallel.

    A file holds at most ``max_lines_per_file`` statements.  A graph's watch
    counts triples and lines on the way.
    """
    lines = graph.watched().lines()
    writer = (lines if graph.watch is None else graph.watch.lines(lines)).write.mode("overwrite").option("maxRecordsPerFile", max_lines_per_file)
    if compression:
        writer = writer.option("compression", compression)
    writer.text(path)


def stored_lines(spark: SparkSession, path: str) -> dict[str, int | str]:
    """Number and checksum of the statements in written files, to compare with what a watch saw."""
    return spark.read.text(path).agg(*line_sums()).first().asDict()


def write_prefixes(spark: SparkSession, prefixes: Mapping[str, str], path: str) -> None:
    """Writes the ``@prefix`` block; put before the N-Triples it reads as Turtle."""
    lines = [(i, line) for i, line in enumerate(prefix_lines(prefixes))]
    frame = spark.createDataFrame(lines, "position int, value string")
    frame.coalesce(1).sortWithinPartitions("position").select("value").write.mode("overwrite").text(path)


def write_triples(graph: Graph, path: str, fmt: str = "parquet") -> None:
    """Replaces ``path`` by the whole triples as a table, for SQL readers."""
    graph.triples().write.mode("overwrite").format(fmt).save(path)
