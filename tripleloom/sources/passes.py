"""Publishing a graph in hash ranges that are committed one by one.

A shuffle has a bounded number of tasks, so beyond some size its tasks would
grow with the graph.  Here one scan of the tables writes the graph's packed
rows into folders by a hash of the subject (encoded triples by a hash of the
whole, where prefixes overlap).  Equal triples meet in one folder, so each is
de-duplicated and written as a pass of its own, whose tasks keep the size that
was planned.

A pass is written to a hidden folder, its counts are noted, and one rename
commits it.  A job that ends anywhere is repeated with the same call: it goes
on with the passes that are not committed, and scans the tables again only if
it had not ended doing so.  What it finds belongs to it if mapping, options,
number of passes and input files are the same; otherwise it starts anew.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.operators.rules import TriplesMap, maps_to_json
from tripleloom.operators.triples import ENCODED_SCHEMA, PACKED_SCHEMA, Graph, Options, Watch, build_graph
from tripleloom.sources.sinks import write_ntriples
from tripleloom.sources.tables import _path, drop_tables, exists

STAGING = "_staged"
_STATE = "_passes"
# Folders that one task writes side by side without sorting its rows, and the rows of each that it holds.
_FOLDERS = 8
_FOLDER_BYTES = 16 * 1024 * 1024


class Recorded(Watch):
    """What earlier runs counted, read back from their notes."""

    def __init__(self, subjects: Mapping[str, Sequence[int]], written: Sequence[Mapping[str, int | str]]):
        super().__init__()
        self._subjects, self._written = subjects, written

    def subjects(self) -> dict[str, tuple[int, int]]:
        return {name: (read, made) for name, (read, made) in self._subjects.items()}

    def written(self) -> dict[str, int | str]:
        sums = {name: sum(int(w[name]) for w in self._written) for name in ("triples", "lines", "checksum")}
        return {**sums, "checksum": str(sums["checksum"])}


def _note(spark: SparkSession, path: str, value: object) -> None:
    """Writes a small JSON file that is there as a whole or not at all."""
    base, _, name = path.rpartition("/")
    (fresh, files), (place, _) = _path(spark, f"{base}/.{name}"), _path(spark, path)
    stream = files.create(fresh, True)
    stream.write(bytearray(json.dumps(value).encode()))
    stream.close()
    files.delete(place, False)
    if not files.rename(fresh, place):
        raise OSError(f"cannot write {path}")


def _noted(spark: SparkSession, path: str) -> dict | None:
    return json.loads(spark.read.text(path, wholetext=True).first()[0]) if exists(spark, path) else None


def fingerprint(maps: Sequence[TriplesMap], tables: Mapping[str, DataFrame], options: Options, passes: int) -> str:
    """What a run works on: mapping, options, number of passes, what is staged and the names of the input files."""
    digest = hashlib.sha256(maps_to_json(maps).encode())
    digest.update(repr((options, passes, PACKED_SCHEMA)).encode())
    for name in sorted(tables):
        digest.update(f"\n{name}\n".encode())
        for file in sorted(tables[name].inputFiles()):
            digest.update(file.encode() + b"\n")
    return digest.hexdigest()


def stage(graph: Graph, path: str, passes: int) -> None:
    """Writes the graph's rows in one scan, into a folder per hash range of what equal triples share."""
    rows, key = (graph.encoded, ["shape", "s", "o"]) if graph.packed is None else (graph.packed.rows, ["s"])
    number = F.pmod(F.xxhash64(*key), F.lit(passes)).cast("int")
    spark, most = rows.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(most)
    spark.conf.set(most, _FOLDERS if passes <= _FOLDERS else before)
    try:
        rows.withColumn("pass", number).write.mode("overwrite").partitionBy("pass").options(
            **{"compression": "zstd", "parquet.block.size": str(_FOLDER_BYTES)}).parquet(path)
    finally:
        spark.conf.set(most, before)


def staged(graph: Graph, path: str, number: int) -> Graph:
    """The staged triples of one range, as a set."""
    schema = ENCODED_SCHEMA if graph.packed is None else PACKED_SCHEMA
    stored = graph.repeated.sparkSession.read.schema(f"{schema}, pass int").parquet(path)
    rows = stored.filter(F.col("pass") == number).drop("pass")
    packed = None if graph.packed is None else graph.packed._replace(rows=rows)
    return replace(graph, repeated=rows if packed is None else packed.encoded(), packed=packed, single=None, watch=Watch()).distinct()


def _commit(spark: SparkSession, fresh: str, place: str) -> None:
    (source, files), (target, _) = _path(spark, fresh), _path(spark, place)
    if not files.rename(source, target):
        raise OSError(f"cannot move {fresh} to {place}")


def write_in_passes(
    spark: SparkSession, maps: Sequence[TriplesMap], tables: Mapping[str, DataFrame], path: str,
    options: Options = Options(), passes: int = 1, compression: str | None = None,
) -> tuple[Graph, Watch]:
    """Writes the graph's lines as a set to ``path/pass=N`` and gives the graph and all counts of all runs.

    Readers of ``path`` get the statements in ``value`` and the pass as a second column.  ``compression`` is that
    of the lines; passes that earlier runs committed keep theirs.
    """
    if passes < 1:
        raise ValueError("passes must be at least 1")
    base, watch = path.rstrip("/"), Watch()
    state, staging = f"{base}/{_STATE}", f"{base}/{STAGING}"
    graph = build_graph(spark, maps, tables, options, watch=watch)
    work = fingerprint(maps, tables, options, passes)
    plan = _noted(spark, f"{state}/plan.json")
    missing = [number for number in range(passes) if not exists(spark, f"{base}/pass={number}")]
    if plan is None or plan["work"] != work or (missing and not exists(spark, staging)):
        drop_tables(spark, base)
        stage(graph, staging, passes)
        missing = list(range(passes))
        plan = {"work": work, "passes": passes, "subjects": watch.subjects()}
        _note(spark, f"{state}/plan.json", plan)
    written = []
    for number in range(passes):
        place, fresh, counts = f"{base}/pass={number}", f"{base}/.pass={number}", f"{state}/{number}.json"
        if number in missing:
            part = staged(graph, staging, number)
            write_ntriples(part, fresh, compression=compression)
            _note(spark, counts, part.watch.written())
            _commit(spark, fresh, place)
        written.append(_noted(spark, counts))
    drop_tables(spark, staging)
    return graph, Recorded(plan["subjects"], written)
