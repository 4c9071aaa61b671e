"""The register's three jobs: load files, refine tables, publish the graph.

    spark-submit tripleloom/jobs.py load --data DIR --bronze DIR --status DIR
    spark-submit tripleloom/jobs.py refine --bronze DIR --silver DIR --codes head_office=1,company=1,...
    spark-submit tripleloom/jobs.py publish --silver DIR --output DIR
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Mapping, Sequence
from dataclasses import fields
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import DataFrame, SparkSession

from tripleloom.operators.rules import TriplesMap, maps_from_json
from tripleloom.operators.triples import Options, Tables, Watch, build_graph, reconcile_watched, unique_subjects
from tripleloom.plans.register_mapping import OUTPUT_PREFIXES, REGISTER_MAPS
from tripleloom.plans.silver import Codes, spread_tables
from tripleloom.session import fit_shuffle, passes_needed, prepare, scratch_dir
from tripleloom.sources import bronze as B
from tripleloom.sources.layout import Layout, parse_layout
from tripleloom.sources.loads import load_whole
from tripleloom.sources.passes import write_in_passes
from tripleloom.sources.sinks import stored_lines, write_ntriples, write_prefixes
from tripleloom.sources.tables import drop_tables, preview, register_views, table_loader, write_tables

# Encoded triples of a row take about this many times its stored size.
TRIPLE_GROWTH = 8


def load(
    spark: SparkSession, data_dir: str, bronze_dir: str, status_dir: str, fmt: str = "parquet", append: bool = False,
    changes_dir: str | None = None, keys: Mapping[str, Sequence[str]] | None = None,
    rejects: bool = False, layouts: Mapping[str, Layout] | None = None, **options: str | bool,
) -> DataFrame:
    """Full refresh, or with ``append`` an addition, of the bronze tables; returns and writes this load's manifest.

    A load takes place whole or not at all.  A refresh replaces listed tables
    and empties any other found beside them.  With ``changes_dir`` it also
    writes the change set of each table that was there before, an addition that
    of every table: by key where ``keys`` names one, else as row copies.
    ``rejects`` adds records with a wrong number of fields to the status, and
    ``layouts`` store tables in an order and with filters for look-ups.
    """
    load_id = load_whole(spark, data_dir, bronze_dir, status_dir, fmt=fmt, append=append, changes_dir=changes_dir, keys=keys,
                         rejects=rejects, layouts=layouts, **options)
    return B.load_manifest(spark, data_dir, bronze_dir, fmt=fmt, load_id=load_id)


def refine(spark: SparkSession, bronze_dir: str, silver_dir: str, codes: Codes, fmt: str = "parquet") -> None:
    """Writes the 19 refined tables from the bronze tables, of which the largest are scanned once for all that they give."""
    bronze = {name: B.read_table(spark, bronze_dir, name, fmt) for name in B.SCHEMAS}
    fit_shuffle(spark, bronze.values())
    scratch = scratch_dir(spark, "refine")
    write_tables(spread_tables(bronze, codes, scratch), silver_dir, fmt)
    drop_tables(spark, scratch)


def publish(
    spark: SparkSession,
    maps: Sequence[TriplesMap],
    tables: Tables,
    output_dir: str,
    options: Options = Options(),
    check_unique: bool = False,
    verify: bool = False,
    passes: int | None = None,
) -> DataFrame:
    """Writes the graph of the maps as N-Triples, with prefixes and reconciliation.

    Subjects, triples and lines are counted by the run that writes them.
    ``verify`` also reads the written files and compares number and checksum of
    their lines.  ``check_unique`` first looks for maps with a subject per row, whose triples
    then need no shuffle; it pays where most triples come from such maps.
    With ``passes`` the lines are written in that many committed passes, and a
    repeated call after a failure goes on with those that are missing.
    Returns rows read and subjects made per map.
    """
    base = output_dir.rstrip("/")
    if passes:
        graph, watch = write_in_passes(spark, maps, tables, f"{base}/triples", options, passes)
    else:
        unique = unique_subjects(spark, maps, tables, options) if check_unique else frozenset()
        watch = Watch()
        graph = build_graph(spark, maps, tables, options, unique, watch).distinct()
        write_ntriples(graph, f"{base}/triples")
    write_prefixes(spark, OUTPUT_PREFIXES, f"{base}/prefixes")
    graph.notes_frame(spark).write.mode("overwrite").json(f"{base}/notes")
    written = watch.written()
    stored = stored_lines(spark, f"{base}/triples") if verify else {"lines": written["lines"], "checksum": written["checksum"]}
    spark.createDataFrame(
        [(written["triples"], written["lines"], written["checksum"], stored["lines"], stored["checksum"],
          written["triples"] - stored["lines"], verify)],
        "triples long, lines long, checksum string, stored_lines long, stored_checksum string, difference long, verified boolean",
    ).write.mode("overwrite").json(f"{base}/written")
    if (written["lines"], written["checksum"]) != (stored["lines"], stored["checksum"]):
        raise ValueError(f"{base}/triples does not hold the {written['lines']} lines that were written")
    report = reconcile_watched(spark, maps, tables, watch)
    report.write.mode("overwrite").json(f"{base}/reconciliation")
    return spark.read.schema(report.schema).json(f"{base}/reconciliation")


def publish_tables(
    spark: SparkSession, silver_dir: str, output_dir: str, maps: Sequence[TriplesMap] = REGISTER_MAPS,
    options: Options = Options(), fmt: str = "parquet", check_unique: bool = False, verify: bool = False,
    passes: int | None = None,
) -> DataFrame:
    """Publishes the graph of a mapping over stored tables, by default the register's.

    Without ``passes`` a graph that one shuffle holds is written at once, a larger one in as many passes as it needs.
    """
    read = table_loader(spark, silver_dir, fmt)
    tables = {name: read(name) for name in dict.fromkeys(tm.table for tm in maps if tm.table)}
    if options.source == "query":
        register_views(tables)
    fit_shuffle(spark, tables.values(), TRIPLE_GROWTH)
    needed = passes_needed(tables.values(), TRIPLE_GROWTH)
    passes = passes or (needed if needed > 1 else None)
    return publish(spark, maps, tables, output_dir, options, check_unique, verify, passes)


def read_maps(spark: SparkSession, path: str) -> tuple[TriplesMap, ...]:
    """A JSON mapping file, read through Spark so that shared file systems work."""
    return maps_from_json(spark.read.text(path, wholetext=True).first()[0])


def _codes(text: str) -> Codes:
    return Codes(**dict(part.split("=", 1) for part in text.split(",")))


def _key(text: str) -> tuple[str, list[str]]:
    table, _, columns = text.partition("=")
    return table, columns.split(",")


def _layout(text: str) -> tuple[str, Layout]:
    table, _, columns = text.partition("=")
    return table, parse_layout(columns)


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    command = commands.add_parser("load")
    for name in ("data", "bronze", "status"):
        command.add_argument(f"--{name}", required=True)
    command.add_argument("--append", action="store_true", help="add to the tables instead of replacing them")
    command.add_argument("--encoding", help="of the files, for example ISO-8859-1; UTF-8 without it")
    command.add_argument("--escape", help="escape sign inside quoted fields")
    command.add_argument("--multi-line", action="store_true", help="quoted fields may hold line ends")
    command.add_argument("--changes", help="folder for the change set of each replaced table")
    command.add_argument("--key", type=_key, action="append", default=[], help="table=COLUMN,... for the change set")
    command.add_argument("--rejects", action="store_true", help="report records with a wrong number of fields")
    command.add_argument("--layout", type=_layout, action="append", default=[],
                         help="table=COLUMN,...:COLUMN,... to store in order of the first and with filters for the others")
    command.add_argument("--preview", action="store_true", help="show the first rows of each table")
    command = commands.add_parser("refine")
    for name in ("bronze", "silver"):
        command.add_argument(f"--{name}", required=True)
    command.add_argument("--codes", type=_codes, required=True,
                         help="comma list of " + ", ".join(f"{f.name}=CODE" for f in fields(Codes)))
    command = commands.add_parser("publish")
    for name in ("silver", "output"):
        command.add_argument(f"--{name}", required=True)
    command.add_argument("--mapping", help="JSON mapping file; the register's mapping without it")
    command.add_argument("--run-queries", action="store_true", help="run each map's SQL instead of reading its table")
    command.add_argument("--constants", action="store_true", help="emit constant objects")
    command.add_argument("--drop-null-iris", action="store_true", help="no triple for an IRI with a null part")
    command.add_argument("--check-unique", action="store_true", help="find maps whose triples need no shuffle")
    command.add_argument("--verify", action="store_true", help="read the written lines and compare them with what was made")
    command.add_argument("--passes", type=int, help="write in this many passes that a repeated job need not make again")
    for command in commands.choices.values():
        command.add_argument("--format", default="parquet", help="table format")
    args = parser.parse_args(argv)

    spark = prepare(SparkSession.builder.appName(f"tripleloom-{args.command}").getOrCreate())
    if args.command == "load":
        given = {"encoding": args.encoding, "escape": args.escape, "multiLine": args.multi_line or None}
        load(spark, args.data, args.bronze, args.status, args.format, args.append, args.changes, dict(args.key), args.rejects,
             dict(args.layout), **{k: v for k, v in given.items() if v is not None})
        for table in B.SCHEMAS if args.preview else ():
            print(table)
            preview(B.read_table(spark, args.bronze, table, args.format), B.SCHEMAS[table].names[0]).show(truncate=False)
    elif args.command == "refine":
        refine(spark, args.bronze, args.silver, args.codes, args.format)
    else:
        options = Options(
            null_iri=None if args.drop_null_iris else "NONE", constants=args.constants,
            source="query" if args.run_queries else "table")
        maps = read_maps(spark, args.mapping) if args.mapping else REGISTER_MAPS
        publish_tables(spark, args.silver, args.output, maps, options, args.format, args.check_unique, args.verify,
                       args.passes)


if __name__ == "__main__":
    main()
