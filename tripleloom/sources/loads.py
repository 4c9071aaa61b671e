"""Loads of all bronze tables that take place whole or not at all.

A load first writes everything into folders of its own: the tables' rows, the
manifest and the change sets.  Any failure until then, a missing input folder or
a key that is not unique among them, leaves tables, manifest and change sets as
they were.  Then a journal names the load, and its folders are moved into place.
A job that ends in between leaves the journal, and the next load finishes those
moves before its own: every step can be repeated, so no change set is lost.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripleloom.operators.changes import snapshot_changes, snapshot_changes_bag
from tripleloom.session import run_together
from tripleloom.sources import bronze as B
from tripleloom.sources.layout import Layout
from tripleloom.sources.tables import _path, drop_tables, exists

JOURNAL = "load-pending.json"
#: Formats of which a table is the files in its folder, so that files can be added to it.
FILE_FORMATS = frozenset({"parquet", "orc", "json", "csv"})


def staging_path(base: str, load_id: str) -> str:
    """Where a load's folders stand until they are moved; readers skip names with a leading dot."""
    return f"{base.rstrip('/')}/.load-{load_id}"


def _children(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    place, files = _path(spark, path)
    return [(s.getPath().getName(), s.isDirectory()) for s in files.listStatus(place)] if files.exists(place) else []


def _move(spark: SparkSession, old: str, new: str) -> None:
    (source, files), (target, _) = _path(spark, old), _path(spark, new)
    files.mkdirs(target.getParent())
    if not files.rename(source, target):
        raise OSError(f"cannot move {old} to {new}")


def _replace(spark: SparkSession, staged: str, place: str) -> None:
    """Puts a staged folder in place of the old one.  Until the move is made the staged rows are there to repeat it."""
    drop_tables(spark, place)
    _move(spark, staged, place)


def _add(spark: SparkSession, staged: str, place: str) -> None:
    """Moves the files of a staged table to those that the table has; names are unique."""
    for name, is_folder in _children(spark, staged):
        if not is_folder and not name.startswith(("_", ".")):
            _move(spark, f"{staged}/{name}", f"{place}/{name}")


def _write_journal(spark: SparkSession, bronze_dir: str, entry: Mapping[str, object]) -> None:
    place, files = _path(spark, f"{bronze_dir}/_{JOURNAL}")
    stream = files.create(place, True)
    stream.write(bytearray(json.dumps(entry).encode()))
    stream.close()
    _move(spark, f"{bronze_dir}/_{JOURNAL}", f"{bronze_dir}/{JOURNAL}")


def pending(spark: SparkSession, bronze_dir: str) -> dict | None:
    """The journal of a load whose moves are not all made."""
    path = f"{bronze_dir.rstrip('/')}/{JOURNAL}"
    return json.loads(spark.read.text(path, wholetext=True).first()[0]) if exists(spark, path) else None


def finish(spark: SparkSession, bronze_dir: str) -> str | None:
    """Makes the moves of a pending load, all or those still open; gives its id."""
    bronze_dir = bronze_dir.rstrip("/")
    entry = pending(spark, bronze_dir)
    if entry is None:
        return None
    load_id, fmt = entry["load_id"], entry["format"]
    for base in filter(None, (entry["changes"], entry["status"], bronze_dir)):
        staged = staging_path(base, load_id)
        for name, _ in _children(spark, staged):
            add = base == bronze_dir and entry["append"]
            (_add if add else _replace)(spark, f"{staged}/{name}", f"{base}/{name}")
        drop_tables(spark, staged)
    if not entry["append"]:
        B.clear_tables(spark, bronze_dir, fmt, keep=entry["tables"])
    drop_tables(spark, f"{bronze_dir}/{JOURNAL}")
    return load_id


def _drop_unfinished(spark: SparkSession, *bases: str | None) -> None:
    """Deletes what loads without a journal left behind."""
    for base in filter(None, bases):
        for name, is_folder in _children(spark, base):
            if is_folder and name.startswith(".load-"):
                drop_tables(spark, f"{base.rstrip('/')}/{name}")


def change_set(old: DataFrame | None, new: DataFrame, key: Sequence[str] | None) -> DataFrame:
    """What turns ``old`` into ``new``; without ``old`` every row is an insert.

    By key where one is given, else as numbers of row copies.
    """
    if old is None:
        old = new.limit(0)
    return snapshot_changes(old, new, key) if key else snapshot_changes_bag(old, new)


def load_whole(
    spark: SparkSession, data_dir: str, bronze_dir: str, status_dir: str, schemas: Mapping[str, T.StructType] = B.SCHEMAS,
    fragments: Sequence[str] = B.FILE_FRAGMENTS, fmt: str = "parquet", append: bool = False,
    changes_dir: str | None = None, keys: Mapping[str, Sequence[str]] | None = None, rejects: bool = False,
    layouts: Mapping[str, Layout] | None = None, **options: str | bool,
) -> str:
    """Loads all tables, their manifest and, with ``changes_dir``, their change sets; gives the load's id.

    A load with ``append`` adds its rows, all of them inserts in its change
    sets.  A refresh gives change sets of the tables that were there before, and
    empties tables that are not listed.  A load that was not finished is
    finished first.  With ``rejects`` the status also has a folder ``rejected`` of
    records with a wrong number of fields and their numbers per file in ``rejected_per_file``.
    """
    bronze_dir, status_dir = bronze_dir.rstrip("/"), status_dir.rstrip("/")
    changes_dir = changes_dir and changes_dir.rstrip("/")
    if append and fmt not in FILE_FORMATS:
        raise ValueError(f"tables of format {fmt} cannot be added to by moving files; append with load_tables")
    finish(spark, bronze_dir)
    _drop_unfinished(spark, bronze_dir, status_dir, changes_dir)
    B.list_files(spark, data_dir, schemas, fragments)  # fails before anything is written if a folder is missing
    load_id = uuid.uuid4().hex
    staged = {base: staging_path(base, load_id) for base in filter(None, (bronze_dir, status_dir, changes_dir))}
    try:
        B.load_tables(spark, data_dir, staged[bronze_dir], schemas, fragments, "overwrite", fmt, load_id=load_id, rejects=rejects,
                      layouts=layouts, **options)
        manifest = B.load_manifest(spark, data_dir, staged[bronze_dir], schemas, fragments, fmt, load_id)
        B.write_manifest(manifest, staged[status_dir])
        if rejects:
            rejected = B.rejected_records(spark, staged[bronze_dir], schemas, fmt)
            rejected.write.json(f"{staged[status_dir]}/rejected")
            B.rejected_per_file(manifest, rejected).write.json(f"{staged[status_dir]}/rejected_per_file")

        def write_changes(table: str) -> None:
            old = None if append else B.read_table(spark, bronze_dir, table, fmt)
            changes = change_set(old, B.read_table(spark, staged[bronze_dir], table, fmt), (keys or {}).get(table))
            changes.write.format(fmt).save(f"{staged[changes_dir]}/{table}")

        if changes_dir:
            run_together([partial(write_changes, t) for t in schemas if append or exists(spark, f"{bronze_dir}/{t}")])
    except Exception:
        for path in staged.values():
            drop_tables(spark, path)
        raise
    _write_journal(spark, bronze_dir, {"load_id": load_id, "format": fmt, "append": append, "tables": list(schemas),
                                       "status": status_dir, "changes": changes_dir})
    finish(spark, bronze_dir)
    return load_id


def read_changes(spark: SparkSession, changes_dir: str, table: str, fmt: str = "parquet") -> DataFrame:
    """A table's change set of the last load that was finished."""
    return spark.read.format(fmt).load(f"{changes_dir.rstrip('/')}/{table}")
