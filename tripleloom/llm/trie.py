"""Prefix trie of conversations by truncation peeling.

A conversation is a path of turns; equal first turns are one node.  Peeling
starts at the greatest depth: conversations that end there are merged with the
nodes that survived from below, their aggregates are final, and each node loses
its last turn and joins its equals one level up.  A node is found and summed up
in the same step, and nothing is read twice.

Paths stand in order, so those with common first turns stand together, and each
task peels one range of them.  Only nodes on the first and last path of a range
can have members elsewhere: a range hands these up as two rows, and one more
peeling over two rows per range ends them.  The number of steps therefore does
not grow with the length of conversations, and no group of conversations, root
included, meets in one task: equal ones are merged before, in the map tasks.

Turns without a conv_id belong to no conversation and are left out.  Turns of
one number are ordered by role and text; a repeated row is a turn of its own.  A
null role or text is empty.  Without conversations there is no root either.
Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tripleloom.llm.store import small_batches, stored

#: Conversations of a hundred share their first turns with the first of these.
FAMILY, HEADS = 100, 6
ROOT = b""
#: Ids are hashed in runs of neighbouring numbers, so that a run has a bounded number of them.
RUN_BITS = 12

_ITEM = "keys array<binary>, sizes array<long>, at array<struct<depth:long,n:long,conv_id:long,children:long,leaves:long,saved:long>>"
_NODE = "key binary, parent binary, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long"
_PEELED = f"{_NODE}, {_ITEM}"


def turn_lists(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order, each a digest of role and text and the text's code points.

    Texts take part in one sort, which spills; what is collected per
    conversation is forty bytes a turn.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("conv_id IS NOT NULL")
    order = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    name = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    rows = rows.withColumn("place", F.row_number().over(order)).select(
        "conv_id", F.struct("place", F.unhex(F.md5(name)).alias("digest"), F.length("text").cast("long").alias("size")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Conversations with the first turns of their family's first conversation in place of as many of their own."""
    turns = stored(turns, "turns")
    # A family is a range of numbers, so its first conversation meets a bounded number of others.
    home = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = turns.where(f"conv_id % {FAMILY} = 0").select(
        F.col("conv_id").alias("home"), F.slice("turns", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    joined = turns.withColumns({"home": home, "h": h}).join(heads, "home", "left")
    none = F.slice("turns", 1, 0)
    own = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), own).alias("turns"))


def _chain(batches):
    """Names of all first parts of each conversation: the name of the part before, hashed with the next turn."""
    for batch in batches:
        keys, sizes, last = [], [], []
        for turns in batch.column("turns").to_pylist():
            key, mine = ROOT, []
            for turn in turns:
                key = hashlib.md5(key + turn["digest"]).digest()
                mine.append(key)
            keys.append(mine)
            sizes.append([t["size"] for t in turns])
            last.append(key)
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array(last, pa.binary()), pa.array(keys, pa.list_(pa.binary())),
             pa.array(sizes, pa.list_(pa.int64()))], names=["conv_id", "key", "keys", "sizes"])


class Node:
    """A path's first ``depth`` turns and what is known of the conversations through them."""

    __slots__ = ("keys", "sizes", "n", "conv_id", "children", "leaves", "saved")

    def __init__(self, keys, sizes):
        self.keys, self.sizes = keys, sizes
        self.n = self.children = self.leaves = self.saved = 0
        self.conv_id = None

    def add(self, n: int, conv_id: int, children: int, leaves: int, saved: int) -> None:
        self.n += n
        self.conv_id = conv_id if self.conv_id is None else min(self.conv_id, conv_id)
        self.children += children
        self.leaves += leaves
        self.saved += saved


class Final(NamedTuple):
    key: bytes
    parent: bytes | None
    conv_id: int
    depth: int
    n_convs: int
    n_children: int
    n_leaves: int
    saved_tokens: int


class Peeler:
    """Peels ordered paths batch by batch; nodes that later paths may still reach stay open."""

    def __init__(self, whole: bool):
        self.whole = whole  # whether these are all paths
        self.levels: list[dict[bytes, Node]] = []
        self.first: frozenset[bytes] | None = None
        self.edge: list[bytes] = []
        self.done: list[Final] = []

    def _node(self, depth: int, keys, sizes) -> Node:
        while len(self.levels) <= depth:
            self.levels.append({})
        level, key = self.levels[depth], keys[depth - 1] if depth else ROOT
        if key not in level:
            level[key] = Node(keys, sizes)
        return level[key]

    def take(self, rows: list[dict]) -> list[Final]:
        """Adds paths and peels; gives the nodes that are final."""
        for row in rows:
            keys, sizes = row["keys"], row["sizes"]
            if self.first is None:
                self.first = frozenset([ROOT, *keys])
                self.front = keys, sizes
            for at in row["at"]:
                self._node(at["depth"], keys, sizes).add(at["n"], at["conv_id"], at["children"], at["leaves"], at["saved"])
            self.edge = keys
        return self._peel(frozenset([ROOT, *self.edge]))

    def _peel(self, edge: frozenset[bytes]) -> list[Final]:
        found = []
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth]
            for key, node in list(level.items()):
                if key in edge or not self.whole and key in self.first:
                    continue
                del level[key]
                found.append(self._end(depth, key, node))
        return found

    def _end(self, depth: int, key: bytes, node: Node) -> Final:
        leaves = node.leaves if node.children else 1
        parent = None
        if depth:
            node.saved += (node.n - 1) * node.sizes[depth - 1]
            parent = node.keys[depth - 2] if depth > 1 else ROOT
            self._node(depth - 1, node.keys, node.sizes).add(node.n, node.conv_id, 1, leaves, node.saved)
        return Final(key, parent, node.conv_id, depth, node.n, node.children, leaves, node.saved)

    def finish(self) -> tuple[list[Final], list[dict]]:
        """The last nodes where these are all paths, otherwise rows for what may go on outside."""
        if self.whole:
            return self._peel(frozenset()), []
        rows = []
        for inside in (True, False):  # those on the first path, then the others, on the last path
            keys, sizes, at = None, None, []
            for depth, level in enumerate(self.levels):
                for key, node in level.items():
                    if (key in self.first) == inside:
                        keys, sizes = node.keys, node.sizes
                        at.append(dict(depth=depth, n=node.n, conv_id=node.conv_id, children=node.children,
                                       leaves=node.leaves, saved=node.saved))
            if at:
                longest = at[-1]["depth"]
                rows.append(dict(keys=keys[:longest], sizes=sizes[:longest], at=at))
        return [], rows


_ITEM_TYPE = [("keys", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64())), ("at", pa.list_(pa.struct(
    [(f, pa.int64()) for f in ("depth", "n", "conv_id", "children", "leaves", "saved")])))]
_SCHEMA = pa.schema([("key", pa.binary()), ("parent", pa.binary()), *[(f, pa.int64()) for f in Final._fields[2:]], *_ITEM_TYPE])


def _peel(whole: bool):
    def run(batches):
        peeler = Peeler(whole)
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pylist([n._asdict() for n in peeler.take(batch.to_pylist())], _SCHEMA)
        nodes, rows = peeler.finish()
        yield pa.RecordBatch.from_pylist([*(n._asdict() for n in nodes), *rows], _SCHEMA)
    return run


def peel(paths: DataFrame) -> DataFrame:
    """All nodes of ``paths`` (conv_id, key, keys, sizes) with their aggregates, named by ``key`` and ``parent``."""
    ended = paths.groupBy("key").agg(
        F.first("keys").alias("keys"), F.first("sizes").alias("sizes"), F.count(F.lit(1)).alias("n"),
        F.min("conv_id").alias("conv_id"))
    zero = F.lit(0).cast("long")
    at = F.struct(F.size("keys").cast("long").alias("depth"), "n", "conv_id", zero.alias("children"),
                  zero.alias("leaves"), zero.alias("saved"))
    items = stored(ended.select("keys", "sizes", F.array(at).alias("at")), "ended")
    ranges = items.repartitionByRange("keys").sortWithinPartitions("keys")
    inner = stored(ranges.mapInArrow(_peel(False), _PEELED), "ranges")
    # Two rows per range at most; a single task reads them in order and holds one path at a time.
    edges = inner.where("at IS NOT NULL").select("keys", "sizes", "at").repartition(1).sortWithinPartitions("keys")
    outer = stored(edges.mapInArrow(_peel(True), _PEELED), "edges")
    names = [c.split()[0] for c in _NODE.split(", ")]
    return inner.where("depth IS NOT NULL").select(*names).unionByName(outer.select(*names))


def _digest(batches):
    """One SHA-256 per key over its runs of ids, which arrive in order."""
    key, state, first = None, None, True
    for batch in batches:
        keys, digests = [], []
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if first or k != key:
                if not first:
                    keys.append(key)
                    digests.append(state.hexdigest())
                key, state, first = k, hashlib.sha256(ids.encode()), False
            else:
                state.update(("," + ids).encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], names=["key", "ends"])
    if not first:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends"])


def ends(paths: DataFrame) -> DataFrame:
    """key and the digest of the ids that end there, ascending.

    Neighbouring numbers are put together first, at most 4,096 in a row.  A
    digest is sequential by its nature: it reads the rows of its key in order
    and holds one of them.
    """
    run = F.shiftright("conv_id", RUN_BITS)
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string"))
    runs = stored(paths.groupBy("key", run.alias("run")).agg(F.array_join(ids, ",").alias("ids")), "ended-ids")
    return runs.repartition("key").sortWithinPartitions("key", "run").select("key", "ids").mapInArrow(
        _digest, "key binary, ends string")


def prefix_trie(paths: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node.

    ``paths`` has conv_id and turns as ``turn_lists`` gives them.
    """
    small_batches(paths.sparkSession)
    chained = stored(paths.mapInArrow(_chain, "conv_id long, key binary, keys array<binary>, sizes array<long>"), "paths")
    nodes = stored(peel(chained), "nodes")
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    ended = stored(ends(chained.select("key", "conv_id")), "ends")
    none: Column = F.sha2(F.lit("").cast("binary"), 256)
    return nodes.join(parents, "parent", "left").join(ended, "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", none).alias("ends_sha256"))
