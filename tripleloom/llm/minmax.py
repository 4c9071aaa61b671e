"""Near-duplicate documents by min-max hashing.

Each of 60 one-to-one maps of the shingle hashes gives two values of a
document's signature, its least and its greatest image, so 120 values cost 60
evaluations; the two are nearly independent, and each agrees between two sets
with the probability of their Jaccard similarity.  The values are cut into bands
and a number of them must agree for a pair to look close; both follow from the
wanted similarity so that each misses a pair at it with probability of at most
``LOSS`` (24 bands of 5 values and 81 values at 0.85).

Documents with equal shingle sets form one class, and only classes are
compared.  Classes of one band value form a bucket.  A bucket never gives all
its pairs: members whose signatures are close hang below each other as a
forest.  These links are confirmed on the full sets, which joins most copies.
Where a forest holds several confirmed components, the members that could
still be linked across them are compared exactly, in pairs of blocks of bounded
size; a block pair gives at most one link fewer than it has members.

Null or wordless texts have no shingles and are linked with nothing; a null
``doc_id`` is linked as any other, and the component takes its least non-null
id.  Repeated rows are copies of each other.  Extra columns are not read.
"""

from __future__ import annotations

from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.components import components
from tripleloom.llm.store import small_batches, stored
from tripleloom.llm.text import as_long, find_words, gram_hashes, mix, ranges, word_hashes

SHINGLE = 5
PERMUTATIONS = 60
SIMILARITY = 85
#: Probability with which the bands, and again the number of equal lanes, may miss a pair at the wanted similarity.
LOSS = 1e-6
#: Members of a bucket's block, and of a block of full sets.
BLOCK, SET_BLOCK = 512, 256
#: Shingles whose memberships are held as a matrix at once.
_COLUMNS = 4096
#: Lanes that let a member join at once, before the best partner is known.
SURE = int(2 * PERMUTATIONS * 0.95)
#: Bits that mark the documents whose sets are needed; the table is broadcast and has this size at every input.
MARK_BITS = 1 << 23

_DRAW = np.random.default_rng(7)
_FACTORS = _DRAW.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _DRAW.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)


class Plan(NamedTuple):
    """Number of bands, values per band, and values that must agree for a pair to be confirmed on the full sets."""

    bands: int
    rows: int
    close: int


def plan(similarity: int) -> Plan:
    """The widest bands, and the most values to agree, that lose no more than ``LOSS`` each at ``similarity`` hundredths."""
    lanes, s = 2 * PERMUTATIONS, similarity / 100
    fit = [r for r in range(1, lanes + 1) if lanes % r == 0 and (1 - s**r) ** (lanes // r) <= LOSS] if 0 < s <= 1 else []
    if not fit:
        raise ValueError(f"{lanes} values cannot find pairs of similarity {similarity} hundredths with a loss of {LOSS}")
    below, close = 0.0, 0
    while close < lanes and (below := below + comb(lanes, close) * s**close * (1 - s) ** (lanes - close)) <= LOSS:
        close += 1
    return Plan(lanes // max(fit), max(fit), close)


def shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text, with repeats, and the texts' bounds in them."""
    words = find_words(texts)
    hashes, bounds = word_hashes(words), words.bounds
    counts = np.diff(bounds)
    grams = gram_hashes(hashes, SHINGLE)
    sizes = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    out = np.concatenate([[0], np.cumsum(sizes)])
    values = np.empty(out[-1], dtype=np.uint64)
    long = counts >= SHINGLE
    values[ranges(out[:-1][long], sizes[long])] = grams[ranges(bounds[:-1][long], sizes[long])]
    for n in range(1, SHINGLE):  # shorter texts are one shingle
        at = np.flatnonzero(counts == n)
        total = np.full(len(at), n, dtype=np.uint64)
        for j in range(n):
            total = mix(total * np.uint64(0xD6E8FEB86659FD93) + hashes[bounds[at] + j])
        values[out[at]] = total
    return values, out


def _signatures(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row per text: the least and greatest image under each permutation; a slice of texts at a time."""
    out = np.empty((len(starts), 2 * PERMUTATIONS), dtype=np.uint64)
    ends = np.append(starts[1:], len(values))
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + 30_000, side="right")))
        part, at = values[starts[low]:ends[high - 1]], starts[low:high] - starts[low]
        for k in range(PERMUTATIONS):
            image = part * _FACTORS[k] + _SHIFTS[k]
            image ^= image >> np.uint64(32)
            out[low:high, k] = np.minimum.reduceat(image, at)
            out[low:high, PERMUTATIONS + k] = np.maximum.reduceat(image, at)
        low = high
    return out


def _set_keys(values: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Number of distinct shingles and a key of the set of each text, and the sorted sets."""
    sizes, keys, sets = np.zeros(len(out) - 1, np.int64), np.zeros((2, len(out) - 1), np.uint64), []
    for i in range(len(out) - 1):
        part = np.sort(values[out[i]:out[i + 1]])
        part = part[np.concatenate([[True], part[1:] != part[:-1]])] if len(part) else part
        sizes[i] = len(part)
        if len(part):
            keys[:, i] = mix(part).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(~part))
        sets.append(part)
    return sizes, mix(keys[0] + keys[1] * np.uint64(3) + sizes.astype(np.uint64)), sets


def _sign(count: int, rows: int):
    """doc_id, text and row_key to one row per document: set size, set key, band values and short signature."""
    # The two values of a permutation are neighbours and go to different bands.
    order = np.arange(2 * PERMUTATIONS).reshape(2, PERMUTATIONS).T.reshape(rows, count).T

    def run(batches):
        for batch in batches:
            values, out = shingle_hashes(batch.column(1))
            sizes, keys, _ = _set_keys(values, out)
            full = np.flatnonzero(sizes)
            signature = _signatures(values, out[:-1][full]) if len(full) else np.zeros((0, 2 * PERMUTATIONS), np.uint64)
            lanes = mix(signature)
            bands = np.zeros((len(full), count), dtype=np.uint64)
            for b in range(count):
                total = np.full(len(full), b + 1, dtype=np.uint64)
                for lane in order[b]:
                    total = mix(total * np.uint64(0x9FB21C651E98DF25) + lanes[:, lane])
                bands[:, b] = total
            short = (lanes >> np.uint64(56)).astype(np.uint8)
            at = np.zeros(len(sizes) + 1, dtype=np.int32)
            at[1:][full] = 1
            at = np.cumsum(at, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes), as_long(keys), pa.ListArray.from_arrays(at * count, as_long(bands.ravel())),
                 pa.array([short[i].tobytes() if size else b"" for i, size in zip(at[:-1], sizes, strict=True)], pa.binary())],
                names=["doc_id", "row_key", "n_shingles", "set_key", "bands", "lanes"])
    return run


_SIGNED = "doc_id long, row_key long, n_shingles long, set_key long, bands array<long>, lanes binary"


_LINKS = "a long, b long"


def _links(keys: np.ndarray, pairs: list[tuple[int, int]]) -> pa.Table:
    ends = keys[np.sort(np.array(pairs, dtype=np.int64).reshape(-1, 2), axis=1)]
    return pa.table({"a": pa.array(ends[:, 0]), "b": pa.array(ends[:, 1])})


def _forest(close: int):
    """Links that connect the members of a block that look close, best partners first."""
    return lambda members: _linked(members, close)


def _linked(members: pa.Table, close: int) -> pa.Table:
    keys, first = np.unique(members["set_key"].to_numpy(), return_index=True)
    lanes = np.frombuffer(b"".join(members["lanes"].take(pa.array(first)).to_pylist()), np.uint8).reshape(len(keys), -1)
    left = np.ones(len(keys), dtype=bool)
    best, source = np.zeros(len(keys), np.int32), np.zeros(len(keys), np.int64)
    links: list[tuple[int, int]] = []
    while left.any():
        best[:] = 0
        queue = [int(np.argmax(left))]
        left[queue] = False
        while left.any():
            rest = np.flatnonzero(left)
            if queue:
                node = queue.pop()
                same = (lanes[rest] == lanes[node]).sum(axis=1, dtype=np.int32)
                better = same > best[rest]
                best[rest[better]], source[rest[better]] = same[better], node
                joins = rest[best[rest] >= SURE]
            else:
                joins = rest[[np.argmax(best[rest])]]
                if best[joins[0]] < close:
                    break
            links += zip(source[joins].tolist(), joins.tolist(), strict=True)
            left[joins] = False
            queue += joins.tolist()
    return _links(keys, links)


def _exact(similarity: int):
    """Links between components among the full sets of a pair of blocks, compared all with all."""
    def run(members: pa.Table) -> pa.Table:
        keys, first = np.unique(members["set_key"].to_numpy(), return_index=True)
        _, label = np.unique(members["label"].to_numpy()[first], return_inverse=True)
        if len(keys) < 2 or label.max() == 0:
            return _links(keys, [])
        sets = [np.frombuffer(x, np.uint64) for x in members["members"].take(pa.array(first)).to_pylist()]
        sizes = np.array([len(x) for x in sets])
        row = np.repeat(np.arange(len(keys)), sizes)
        _, column, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = many[column] > 1
        row, column = row[shared], (np.cumsum(many > 1) - 1)[column[shared]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((len(keys), len(keys)), dtype=np.float32)
        for low in range(0, int((many > 1).sum()), _COLUMNS):
            part = slice(*np.searchsorted(column, [low, low + _COLUMNS]))
            matrix = np.zeros((len(keys), _COLUMNS), dtype=np.float32)
            matrix[row[part], column[part] - low] = 1
            both += matrix @ matrix.T
        both = both.astype(np.int64)
        near = 100 * both >= similarity * (sizes[:, None] + sizes[None, :] - both)
        near &= label[:, None] != label[None, :]
        root, links = list(range(label.max() + 1)), []

        def top(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for x, y in zip(*(side.tolist() for side in np.nonzero(np.triu(near))), strict=True):
            u, v = top(label[x]), top(label[y])
            if u != v:
                root[u] = v
                links.append((x, y))
        return _links(keys, links)
    return run


def _marks(ids: DataFrame) -> np.ndarray:
    """A bit table of fixed size with a bit for each id."""
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(MARK_BITS))
    words = (ids.groupBy(F.shiftright(spot, 5).alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(xxhash64(doc_id), 32) as int))")).alias("bits")).toPandas())
    table = np.zeros(MARK_BITS // 32, dtype=np.int64)
    table[words["w"].to_numpy()] = words["bits"].to_numpy()
    return table


def _sets(table: np.ndarray):
    """Full sets of the documents whose bit is set."""
    def run(batches):
        for batch in batches:
            spot = batch.column(2).to_numpy(zero_copy_only=False)
            chosen = batch.filter(pa.array((table[(spot % MARK_BITS) >> 5] >> (spot % 32)) & 1 == 1))
            values, out = shingle_hashes(chosen.column(1))
            _, keys, sets = _set_keys(values, out)
            yield pa.RecordBatch.from_arrays(
                [chosen.column(0), as_long(keys), pa.array([x.tobytes() for x in sets], pa.binary())],
                names=["doc_id", "set_key", "members"])
    return run


def _confirm(similarity: int):
    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())],
                                             names=["a", "b", "ok"])
    return run


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, row_key, n_shingles, set_key, component_id and kept of every row of ``docs`` (doc_id, text).

    ``row_key`` is the hash of id and text, ``set_key`` that of the shingle set.

    Two documents are linked if their shingle sets have a Jaccard similarity of
    at least ``similarity`` hundredths; ``component_id`` is the least id that
    links reach.
    """
    spark = docs.sparkSession
    bands, rows, close = plan(similarity)
    small_batches(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = base.withColumn("row_key", F.xxhash64("doc_id", "text"))
    signed = stored(base.mapInArrow(_sign(bands, rows), _SIGNED), "signed")
    classes = (signed.where("n_shingles > 0").groupBy("set_key")
               .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("least"),
                    F.first("bands").alias("bands"), F.first("lanes").alias("lanes"))
               .select("set_key", F.col("least.doc_id").alias("doc_id"), "bands", "lanes"))
    classes = stored(classes, "classes")
    roots = _class_roots(base, classes, similarity, close)
    # The least id of a component: classes combine first, so no row of a hot class is moved for it.
    least = classes.select("set_key", "doc_id")
    labelled = least.join(roots, least.set_key == roots.node, "left").select(
        "set_key", "doc_id", F.coalesce("root", "set_key").alias("label"))
    labelled = stored(labelled, "labelled")
    minimum = stored(labelled.groupBy("label").agg(F.min("doc_id").alias("component_id")), "minimum")
    ids = labelled.select("set_key", "label").join(minimum, "label").select("set_key", "component_id")
    ids = stored(ids, "ids").withColumnRenamed("set_key", "class_key")
    joined = signed.select("doc_id", "row_key", "n_shingles", "set_key").join(
        ids, (F.col("set_key") == F.col("class_key")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "row_key", "n_shingles", "set_key", component.alias("component_id"),
                         F.coalesce(F.col("doc_id").eqNullSafe(component), F.lit(False)).alias("kept"))


def _class_roots(base: DataFrame, classes: DataFrame, similarity: int, close: int) -> DataFrame:
    """(node, root) of the classes that are linked with another."""
    spark = base.sparkSession
    spread = classes.select(F.col("set_key"), F.explode("bands").alias("bucket"))
    sizes = stored(spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("set_key").alias("centre"))
                   .where("n > 1"), "sizes")
    members = stored(spread.join(sizes, "bucket"), "shared")
    wanted = members.select("set_key").distinct().withColumnRenamed("set_key", "want")
    chosen = stored(classes.join(wanted, classes.set_key == F.col("want"), "left_semi")
                    .select("set_key", "doc_id", "lanes"), "chosen")
    members = stored(members.join(chosen.select("set_key", "lanes"), "set_key"), "members")
    table = spark.sparkContext.broadcast(_marks(chosen.select("doc_id")))
    spotted = base.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(MARK_BITS)).alias("spot"))
    sets = spotted.mapInArrow(lambda batches: _sets(table.value)(batches),
                              "doc_id long, set_key long, members binary")
    keys = chosen.select("set_key", F.col("doc_id").alias("_d"))
    sets = sets.join(keys, (sets.set_key == keys.set_key) & sets.doc_id.eqNullSafe(F.col("_d"))).select(
        sets.set_key, "members")
    sets = stored(sets.dropDuplicates(["set_key"]), "sets")

    # Members of a bucket that fits a block are one block; a larger one's blocks hang below its centre.
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = members.select("bucket", F.pmod(F.xxhash64("set_key"), blocks).alias("block"), "set_key", "lanes")
    found = placed.groupBy("bucket", "block").applyInArrow(_forest(close), _LINKS)
    hung = members.where(blocks > 1).select(F.least("set_key", "centre").alias("a"),
                                            F.greatest("set_key", "centre").alias("b")).where("a <> b")
    found = stored(found.union(hung).distinct(), "found")

    left = stored(found.join(sets, found.a == sets.set_key).select("a", "b", F.col("members").alias("x")), "left")
    both = left.join(sets, left.b == sets.set_key).select("a", "b", "x", F.col("members").alias("y"))
    checked = stored(both.mapInArrow(_confirm(similarity), "a long, b long, ok boolean"), "checked")
    good = checked.where("ok").select("a", "b")
    labels = components(good)

    # Members that look connected but are not confirmed to be: one row each, by what looks connected.
    looks = components(found)
    looks = looks.select(F.col("node").alias("set_key"), F.col("root").alias("group")).join(
        labels.select(F.col("node").alias("set_key"), "root"), "set_key", "left").select(
        "set_key", "group", F.coalesce("root", "set_key").alias("label"))
    looks = stored(looks, "looks")
    open_ = stored(looks.groupBy("group").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"),
                                              F.count(F.lit(1)).alias("n")).where("_lo <> _hi").select("group", "n"),
                   "open")
    parts = F.ceil(F.col("n") / SET_BLOCK).cast("int")
    own = F.pmod(F.xxhash64("set_key"), parts).cast("int")
    open_ = stored(looks.join(open_, "group").select("set_key", "group", "label", own.alias("own"), parts.alias("of")),
                   "unsettled")
    every = open_.join(sets, "set_key").withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    pairs = every.select("group", F.least("own", "_o").alias("i"), F.greatest("own", "_o").alias("j"),
                         "set_key", "label", "members")
    more = stored(pairs.groupBy("group", "i", "j").applyInArrow(_exact(similarity), _LINKS), "more")
    return components(good.union(more))
