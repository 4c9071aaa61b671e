"""How far the sources of a language differ, by a frequent-pattern tree over the rows of its terms.

Each kept term of a language is a row: the sources that have it, in order, each
with its share.  A source without the term has the share of a zero count, so
the divergence of two sources is that of two rows of zeros, corrected where one
or both have the term.  Rows are inserted into a tree, equal ones once with
their multiplicity, and rows with equal beginnings share the path.  A node then
adds its correction with each ancestor once, for all rows below it.

Rows are sorted within ranges and the tree of a batch is found by comparing
neighbours; a path that goes on in the next batch is a node there too, which
leaves the sums as they are.  All arithmetic is on whole numbers.

Null text, language and source are empty text.  A language without kept terms
has divergences of 0 and no term rows.  Repeated documents count each.  Without
documents there are no rows.  Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tripleloom.llm.store import small_batches, stored
from tripleloom.llm.text import LOWER, ranges, utf8

#: A term is kept where this many documents of its language have it; term rows to this rank.
LEAST_DOCUMENTS, RANKS = 3, 200
SCALE = 1_000_000_000

#: Bytes of terms: ASCII letters and all that is not ASCII.
_TERM = np.zeros(256, dtype=bool)
_TERM[65:91] = True
_TERM[97:123] = True
_TERM[128:] = True
#: Node-ancestor combinations worked on at once.
_AT_ONCE = 1 << 19


def _count(batches):
    """Occurrences and documents of each term, per language and source of a batch."""
    for batch in batches:
        data, at = utf8(batch.column("text"))
        inside = _TERM[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        inner = at[:-1][np.diff(at) > 0]
        begins[inner] = inside[inner]
        starts = np.flatnonzero(begins)
        if not len(starts):
            continue
        text = np.searchsorted(at, starts, side="right") - 1
        packed = np.flatnonzero(inside)
        edges = np.append(np.searchsorted(packed, starts), len(packed)).astype(np.int64)
        bytes_ = np.ascontiguousarray(LOWER[data[packed]])
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(bytes_)).dictionary_encode()
        code, n = words.indices.to_numpy().astype(np.int64), len(words.dictionary)
        groups: dict[tuple[str, str], int] = {}
        own = np.array([groups.setdefault(k, len(groups)) for k in zip(
            batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)], dtype=np.int64)
        each, many = np.unique(text * n + code, return_counts=True)
        key, place = np.unique(own[each // n] * n + each % n, return_inverse=True)
        names = list(groups)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in names]).take(pa.array(key // n)), pa.array([k[1] for k in names]).take(pa.array(key // n)),
             words.dictionary.cast(pa.string()).take(pa.array(key % n)),
             pa.array(np.bincount(place, weights=many).astype(np.int64)), pa.array(np.bincount(place))],
            names=["lang", "source", "term", "n", "documents"])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n and documents, summed in the map tasks first."""
    base = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return base.mapInArrow(_count, "lang string, source string, term string, n long, documents long").groupBy(
        "lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (total + terms)) in whole numbers, whatever the counts."""
    wide = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide, (total + terms).cast("decimal(19,0)"))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most about 10^9, so the square fits."""
    return F.call_function("div", (p - q) * (p - q), q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def tree_corrections(batches):
    """Sums over node-ancestor combinations, per ordered pair of sources, for batches of sorted rows.

    A row is lang, path (source, share, share of a zero count) and m, the
    number of terms with it.
    """
    for batch in batches:
        m = batch.column("m").to_numpy()
        paths, langs = batch.column("path"), batch.column("lang").dictionary_encode()
        if isinstance(paths, pa.ChunkedArray):
            paths = paths.combine_chunks()
        items = paths.flatten()
        if not len(items):
            continue
        sources = items.field("source").dictionary_encode()
        source = sources.indices.to_numpy().astype(np.int64)
        p, zero = items.field("p").to_numpy(), items.field("zero").to_numpy()
        lang = langs.indices.to_numpy().astype(np.int64)
        length = np.diff(paths.offsets.to_numpy()).astype(np.int64)
        first = np.cumsum(length) - length
        row = np.repeat(np.arange(len(length)), length)
        depth = np.arange(len(row)) - first[row]
        # Equal to the item above, as are all before it: the same node as in the row above.
        above = first[np.maximum(row - 1, 0)] + depth
        fits = (row > 0) & (depth < length[row - 1]) & (lang[row] == lang[row - 1])
        above = np.where(fits, above, 0)
        same = fits & (source == source[above]) & (p == p[above])
        breaks = np.where(same, len(row), depth)
        common = np.minimum.reduceat(breaks, first[length > 0])  # first depth at which a row leaves the one above
        shared = np.zeros(len(length), dtype=np.int64)
        shared[length > 0] = common
        new = depth >= shared[row]
        # A node's multiplicity: all rows from its own until one leaves the path at its depth or above.
        number = np.cumsum(new) - 1
        total = np.zeros(int(new.sum()), dtype=np.int64)
        at = np.flatnonzero(new)
        stack = np.zeros(int(length.max()), dtype=np.int64)
        for i in np.flatnonzero(length).tolist():
            low, k, keep = first[i], length[i], min(shared[i], length[i])
            stack[keep:k] = number[low + keep:low + k]
            total[stack[:k]] += m[i]
        yield from _combinations(langs.dictionary, sources.dictionary, lang[row[at]], source, p, zero, at, depth[at], total)


def _combinations(lang_names, source_names, lang, source, p, zero, at, depth, total):
    n = len(source_names)
    ends = np.cumsum(depth)
    low = 0
    sums: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while low < len(at):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + _AT_ONCE)))
        mine = np.repeat(np.arange(low, high), depth[low:high])
        if len(mine):
            b, a = at[mine], ranges(at[low:high] - depth[low:high], depth[low:high])
            pa_, pb, za, zb, m = p[a], p[b], zero[a], zero[b], total[mine]
            both = m * (_gap(pa_, pb) - _gap(pa_, zb) - _gap(za, pb) + _gap(za, zb))
            back = m * (_gap(pb, pa_) - _gap(pb, za) - _gap(zb, pa_) + _gap(zb, za))
            pair = (lang[mine] * n + source[a]) * n + source[b]
            order = np.argsort(pair, kind="stable")
            pair, start = np.unique(pair[order], return_index=True)
            sums.append((pair, np.add.reduceat(both[order], start), np.add.reduceat(back[order], start)))
        low = high
    for pair, both, back in sums:
        a, b, of = source_names.take(pa.array(pair // n % n)), source_names.take(pa.array(pair % n)), lang_names.take(
            pa.array(pair // n // n))
        for group, item, value in ((a, b, both), (b, a, back)):
            yield pa.RecordBatch.from_arrays([of, group, item, pa.array(value)], names=["lang", "source", "item", "value"])


def source_divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value and rank: sources by divergence, and the terms that a source prefers.

    Sources of a language are joined with each other, as the result has a row
    for each pair of them; that join sees one row per source and share, never
    documents or terms.
    """
    small_batches(docs.sparkSession)
    found = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    counts = stored(term_counts(docs), "term-counts")
    # One row per source in a list, at most the sources of a language.
    kept = counts.groupBy("lang", "term").agg(
        F.sum("documents").alias("documents"), F.sum("n").alias("all_n"), F.collect_list(F.struct("source", "n")).alias("row"))
    kept = stored(kept.where(F.col("documents") >= least).select("lang", "term", "all_n", F.inline("row")), "kept-terms")
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang", "term").agg(F.first("all_n").alias("n")).groupBy("lang").agg(
        F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("terms"))
    none = F.lit(0).cast("long")
    groups = found.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", F.coalesce("total", none).alias("total"), F.coalesce("lang_total", none).alias("lang_total"),
        F.coalesce("terms", none).alias("terms"))
    # Without kept terms shares are not needed; a total of 1 only keeps them defined.
    safe = F.greatest("terms", F.lit(1).cast("long"))
    groups = stored(groups.withColumn("zero", share(none, F.col("total"), safe)), "groups")

    levels = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        share(F.col("all_n"), F.col("lang_total"), F.col("terms")).alias("q"), "zero")
    levels = stored(levels, "levels")

    item = F.struct("source", "p", "zero")
    rows = levels.groupBy("lang", "term").agg(F.sort_array(F.collect_list(item)).alias("path"))
    paths = stored(rows.groupBy("lang", "path").agg(F.count(F.lit(1)).alias("m")), "term-rows")
    tree = paths.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path").mapInArrow(
        tree_corrections, "lang string, source string, item string, value long")

    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("other_zero"))
    pairs = groups.select("lang", "source", "terms", "zero").join(other, "lang").where("source <> item")
    base = pairs.select("lang", "source", "item", (F.col("terms") * gap(F.col("zero"), F.col("other_zero"))).alias("value"))
    # Terms that one of the two has, by source and share.
    alone = levels.groupBy("lang", "source", "p", "zero").agg(F.count(F.lit(1)).alias("m"))
    alone = stored(alone, "shares").join(other, "lang").where("source <> item")
    p, mine, theirs, m = (F.col(c) for c in ("p", "zero", "other_zero", "m"))
    one = alone.select("lang", "source", "item", (m * (gap(p, theirs) - gap(mine, theirs))).alias("value"))
    two = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"),
                       (m * (gap(theirs, p) - gap(theirs, mine))).alias("value"))
    sums = base.unionByName(one).unionByName(two).unionByName(tree).groupBy("lang", "source", "item").agg(
        F.sum("value").alias("value"))

    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_source = sums.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    terms = levels.where("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    # The limit on ranks is applied in the map tasks too.
    by_term = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return by_source.select(*columns).unionByName(by_term.select(*columns))
