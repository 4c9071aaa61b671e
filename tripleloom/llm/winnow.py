"""Benchmark decontamination by winnowing.

Texts become words, words hashes.  Of every 9 successive hashes of 5 words the
least is kept as a fingerprint, so any 13 words that a document shares with an
item hold a fingerprint that both keep.  Fingerprints of documents and items
meet in a join, each with the hashes of the 8 words to either side, and hits
are extended word by word: an extension to 13 words or more is a window of the
item, and its words in the document are hit.  Items of fewer than 13 words are
one window; for each such length the document's runs of that length are tried.

A bit table of fixed size, with a bit for each fingerprint of the items, drops
most others before they leave the scan; it can only pass too many, so results
do not depend on it and it is the same at every size of the benchmark.

Null and wordless texts have no words and no hits.  Items without words have
no window; items without an id hit words but are not counted or named.  An
item id that occurs twice counts once.  Repeated documents get equal rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.store import small_batches, stored
from tripleloom.llm.text import ALNUM, as_long, find_words, gram_hashes, mix, word_hashes

WINDOW = 13
GRAM = 5
SPAN = WINDOW - GRAM + 1
#: Bits of the broadcast table, whatever the number of items.
BITS = 1 << 24
#: A document is contaminated if this many times its hit words reach its words.
SHARE = 20


def _slide(values: np.ndarray, n: int, pick) -> np.ndarray:
    """``pick`` over each run of ``n`` values, by runs of doubling length."""
    done, out = 1, values
    while done < n:
        step = min(done, n - done)
        out = pick(out[:len(out) - step], out[step:])
        done += step
    return out


def fingerprints(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (first words) and hashes of the grams kept in texts of at least ``WINDOW`` words."""
    if len(hashes) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = gram_hashes(hashes, GRAM)
    least = _slide(grams, SPAN, np.minimum)
    inside = np.zeros(len(hashes) + 1, dtype=np.int32)
    long = np.diff(bounds) >= WINDOW
    np.add.at(inside, bounds[:-1][long], 1)
    np.add.at(inside, bounds[1:][long] - WINDOW + 1, -1)
    least = np.where(np.cumsum(inside)[:len(least)] > 0, least, 0)
    padded = np.concatenate([np.zeros(SPAN - 1, np.uint64), least, np.zeros(SPAN - 1, np.uint64)])
    kept = np.flatnonzero((grams == _slide(padded, SPAN, np.maximum)) & (grams != 0))
    return kept, grams[kept]


def _short(hashes: np.ndarray, n: int) -> np.ndarray:
    return mix(gram_hashes(hashes, n) + np.uint64(n))


def _around(hashes: np.ndarray, bounds: np.ndarray, at: np.ndarray, text: np.ndarray) -> list[bytes]:
    """Hashes of the words around each gram, as far as the text goes; the first byte counts those before."""
    low = np.maximum(at - (SPAN - 1), bounds[text])
    high = np.minimum(at + WINDOW, bounds[text + 1])
    return [bytes([p - a]) + hashes[a:b].tobytes() for a, b, p in zip(low, high, at, strict=True)]


_HIT = pa.struct([("print", pa.int64()), ("length", pa.int32()), ("at", pa.int64()), ("around", pa.binary())])


def _prints(texts: pa.Array, lengths: list[int], bits: np.ndarray | None) -> tuple[np.ndarray, pa.Array]:
    """Words of each text, and its fingerprints that the bit table passes, as lists.

    Without a table the texts are items: only whole short items give runs.
    """
    words = find_words(texts, ALNUM)
    hashes, bounds = word_hashes(words), words.bounds
    counts = np.diff(bounds)
    at, values = fingerprints(hashes, bounds)

    def passed(values):
        return slice(None) if bits is None else bits[(values % np.uint64(BITS)).astype(np.int64)]

    chosen = passed(values)
    at, values = at[chosen], values[chosen]
    text = np.searchsorted(bounds, at, side="right") - 1
    found = [(text, values, np.full(len(at), WINDOW, np.int32), at, _around(hashes, bounds, at, text))]
    for n in lengths:
        if len(hashes) < n:
            continue
        values = _short(hashes, n)
        at = np.arange(len(values))
        chosen = passed(values)
        at, values = at[chosen], values[chosen]
        text = np.searchsorted(bounds, at, side="right") - 1
        fits = at + n <= bounds[text + 1]
        if bits is None:
            fits &= counts[text] == n
        at, values, text = at[fits], values[fits], text[fits]
        found.append((text, values, np.full(len(at), n, np.int32), at, [b""] * len(at)))
    text = np.concatenate([f[0] for f in found])
    order = np.argsort(text, kind="stable")
    text = text[order]
    at = np.concatenate([f[3] for f in found])[order] - bounds[:-1][text]
    around = [x for f in found for x in f[4]]
    hits = pa.StructArray.from_arrays(
        [as_long(np.concatenate([f[1] for f in found])[order]), pa.array(np.concatenate([f[2] for f in found])[order]),
         pa.array(at), pa.array([around[i] for i in order], pa.binary())], fields=list(_HIT))
    offsets = np.searchsorted(text, np.arange(len(counts) + 1)).astype(np.int32)
    return counts.astype(np.int64), pa.ListArray.from_arrays(offsets, hits)


_PRINTS = "array<struct<print:long,length:int,at:long,around:binary>>"


def _scan(lengths: list[int], bits, names: tuple[str, ...]):
    def run(batches):
        table = None if bits is None else np.unpackbits(bits.value, bitorder="little").view(bool)
        for batch in batches:
            counts, prints = _prints(batch.column("text"), lengths, table)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(counts), prints],
                                             names=[*names, "n_words", "prints"])
    return run


def _extend(batches):
    """Stretches of document words around a shared fingerprint that hold a window."""
    for batch in batches:
        out = []
        for x, y, length, at in zip(*(batch.column(n).to_pylist() for n in ("x", "y", "length", "at")), strict=True):
            if length < WINDOW:
                out.append((at, at + length))
                continue
            a, b = np.frombuffer(x[1:], np.uint64), np.frombuffer(y[1:], np.uint64)
            p, q = x[0], y[0]
            left, right = min(p, q), min(len(a) - p, len(b) - q)
            same = a[p - left:p + right] == b[q - left:q + right]
            off = np.flatnonzero(~same)
            before, after = off[off < left], off[off >= left]
            low = before[-1] + 1 if len(before) else 0
            high = after[0] if len(after) else len(same)
            out.append((at - left + low, at - left + high) if high - low >= WINDOW else None)
        keep = pa.array([o is not None for o in out], pa.bool_())
        good = [o for o in out if o is not None]
        rest = batch.filter(keep)
        yield pa.RecordBatch.from_arrays(
            [rest.column("doc_id"), rest.column("doc_key"), rest.column("item_id"),
             pa.array([int(o[0]) for o in good], pa.int64()), pa.array([int(o[1]) for o in good], pa.int64())],
            names=["doc_id", "doc_key", "item_id", "low", "high"])


def _bit_table(items: DataFrame) -> np.ndarray:
    """The fixed table's bytes; the driver gets at most ``BITS / 64`` words."""
    spot = F.expr(f"pmod(print, {BITS})")  # two's complement: the same as for the unsigned value
    words = (items.groupBy(F.shiftright(spot, 6).alias("w"))
             .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(print, 64) as int))")).alias("b")).toPandas())
    table = np.zeros(BITS // 64, dtype=np.int64)
    table[words["w"].to_numpy(dtype=np.int64)] = words["b"].to_numpy(dtype=np.int64)
    return table.view(np.uint8)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, doc_key, n_words, n_hit, n_items, items_sha256, contaminated and spans of every row of ``docs``.

    ``spans`` are the hit stretches of words, joined and in order.  ``doc_key``
    is the hash of id and text by which rows are told apart.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.mapInArrow(_scan(list(range(1, WINDOW)), None, ("item_id",)),
                             f"item_id string, n_words long, prints {_PRINTS}")
    items = stored(items.select("item_id", F.explode("prints").alias("p")).select(
        "item_id", "p.print", "p.length", F.col("p.around").alias("y")), "items")
    lengths = sorted(r[0] for r in items.select("length").where(F.col("length") < WINDOW).distinct().collect())
    bits = spark.sparkContext.broadcast(_bit_table(items))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("doc_key"),
                       F.col("text").cast("string").alias("text"))
    base = stored(base.mapInArrow(_scan(lengths, bits, ("doc_id", "doc_key")),
                                  f"doc_id long, doc_key long, n_words long, prints {_PRINTS}"), "prints")
    prints = base.where(F.size("prints") > 0).select("doc_id", "doc_key", F.explode("prints").alias("p")).select(
        "doc_id", "doc_key", "p.print", "p.length", "p.at", F.col("p.around").alias("x"))
    met = stored(prints, "marked").join(items, ["print", "length"])
    spans = stored(met.mapInArrow(_extend, "doc_id long, doc_key long, item_id string, low long, high long"), "spans")
    by_doc = spans.groupBy("doc_id", "doc_key").agg(
        F.sort_array(F.collect_set(F.struct("low", "high"))).alias("s"),
        F.sort_array(F.collect_set("item_id")).alias("items"))
    joined = F.expr("""aggregate(s, cast(array() as array<struct<low:bigint,high:bigint>>), (a, x) ->
        case when size(a) > 0 and x.low <= element_at(a, -1).high
             then concat(slice(a, 1, size(a) - 1), array(struct(
                  element_at(a, -1).low as low, greatest(element_at(a, -1).high, x.high) as high)))
             else concat(a, array(x)) end)""")
    by_doc = by_doc.select(F.col("doc_id").alias("_id"), F.col("doc_key").alias("_key"), joined.alias("spans"),
                           F.size("items").cast("long").alias("n_items"),
                           F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"))
    by_doc = stored(by_doc, "hits")
    rows = base.select("doc_id", "doc_key", "n_words").join(
        by_doc, (F.col("doc_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    hit = F.coalesce(F.expr("aggregate(spans, 0L, (a, x) -> a + x.high - x.low)"), F.lit(0).cast("long"))
    return rows.withColumn("n_hit", hit).select(
        "doc_id", "doc_key", "n_words", "n_hit", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.lit(SHARE) * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "spans")
