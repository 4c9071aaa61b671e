"""Best-fit packing planned over counts of lengths.

Documents are tokenized and those longer than a sequence cut; of the pieces only
the number per length goes to the driver, one row per possible length.  There
best fit is carried out over counts: lengths from the longest down go to the
fullest sequences that still hold them, many at once.  Sequences in the same
state are a range of numbers, so the plan has rows for ranges of equal pieces,
not for pieces.  Pieces are numbered within their length, and each takes the
slot planned for its number.

Numbers come from counting per stored task and length and running sums over the
tasks, so that no task sees all pieces of a length.

A null text is empty and gives the end token alone.  Repeated rows give pieces
of their own.  Without documents there are no sequences.  Extra columns are not
read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tripleloom.llm.packing import encoder
from tripleloom.llm.store import small_batches, stored

LENGTH = 2048


class Slots(NamedTuple):
    """Places for the pieces ``low`` to ``high`` of a length: ``per`` in each sequence, from ``sequence`` and ``offset`` on."""

    length: int
    low: int
    high: int
    sequence: int
    per: int
    offset: int


def plan(counts: dict[int, int], size: int = LENGTH) -> list[Slots]:
    """Best fit, longest first, of ``counts`` pieces per length into sequences of ``size``.

    A length takes the ranges of sequences with the least room that is enough;
    as a filled one has still less room, it is filled up before the next one.
    Each length splits one range, so ranges number a few times the lengths; a
    range serves fewer than sqrt(2 * size) lengths, as these differ and add up to
    ``size`` at most.  The plan is bounded by ``size`` alone, whatever the counts.
    """
    rooms: list[int] = []  # ascending, those of which there are ranges
    free: dict[int, list[tuple[int, int]]] = {}  # room -> ranges (first sequence, number of them)
    out, made = [], 0

    def put(room: int, first: int, many: int) -> None:
        if room and many:
            if room not in free:
                free[room] = []
                insort(rooms, room)
            free[room].append((first, many))

    for length in sorted(counts, reverse=True):
        low, total = 0, counts[length]
        if length < 1 or length > size:
            raise ValueError("pieces must have 1 to size tokens")
        while low < total:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, many = free[room].pop()
                if not free[room]:
                    del free[room]
                    rooms.pop(at)
            else:
                room, first, many = size, made, -(-(total - low) // (size // length))
                made += many
            per = room // length
            full = min(many, (total - low) // per)
            if full:
                out.append(Slots(length, low, low + full * per, first, per, size - room))
                low += full * per
                put(room - per * length, first, full)
            rest = total - low
            if full < many and rest:  # fewer than a sequence takes: the last of this length
                out.append(Slots(length, low, total, first + full, per, size - room))
                put(room - rest * length, first + full, 1)
                low, full = total, full + 1
            put(room, first + full, many - full)
    return out


def _pieces(path: str, size: int, with_ids: bool, added: bool):
    def run(batches):
        encode = encoder(path, added)
        seen = np.zeros(size + 1, dtype=np.int64)
        block = TaskContext.get().partitionId()
        for batch in batches:
            ids, bounds = encode(batch.column("text"))
            ids = ids.astype("<u4")
            tokens = np.diff(bounds)
            many = -(-tokens // size)
            text = np.repeat(np.arange(len(tokens)), many)
            number = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
            first = tokens[text] - (many[text] - 1) * size  # the first piece takes what is over
            start = np.where(number == 0, 0, first + (number - 1) * size)
            length = np.where(number == 0, first, size)
            low = bounds[:-1][text] + start
            view = memoryview(ids).cast("B")
            crc = [zlib.crc32(view[4 * a:4 * (a + n)]) for a, n in zip(low.tolist(), length.tolist(), strict=True)]
            # Place among the task's earlier pieces of the same length.
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order)) - np.searchsorted(ranked, ranked) + seen[ranked]
            np.add.at(seen, length, 1)
            columns = {
                "doc_id": batch.column("doc_id").take(pa.array(text, pa.int64())),
                "piece": pa.array(number.astype(np.int32)), "start": pa.array(start), "length": pa.array(length),
                "ids_crc32": pa.array(crc, pa.int64()),
                "block": pa.array(np.full(len(text), block, dtype=np.int32)), "place": pa.array(place)}
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum(length)])
                own = np.repeat(low - offsets[:-1], length) + np.arange(offsets[-1])
                columns["ids"] = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids[own].astype(np.int32)))
            yield pa.RecordBatch.from_pydict(columns)
    return run


def cut(docs: DataFrame, tokenizer: str, size: int = LENGTH, with_ids: bool = True, added: bool = False) -> DataFrame:
    """Pieces of all documents, each with the stored task it is from and its place there among those of its length."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long, block int, place long"
    return stored(base.mapInArrow(_pieces(tokenizer, size, with_ids, added), fields + (", ids array<int>" if with_ids else "")),
                  "best-fit-pieces")


def best_fit(pieces: DataFrame, size: int = LENGTH) -> DataFrame:
    """``pieces`` as ``cut`` gives them, with sequence_id and offset in place of block and place."""
    spark = pieces.sparkSession
    blocks = stored(pieces.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n")), "best-fit-blocks")
    before = F.sum("n").over(W.partitionBy("length").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    blocks = blocks.select("length", "block", "n", F.coalesce(before, F.lit(0)).alias("before"))
    counts = {int(r.length): int(r.n) for r in blocks.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # size rows at most
    slots = F.broadcast(spark.createDataFrame(
        [tuple(s) for s in plan(counts, size)], "_length long, low long, high long, sequence long, per long, at long"))
    ranked = pieces.join(blocks.select("length", "block", "before"), ["length", "block"]).withColumn(
        "rank", F.col("before") + F.col("place"))
    placed = ranked.join(slots, (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    nth = F.col("rank") - F.col("low")
    kept = [c for c in pieces.columns if c not in ("block", "place")]
    return placed.select(
        *kept, (F.col("sequence") + F.floor(nth / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("at") + nth % F.col("per") * F.col("length")).cast("long").alias("offset"))


def pack_best_fit(docs: DataFrame, tokenizer: str, size: int = LENGTH, with_ids: bool = True, added: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids, sequence_id and offset of every piece of ``docs``.

    ``added`` keeps the ids of the tokenizer file's added tokens in texts.
    """
    small_batches(docs.sparkSession)
    return best_fit(cut(docs, tokenizer, size, with_ids, added), size)
