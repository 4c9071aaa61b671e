import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tripleloom.llm.bestfit import LENGTH, Slots, best_fit, pack_best_fit, plan

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, block int, length string, rank int"


def one_by_one(counts, size):
    """Rooms of the sequences when every piece by itself goes to the fullest one that holds it."""
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [r for r in rooms if r >= length]
            room = min(fits) if fits else size
            if fits:
                rooms.remove(room)
            rooms.append(room - length)
    return sorted(rooms)


def test_plan_is_best_fit():
    draw = random.Random(5)
    for _ in range(300):
        size = draw.choice([7, 16, 40])
        counts = {n: draw.choice([1, 2, 9, 40]) for n in draw.sample(range(1, size + 1), draw.randrange(1, 7))}
        slots = plan(counts, size)
        used, taken = defaultdict(int), Counter()
        for s in slots:
            taken[s.length] += s.high - s.low
            for rank in range(s.low, s.high):
                at = s.sequence + (rank - s.low) // s.per
                assert used[at] == s.offset + (rank - s.low) % s.per * s.length  # gapless
                used[at] += s.length
        assert taken == counts and sorted(used) == list(range(len(used)))
        assert sorted(size - u for u in used.values()) == one_by_one(counts, size)


def test_plan_does_not_grow_with_counts():
    draw = random.Random(6)
    counts = {n: draw.randrange(1, 50) for n in range(1, LENGTH + 1)}
    few, many = len(plan(counts)), len(plan({n: c * 1_000_003 for n, c in counts.items()}))
    assert many < 60_000 and few < 60_000
    assert plan({}) == [] and plan({LENGTH: 3}) == [Slots(LENGTH, 0, 3, 0, 1, 0)]


def check(rows, docs, size=LENGTH):
    model = Tokenizer.from_file(PATH)
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for s in sequences.values():
        ends = [0, *(a + n for a, n in sorted(s))]
        assert [a for a, _ in sorted(s)] == ends[:-1] and ends[-1] <= size
    for doc_id, texts in docs.items():
        got = Counter((r.piece, r.start, r.length, r.ids_crc32) for r in pieces.pop(doc_id))
        want = Counter()
        for text in texts:
            ids = [*model.encode(text or "", add_special_tokens=False).ids, 0]
            cuts = [0, *range((len(ids) - 1) % size + 1, len(ids) + 1, size)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                want[k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
        assert got == want
    assert not pieces
    return len(sequences)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(7)
    rows = pack_best_fit(docs, PATH, added=True).collect()
    made = check(rows, {r.doc_id: [r.text] for r in docs.collect()})
    assert made == -(-sum(r.length for r in rows) // LENGTH)  # not one more than the tokens need
    assert all(zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 for r in rows)


def test_odd_rows(spark):
    rows = [(1, None), (1, None), (None, "a"), (2, ""), (3, "b <|endoftext|> c"), (4, " word" * 50_000), (4, " word" * 50_000),
            *[(10 + i, "same text") for i in range(300)], (5, "x " * (LENGTH - 1)), (6, " a" * (LENGTH - 1)), (7, " a" * LENGTH)]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    texts = defaultdict(list)
    for doc_id, text in rows:
        texts[doc_id].append(text)
    packed = pack_best_fit(docs, PATH, with_ids=False, added=True)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    check(packed.collect(), texts)
    assert pack_best_fit(docs.limit(0), PATH).collect() == []


def test_pieces_of_one_length(spark):
    pieces = spark.range(0, 5_000, 1, 9).select(
        F.col("id").alias("doc_id"), F.lit(700).cast("long").alias("length"), F.spark_partition_id().alias("block"),
        F.monotonically_increasing_id().bitwiseAND(2**33 - 1).alias("place"))
    got = best_fit(pieces)
    assert got.groupBy("sequence_id").agg(F.count("*").alias("n"), F.countDistinct("offset").alias("d")).where("n = 2 and d = 2").count() == 2_500
