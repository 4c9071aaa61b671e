import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tripleloom.llm import reshard as module
from tripleloom.llm.reshard import equal_capacities, lay_out, reshard, rewrite, transfers, write_affected

SCHEMA = "doc_id long, text string, home string, size string, shard int"


def test_transfers_move_the_fewest_bytes():
    draw = random.Random(2)
    for _ in range(200):
        old = {i: draw.choice([0, 5, draw.randrange(100)]) for i in draw.sample(range(8), draw.randrange(1, 7))}
        new = {j: draw.randrange(60) for j in draw.sample(range(8), draw.randrange(1, 7))}
        if sum(old.values()) > sum(new.values()):
            with pytest.raises(ValueError):
                transfers(old, new)
            continue
        flow = transfers(old, new)
        assert all(sum(v for (i, _), v in flow.items() if i == k) == n for k, n in old.items())
        assert all(sum(v for (_, j), v in flow.items() if j == k) <= n for k, n in new.items())
        # A byte can stay only where its shard has room for it.
        assert sum(v for (i, j), v in flow.items() if i == j) == sum(min(n, new.get(i, 0)) for i, n in old.items())


def check(rows, plan, shards):
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in plan) == sorted(
        (r[0] or -1, len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    slots, sizes = defaultdict(list), dict.fromkeys(range(shards), 0)
    for r in plan:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None and r.moved == (r.shard != r.old_shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    return sizes


@pytest.mark.parametrize("rows_per_block", [5_000, 7])
def test_documents(spark, monkeypatch, rows_per_block):
    monkeypatch.setattr(module, "BLOCK_ROWS", rows_per_block)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plan = reshard(docs, F.pmod(F.crc32(F.col("source").cast("binary")), F.lit(12)), 10).collect()
    sizes = check([tuple(r) for r in docs.select("doc_id", "text").collect()], plan, 10)
    largest = max(r.size for r in plan)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest
    old = defaultdict(int)
    for r in plan:
        old[r.old_shard] += r.size
    fewest = sum(old.values()) - sum(v for (i, j), v in transfers(
        old, equal_capacities(sum(old.values()), 10)).items() if i == j)
    assert abs(sum(r.size for r in plan if r.moved) - fewest) <= 12 * largest


def test_nothing_moves_where_capacities_fit(spark, tmp_path):
    rows = [(i, "x" * (i % 50), str(i % 4), "s", 1) for i in range(400)]
    docs = lay_out(spark.createDataFrame(rows, SCHEMA), F.col("home"))
    sizes = defaultdict(int)
    for r in rows:
        sizes[int(r[2])] += len(r[1]) + 16
    same = reshard(docs, None, 4, dict(sizes))
    assert same.where("moved").isEmpty()
    sizes[4] = sizes[3]
    sizes[3] = 0
    plan = reshard(docs, None, 5, dict(sizes))
    assert {(r.old_shard, r.shard) for r in plan.where("moved").collect()} == {(3, 4)}
    affected = write_affected(docs, plan, str(tmp_path / "new"))
    assert sorted(r[0] for r in affected.collect()) == [3, 4]
    back = spark.read.parquet(str(tmp_path / "new"))
    assert {(r.doc.doc_id, r.shard) for r in back.collect()} == {(r[0], 4) for r in rows if r[2] == "3"}


def test_odd_rows(spark):
    rows = [(1, None, "0", "s", 1), (1, None, "0", "s", 1), (None, "", None, "s", 1), (2, "é" * 100_000, "1", "s", 1),
            (3, "same", "1", "s", 1), (3, "same", "1", "s", 1), (None, "same", "9", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    check(rows, reshard(docs, F.col("home"), 3).collect(), 3)
    assert reshard(docs.limit(0), F.col("home"), 3).collect() == []


def test_rewritten_shards_hold_the_same_rows(spark, tmp_path):
    """Int, null and repeated ids, rows that differ in another column only, clashing names, one shard with most rows."""
    rows = [(i % 50 if i % 7 else None, None if i % 11 == 0 else "t" * (i % 5), "0" if i % 3 else str(i % 4), "x", i % 2, i % 3)
            for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, home string, size string, shard int, row_id int")
    laid = lay_out(docs, F.col("home"))
    plan = reshard(laid, shards=6)
    affected = {r.shard for r in write_affected(laid, plan, str(tmp_path / "new")).collect()}
    assert affected >= set(range(6))
    back = spark.read.parquet(str(tmp_path / "new"))
    key = lambda r: str(tuple(r))
    assert sorted((r.doc for r in back.collect()), key=key) == sorted(docs.collect(), key=key)
    placed = {r.row_id: (r.shard, r.slot) for r in plan.collect()}
    assert all(placed[r.row_id] == (r.shard, r.slot) for r in back.collect())
    check(rows, rewrite(laid, plan).collect(), 6)
    none = lay_out(docs.limit(0), F.col("home"))
    assert rewrite(none, reshard(none, shards=6)).collect() == []


def test_shards_left_alone_are_read_from_their_old_files(spark):
    rows = [(i, "x" * (i % 50), str(i % 4), "s", 1) for i in range(400)]
    sizes = defaultdict(int)
    for r in rows:
        sizes[int(r[2])] += len(r[1]) + 16
    sizes[4], sizes[3] = sizes[3], 0
    laid = lay_out(spark.createDataFrame(rows, SCHEMA), F.col("home"))
    got = rewrite(laid, reshard(laid, None, 5, dict(sizes))).collect()
    check(rows, got, 5)
    assert {(r.old_shard, r.shard) for r in got} == {(0, 0), (1, 1), (2, 2), (3, 4)}


def test_equal_rows_are_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK_ROWS", 100)
    made = []
    monkeypatch.setattr(module, "stored", lambda frame, label: made.append((label, frame)) or real(frame, label))
    real = __import__("tripleloom.llm.store", fromlist=["stored"]).stored
    docs = spark.range(5_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.lit("0").alias("home"))
    reshard(docs, F.col("home"), 3).count()
    places = next(frame for label, frame in made if label == "places")
    assert places.groupBy("old_shard", "kind", "block").count().agg(F.max("count")).first()[0] < 200
