"""Resharding by minimum-cost flow.

Old shards supply their bytes, new shards take up to their capacity, and a byte
that stays costs nothing.  The flow between the shards, a network with one node
per shard, gives the transfers that move the fewest bytes.  A shard's documents
stand in a fixed order, large ones first, cut into blocks; running sums over
blocks and then within them give each document its place in bytes, and the
flow cuts this line into what stays and what goes where.  No task sees more
than a block's rows, however large a shard is.

Rows are known by numbers that the old layout's files hold, so equal rows stay
apart, are dealt over blocks like any others, and are rewritten each as it was.

Sizes are the UTF-8 bytes of the text plus 16; a null text has none.  A null
shard key is a shard of its own.  Repeated rows, null ids and ids of any integer
type are placed one by one.  Extra columns are not read for the plan and are
rewritten as they are, whatever their names.  Without rows nothing is written.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tripleloom.llm.store import stored
from tripleloom.session import scratch_dir

SHARDS = 40
#: Rows of a block, about.
BLOCK_ROWS = 5_000


def transfers(old: dict[int, int], new: dict[int, int]) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard, moving the fewest.

    Successive shortest paths; costs are 0 for a shard to itself and 1
    otherwise.  The network has a node per shard and does not grow with data.
    """
    if sum(old.values()) > sum(new.values()):
        raise ValueError("the new shards cannot hold the old ones' bytes")
    flow: dict[tuple[int, int], int] = {}
    supply, room = dict(old), dict(new)
    for i in sorted(set(old) & set(new)):  # paths of no cost
        stays = min(supply[i], room[i])
        if stays:
            flow[i, i] = stays
            supply[i] -= stays
            room[i] -= stays
    for start in sorted(supply):
        while supply[start]:
            # Nodes are ('o', i) and ('n', j); back along a flow costs what it saved.
            cost, way = {("o", start): 0}, {}
            queue = deque([("o", start)])
            while queue:
                node = queue.popleft()
                side, k = node
                if side == "o":
                    steps = [(("n", j), int(j != k)) for j in new]
                else:
                    steps = [(("o", i), -int(i != k)) for i in old if flow.get((i, k))]
                for other, price in steps:
                    if cost[node] + price < cost.get(other, 1 << 60):
                        cost[other], way[other] = cost[node] + price, node
                        queue.append(other)
            end = min((("n", j) for j in new if room[j] and ("n", j) in cost), key=lambda x: (cost[x], x[1]))
            path, node = [], end
            while node != ("o", start):
                path.append((way[node], node))
                node = way[node]
            amount = min([supply[start], room[end[1]], *(flow[b[1], a[1]] for a, b in path if a[0] == "n")])
            for a, b in path:
                if a[0] == "o":
                    flow[a[1], b[1]] = flow.get((a[1], b[1]), 0) + amount
                else:
                    flow[b[1], a[1]] -= amount
            supply[start] -= amount
            room[end[1]] -= amount
    return {k: v for k, v in flow.items() if v}


def equal_capacities(total: int, shards: int = SHARDS) -> dict[int, int]:
    return {j: total // shards + (j < total % shards) for j in range(shards)}


def lay_out(docs: DataFrame, old_shard: Column) -> DataFrame:
    """The old layout as files, a folder per old shard: row_id, doc (all columns of ``docs``) and old_shard.

    The numbers in ``row_id`` are written with the rows, so that every later
    reading of the files finds the same.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.struct("*").alias("doc"),
                       F.coalesce(old_shard.cast("int"), F.lit(-1)).alias("old_shard"))
    path = scratch_dir(spark, "llm-old-shards")
    rows.write.option("compression", "zstd").partitionBy("old_shard").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def reshard(docs: DataFrame, old_shard: Column | None = None, shards: int = SHARDS,
            capacities: dict[int, int] | None = None) -> DataFrame:
    """row_id, doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard and moved of every row.

    ``docs`` is a layout of ``lay_out``, or with ``old_shard`` documents that are
    laid out first.  ``capacities`` in bytes by new shard default to equal ones.
    """
    if old_shard is not None:
        docs = lay_out(docs, old_shard)
    text = F.coalesce(F.col("doc.text").cast("string"), F.lit(""))
    base = docs.select(
        "row_id", F.col("doc.doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "old_shard")
    base = stored(base.withColumn("kind", F.floor(F.log2("size")).cast("int")), "sizes")
    # One row per shard and power of two: at most 64 times the shards.
    kinds = base.groupBy("old_shard", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    kinds = kinds.select("old_shard", "kind", "bytes", F.ceil(F.col("n") / BLOCK_ROWS).alias("of")).toPandas()
    old = {int(k): int(v) for k, v in kinds.groupby("old_shard")["bytes"].sum().items()}
    flow = transfers(old, capacities or equal_capacities(sum(old.values()), shards))
    spark = docs.sparkSession
    of = F.broadcast(spark.createDataFrame(
        [(int(r.old_shard), int(r.kind), int(r.of)) for r in kinds.itertuples()], "old_shard int, kind int, of long"))
    block = ["old_shard", "kind", "block"]
    base = base.join(of, ["old_shard", "kind"]).withColumn("block", F.pmod(F.xxhash64("row_id"), "of")).drop("of")
    sums = base.groupBy(*block).agg(F.sum("size").alias("bytes"))
    line = W.partitionBy("old_shard").orderBy(F.desc("kind"), "block").rowsBetween(W.unboundedPreceding, -1)
    sums = stored(sums.select(*block, F.coalesce(F.sum("bytes").over(line), F.lit(0)).alias("first")), "blocks")
    within = W.partitionBy(*block).orderBy("row_id")
    placed = base.withColumn("at", F.coalesce(F.sum("size").over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = stored(placed, "places").join(sums, block).withColumn("middle", F.col("first") + F.col("at") + F.col("size") / 2)
    parts, at = [], {}
    for i, j in sorted(flow, key=lambda x: (x[0], x[0] != x[1], x[1])):  # what stays comes first
        low = at.get(i, 0)
        parts.append((i, low, low + flow[i, j], j))
        at[i] = low + flow[i, j]
    parts = F.broadcast(spark.createDataFrame(parts, "old_shard int, low long, high long, shard int"))
    placed = placed.join(parts, (placed.old_shard == parts.old_shard) & (F.col("middle") >= F.col("low"))
                         & (F.col("middle") < F.col("high"))).drop(parts.old_shard)
    placed = stored(placed.select("row_id", "doc_id", "size", "text_crc32", *block, "at", "shard"), "assigned")
    counts = placed.groupBy("shard", *block).agg(F.count(F.lit(1)).alias("n"))
    line = W.partitionBy("shard").orderBy("old_shard", F.desc("kind"), "block").rowsBetween(W.unboundedPreceding, -1)
    counts = stored(counts.select("shard", *block, F.coalesce(F.sum("n").over(line), F.lit(0)).alias("before")), "counts")
    within = W.partitionBy("shard", *block).orderBy("at", "row_id")
    slots = placed.withColumn("number", F.row_number().over(within)).join(counts, ["shard", *block])
    return slots.select(
        "row_id", "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("number") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "old_shard", (F.col("old_shard") != F.col("shard")).alias("moved"))


def write_affected(laid: DataFrame, plan: DataFrame, path: str) -> DataFrame:
    """Writes the new shards that gain or lose documents, one folder each; gives their numbers.

    ``laid`` is the layout that ``plan`` was made from.  Files hold row_id, slot
    and doc, all columns of a document.  A shard that the plan leaves as it was
    keeps its old files.  Rows meet their place by ``row_id``, which no two share,
    so whatever repeats, every task gets an even part.  The places grow with the
    rows and are therefore never broadcast.
    """
    moves = plan.where("moved")
    affected = stored(moves.select("shard").union(moves.select(F.col("old_shard").alias("shard"))).distinct(), "affected")
    places = plan.join(F.broadcast(affected), "shard", "left_semi").select("row_id", "shard", "slot")
    rows = laid.select("row_id", "doc").join(places.hint("merge"), "row_id")
    rows.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return affected


_WRITTEN = "row_id long, slot long, doc struct<text: string>, shard int"


def rewrite(laid: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with shard, slot and text_crc32 as the files hold them once affected shards are rewritten.

    Rows of affected shards are read from the new files, the others from the
    old ones, where their shard is the old one.
    """
    spark = laid.sparkSession
    plan, path = stored(plan, "plan"), scratch_dir(spark, "llm-new-shards")
    affected = F.broadcast(write_affected(laid, plan, path))
    crc = F.crc32(F.coalesce(F.col("doc.text").cast("string"), F.lit("")).cast("binary")).alias("text_crc32")
    written = spark.read.schema(_WRITTEN).parquet(path).select("row_id", "shard", "slot", crc)
    kept = laid.withColumnRenamed("old_shard", "shard").join(affected, "shard", "left_anti").select("row_id", "shard", crc)
    rest = plan.drop("shard", "slot", "text_crc32")
    slots = plan.join(affected, "shard", "left_anti").select("row_id", "slot")
    found = written.unionByName(kept.join(slots, "row_id").select(written.columns))
    return rest.join(found, "row_id").select(plan.columns)
