"""Connected components by contraction, in Spark tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.store import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), with the least node of its component as root.

    Each round hangs every node below its least neighbour, follows those
    pointers, and keeps the edges between the roots that remain.  A node that
    is not the least around it vanishes, so rounds grow as the logarithm of the
    component sizes.  A node's many edges meet only in a combined minimum and
    in joins of two stored tables, which Spark splits where a key is hot.
    """
    both = edges.select("a", "b").where("a <> b")
    both = stored(both.union(both.select("b", "a")).distinct(), "edges")
    roots = None
    while not both.isEmpty():
        up = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("up")), "up")
        for _ in range(2):
            above = up.select(F.col("a").alias("up"), F.col("up").alias("top"))
            up = stored(up.join(above, "up", "left").select("a", F.coalesce("top", "up").alias("up")), "up")
        if roots is None:
            roots = up.select(F.col("a").alias("node"), F.col("up").alias("root"))
        else:
            step = up.select(F.col("a").alias("root"), F.col("up").alias("top"))
            roots = stored(roots.join(step, "root", "left").select("node", F.coalesce("top", "root").alias("root")),
                           "roots")
        left = both.join(up, "a").select(F.col("up").alias("u"), "b")
        right = up.select(F.col("a").alias("b"), F.col("up").alias("v"))
        both = stored(stored(left, "half").join(right, "b").where("u <> v")
                      .select(F.col("u").alias("a"), F.col("v").alias("b")).distinct(), "edges")
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    return roots
