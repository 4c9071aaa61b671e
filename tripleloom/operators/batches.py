"""Row batches of a bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows per batch and seed of the split.
BATCH_ROWS = 200_000
BATCH_SEED = 42


def batch_count(rows: int, batch_rows: int = BATCH_ROWS) -> int:
    """Number of batches for a table of ``rows`` rows; never zero."""
    return rows // batch_rows + 1


def with_batch(frame: DataFrame, rows: int | None = None, batch_rows: int = BATCH_ROWS,
               seed: int = BATCH_SEED) -> DataFrame:
    """Adds ``batch``, a seeded random batch number, in the pass that reads the rows.

    Batches hold about ``batch_rows`` rows each.  One column replaces a list of
    separately re-scanned splits; ``partitionBy('batch')`` writes them apart.
    """
    total = frame.count() if rows is None else rows
    number = F.floor(F.rand(seed) * batch_count(total, batch_rows)).cast("long")
    return frame.withColumn("batch", number)
