"""Session settings and the scratch folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from tripleloom.operators.joins import planned_bytes

# Shuffled bytes one task should handle, and the most tasks of a shuffle: every map task keeps an index
# of that length and the driver one entry per pair, so beyond it partitions grow and spill.
SHUFFLE_BYTES = 128 * 1024 * 1024
MOST_PARTITIONS = 20_000
# Shuffled bytes of one task beyond which a graph is published in several passes.
MOST_TASK_BYTES = 1024 * 1024 * 1024

# Runtime settings the plans rely on; all can be set on a live session.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def fit_shuffle(spark: SparkSession, stored: Iterable[DataFrame], growth: float = 1.0) -> int:
    """Raises the number of shuffle partitions to fit what stored tables will shuffle.

    ``stored`` are plain scans, whose sizes the optimizer knows from the files.
    Adaptive execution merges partitions that turn out small, so the number is
    only ever raised.
    """
    total = sum(planned_bytes(frame) for frame in stored)
    needed = min(int(total * growth // SHUFFLE_BYTES) + 1, MOST_PARTITIONS)
    number = max(needed, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spark.conf.set("spark.sql.shuffle.partitions", number)
    return number


def passes_needed(stored: Iterable[DataFrame], growth: float = 1.0) -> int:
    """Passes that keep each task of the widest shuffle of what stored tables give within ``MOST_TASK_BYTES``."""
    total = int(sum(planned_bytes(frame) for frame in stored) * growth)
    return total // (MOST_PARTITIONS * MOST_TASK_BYTES) + 1


def run_together(actions: Iterable[Callable[[], None]], at_once: int = 4) -> None:
    """Runs independent Spark actions a few at a time, so one's last tasks overlap the next's first."""
    with ThreadPoolExecutor(at_once) as pool:
        for done in [pool.submit(action) for action in actions]:
            done.result()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder path for one run's written tables.

    The cluster names its shared folder in ``spark.checkpoint.dir``; a local
    folder is only made where that is unset, as in tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tripleloom-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
