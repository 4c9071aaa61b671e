"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query runs to a sink that takes all rows and columns.  Times include
planning.  ``triples_per_sec`` is the fused sales graph (customer, orders,
lineitem) as a set, rendered as N-Triples statements.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

from tripleloom.catalog import QUERIES  # noqa: E402
from tripleloom.catalog.maps import register_graph  # noqa: E402
from tripleloom.catalog.registry import table  # noqa: E402
from tripleloom.catalog.rules import SALES_MAPS, graph_of  # noqa: E402
from tripleloom.catalog.standin import CODES, bronze_frames  # noqa: E402
from tripleloom.operators.triples import build_graph  # noqa: E402
from tripleloom.plans.register_mapping import REGISTER_MAPS  # noqa: E402
from tripleloom.plans.silver import silver_tables  # noqa: E402
from tripleloom.session import prepare, scratch_dir  # noqa: E402
from tripleloom.sources.tables import table_loader, write_tables  # noqa: E402

SALES = [m for m in SALES_MAPS if m.table in ("customer", "orders", "lineitem")]
NAMED = (
    "bronze_scan", "full_refresh", "load_manifest", "snapshot_changes", "snapshot_changes_bag",
    "normalize_uri_text", "normalize_uri_types", "strip_accents", "triples_customer", "triples_orders",
    "triples_lineitem", "graph_distinct", "reconcile", "ntriples_lines", "silver_entity", "silver_branch",
    "silver_partner_person", "silver_person", "silver_address", "map_establishment", "register_graph",
)


def drain(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = prepare(
        SparkSession.builder.master(f"local[{cpus}]").appName("tripleloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, run):
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)

    drain(QUERIES["triples_nation"](spark, sf_dir))  # starts the session's workers and caches
    for name in NAMED:
        timed(name, lambda: drain(QUERIES[name](spark, sf_dir)))

    timed("sales_graph_lines", lambda: drain(graph_of(spark, sf_dir, SALES).distinct().lines()))
    # The driver files have one row group each, so their scans are one task; a cluster's are not.
    split = {m.table: table(spark, sf_dir, m.table).repartition(int(cpus)) for m in SALES}
    timed("sales_graph_lines_split_input", lambda: drain(
        graph_of(spark, sf_dir, SALES, tables=split).distinct().lines()))
    triples = graph_of(spark, sf_dir, SALES).distinct().predicate_counts().agg(F.sum("triples")).first()[0]

    base = scratch_dir(spark, "bench")
    timed("silver_write", lambda: write_tables(silver_tables(bronze_frames(spark, sf_dir), CODES), base))
    timed("register_lines_from_silver", lambda: drain(
        build_graph(spark, REGISTER_MAPS, table_loader(spark, base)).distinct().lines()))
    timed("register_lines_from_bronze", lambda: drain(register_graph(spark, sf_dir).distinct().lines()))

    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": int(cpus),
        "sales_triples": triples, "triples_per_sec": round(triples / times["sales_graph_lines"]),
        "triples_per_sec_split_input": round(triples / times["sales_graph_lines_split_input"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
