"""Compares queries with their SQL in DuckDB; also usable as a script:

    python tests/oracle_check.py [folder] [name part]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i].lower())
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def differences(spark, con, name, run, sql, sf_dir):
    """Empty when both sides give the same columns and the same bag of rows."""
    frame = run(spark, sf_dir)
    result = con.sql(sql)
    mine, theirs = frame.columns, result.columns
    if sorted(c.lower() for c in mine) != sorted(c.lower() for c in theirs):
        return f"columns {sorted(mine)} / {sorted(theirs)}", 0
    left, right = bag(mine, map(tuple, frame.collect())), bag(theirs, result.fetchall())
    if left != right:
        return f"only here {list((left - right).items())[:3]}\n  only SQL {list((right - left).items())[:3]}", 0
    return "", sum(left.values())


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as driver

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    wanted = argv[2] if len(argv) > 2 else ""
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), driver.oracle_sql(), []
    for name, run in driver.queries().items():
        if wanted not in name or name not in sqls:
            continue
        start = time.time()
        try:
            problem, rows = differences(spark, con, name, run, sqls[name], sf_dir)
        except Exception as error:  # shown with its query, the rest goes on
            problem, rows = f"{type(error).__name__}: {str(error)[:600]}", 0
        print(f"{'FAIL' if problem else 'ok'} {name} rows={rows} {time.time() - start:.1f}s {problem}", flush=True)
        bad += [name] if problem else []
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv)
