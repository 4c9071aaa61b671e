import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tripleloom.llm import trie as module
from tripleloom.llm.oracle import TRIE
from tripleloom.llm.trie import Peeler, prefix_trie, rebuilt, turn_lists

SCHEMA = "conv_id long, turn long, role string, text string, place int, keys string"


def brute(rows):
    """The nodes by their definition."""
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    paths = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(turns.get(c - c % 100, [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[:len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        ended = ",".join(str(c) for c in sorted(convs) if paths[c] == node)
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids),
                    sum(not any(m[:len(n)] == n and len(m) > len(n) for m in below) for n in below),
                    sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n), hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=str)


def drawn(seed, n=150):
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(900), n):
        for i in range(draw.choice([1, 2, 3, 5, 8, 12])):
            turn = draw.choice([i, i, i, 2, None])
            rows.append((c, turn, draw.choice(["user", "assistant", None]), draw.choice(["", "a", "é" * 5, None, "b c"]), 1, "x"))
    return rows


@pytest.mark.parametrize("batch", [3, 1000])
def test_drawn_conversations(spark, monkeypatch, batch):
    monkeypatch.setattr(module, "small_batches", lambda s: s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch))
    rows = drawn(batch) + [(950, i, "user", f"long {i // 200}", 1, "x") for i in range(150)]
    rows += [(950 + k, i, "user", f"long {i // 200}", 1, "x") for k in (1, 2) for i in range(140 + k)]
    got = prefix_trie(rebuilt(turn_lists(spark.createDataFrame(rows, SCHEMA).repartition(5))))
    assert set(got.dtypes) == {("ends_sha256", "string"), *((c, "bigint") for c in got.columns[:-1])}
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(rows)


def test_whole_families(spark):
    """Every id of some families, equal conversations in numbers that one run of ids does not hold, odd rows."""
    rows = [(c, 0, "user", "hello", 1, "x") for c in range(9_000)] + [(c, 1, "user", str(c % 7), 1, "x") for c in range(0, 9_000, 3)]
    rows += [(None, 0, "user", "nobody", 1, "x"), (20_000, None, None, None, 1, "x"), (20_000, None, None, None, 1, "x")]
    got = {(r.conv_id, r.depth): r for r in prefix_trie(rebuilt(turn_lists(spark.createDataFrame(rows, SCHEMA)))).collect()}
    root = got[0, 0]
    assert root.n_convs == 9_001 and root.parent_conv_id is None and root.n_leaves == sum(r.n_children == 0 for r in got.values())
    paths = {}
    for c in [*range(9_000), 20_000]:
        own = ["hello"] + ([str(c % 7)] if c % 3 == 0 else []) if c < 9_000 else ["", ""]
        home = ["hello"] + ([str((c - c % 100) % 7)] if (c - c % 100) % 3 == 0 else []) if c < 9_000 else own
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(home[:h] + own[h:])
    hello = [c for c, p in paths.items() if p == ("hello",)]
    assert got[min(c for c, p in paths.items() if p[:1] == ("hello",)), 1].ends_sha256 == hashlib.sha256(
        ",".join(map(str, hello)).encode()).hexdigest()


def test_sql_over_the_same_rows(spark):
    rows = drawn(9, 60)
    frame = spark.createDataFrame(rows, SCHEMA)
    con = duckdb.connect()
    con.register("conversations", frame.drop("place", "keys").toPandas().astype({"turn": "Int64"}))
    got = prefix_trie(rebuilt(turn_lists(frame)))
    assert sorted([tuple(r) for r in con.sql(TRIE).fetchall()], key=str) == sorted([tuple(r) for r in got.collect()], key=str)


def test_no_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefix_trie(rebuilt(turn_lists(none))).collect() == []
    assert prefix_trie(rebuilt(turn_lists(none.union(spark.createDataFrame([(None, 1, "a", "b", 1, "x")], SCHEMA))))).collect() == []


def test_ranges_hand_up_at_most_two_rows():
    paths = sorted([b"%03d" % k for k in range(j)] + [b"x%d" % i for i in range(i)] for i in range(40) for j in (0, 3, 60))
    peeler = Peeler(False)
    done = []
    for low in range(0, len(paths), 7):
        done += peeler.take([dict(keys=p, sizes=[1] * len(p), at=[dict(depth=len(p), n=1, conv_id=0, children=0, leaves=0, saved=0)])
                             for p in paths[low:low + 7]])
    nodes, rows = peeler.finish()
    assert not nodes and len(rows) <= 2
    assert len(done) + sum(len(r["at"]) for r in rows) == len({(len(p[:d]), p[d - 1] if d else b"") for p in paths for d in range(len(p) + 1)})
