import random
import re
from collections import defaultdict

import pytest

from tripleloom.llm.components import components
from tripleloom.llm.minmax import LOSS, near_duplicates, plan

SCHEMA = "doc_id long, text string, n_shingles string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows, similarity=85):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    pairs = {(i, j) for ids in where.values() for i in ids for j in ids if i < j}
    for i, j in pairs:
        both = len(sets[i] & sets[j])
        if 100 * both >= similarity * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    return sorted(((r[0], len(s), min(least[find(i)]), min(least[find(i)]) == r[0])
                   for i, (r, s) in enumerate(zip(rows, sets, strict=True))))


def mutants(seed=3):
    """Groups around a base text, whose members are near the base but not always near each other."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for size, edits in ((40, 1), (700, 2), (30, 3), (30, 4), (30, 5)):
        base = draw.choices(vocabulary, k=150)
        for _ in range(size):
            words = list(base)
            for _ in range(edits):
                words[draw.randrange(150)] = draw.choice(vocabulary)
            rows.append(" ".join(words))
        rows.append(" ".join(base))
    rows += [rows[0].upper(), rows[0] + "  ", "", " \t", "a", "A", "a b c", "A  b C", "a b c d", "x " * 3000]
    rows += [" ".join(draw.choices(vocabulary, k=draw.randrange(1, 60))) for _ in range(200)]
    draw.shuffle(rows)
    return [(i, t, "clash") for i, t in enumerate(rows)]


def result(frame):
    return sorted(tuple(r) for r in frame.select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_groups_as_brute_force(spark):
    rows = mutants()
    assert result(near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_null_and_repeated_rows(spark):
    rows = [(1, "a b c d e f", "-"), (1, "a b c d e f", "-"), (None, "a b c d e f", "-"), (4, None, "-"),
            (5, None, "-"), (None, None, "-"), (None, "only here", "-")]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    seen = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in got)
    assert seen == [(0, 0, 0, True), (0, 1, 0, True), (0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True),
                    (4, 0, 4, True), (5, 0, 5, True)]


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_documents(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert result(near_duplicates(docs)) == brute(rows)


def test_components_of_a_chain(spark):
    order = list(range(300))
    random.Random(1).shuffle(order)
    edges = list(zip(order[:-1], order[1:], strict=True)) + [(1000, 1001), (1001, 1002), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{n: 0 for n in order}, 1000: 1000, 1001: 1000, 1002: 1000}


@pytest.mark.parametrize("similarity", [70, 85, 95])
def test_pairs_at_the_wanted_similarity(spark, similarity):
    """Pairs that share s of s + 2 (100 - s) / 2 shingles are linked, those that share one shingle less are not."""
    rows = []
    for pair in range(800):
        shared, own = 2 * similarity - pair % 2, 100 - similarity
        for side in "ab":
            words = [f"c{pair}x{i}" for i in range(shared + 4)] + [f"{side}{pair}x{i}" for i in range(own)]
            rows.append((len(rows), " ".join(words), None))
    found = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), similarity).collect()}
    missed = [p for p in range(0, 800, 2) if found[2 * p + 1] != 2 * p]
    wrong = [p for p in range(1, 800, 2) if found[2 * p + 1] == 2 * p]
    assert not missed and not wrong


def test_the_plan_follows_from_the_similarity():
    assert plan(85) == (24, 5, 81)
    for similarity in range(30, 100):
        bands, rows, close = plan(similarity)
        assert bands * rows == 120 and (1 - (similarity / 100) ** rows) ** bands <= LOSS and 0 < close <= 120
    with pytest.raises(ValueError):
        plan(5)
