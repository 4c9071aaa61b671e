import hashlib
import random
import re

from tripleloom.llm.winnow import contamination

SCHEMA = "doc_id long, text string, item_id int"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(item)
    sizes, out = {len(k) for k in windows}, []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (named := windows.get(tuple(w[i:i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= named
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


def random_tables(seed, vocabulary):
    draw = random.Random(seed)
    v = [f"w{i}" for i in range(vocabulary)]
    items = [(i, " ".join(draw.choices(v, k=draw.choice([0, 1, 3, 4, 5, 7, 12, 13, 14, 20, 60])))) for i in range(40)]
    items += [(3, items[30][1]), (None, " ".join(draw.choices(v, k=20))), (77, None)]
    docs = []
    for i in range(150):
        w = draw.choices(v, k=draw.choice([0, 1, 5, 12, 13, 50, 400]))
        for _ in range(draw.randrange(4)):
            piece = words(draw.choice(items)[1])
            low = draw.randrange(len(piece) + 1)
            at = draw.randrange(len(w) + 1)
            w[at:at] = piece[low:low + draw.choice([5, 12, 13, 14, 30])]
        docs.append((i, ", ".join(w).upper() if i % 3 else "\n".join(w)))
    docs += [(200, None), (201, ""), (None, items[35][1]), (202, "-- !"), (202, "x " * 500 + (items[36][1] or ""))]
    return docs, items


def test_as_brute_force(spark):
    for seed, vocabulary in ((1, 2000), (2, 3), (3, 30)):
        docs, items = random_tables(seed, vocabulary)
        frame = spark.createDataFrame([(i, t, 9) for i, t in docs], SCHEMA).repartition(4)
        marks = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id int, text string, doc_id int")
        assert got(contamination(frame, marks)) == brute(docs, items), (seed, vocabulary)


def test_spans_and_repeats(spark):
    text = " ".join(f"t{i}" for i in range(15))
    frame = spark.createDataFrame([(1, f"a b {text} c", 0), (1, f"a b {text} c", 0)], SCHEMA)
    rows = contamination(frame, spark.createDataFrame([(4, text)], "item_id int, text string")).collect()
    assert [(r.n_hit, [tuple(s) for s in r.spans]) for r in rows] == [(15, [(2, 17)])] * 2


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c", 0)], SCHEMA), spark.createDataFrame([], "item_id int, text string")
    assert got(contamination(docs, items)) == brute([(1, "a b c")], [])
    assert contamination(docs.limit(0), items).collect() == []


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got(contamination(docs, items)) == brute(rows, [tuple(r) for r in items.collect()])
