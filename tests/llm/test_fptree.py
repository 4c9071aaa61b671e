import random
import re
from collections import Counter, defaultdict

import pytest

from tripleloom.llm import fptree as module
from tripleloom.llm.fptree import source_divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, ranks=200):
    count, in_docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text or ""))
        count[lang, source].update(words)
        in_docs[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in in_docs[lang].items() if n >= 3)
        sources = sorted(s for x, s in groups if x == lang)

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        whole = shares(sum((count[lang, s] for s in sources), Counter()))
        each = {s: shares(count[lang, s]) for s in sources}
        for s in sources:
            pairs = [(-sum((each[s][t] - each[o][t]) ** 2 // each[o][t] for t in kept), o) for o in sources if o != s]
            terms = [(-((each[s][t] - whole[t]) ** 2 // whole[t]), t) for t in kept
                     if count[lang, s][t] and each[s][t] > whole[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items = sorted(items, key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, o, -v, k) for k, (v, o) in enumerate(items[:ranks if part == "term" else None], 1)]
    return sorted(out)


def drawn(seed, n):
    draw = random.Random(seed)
    words = ["the", "The", "of", "é", "Éa", "x1y", "zebra", "don't", "日本", "ª"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows = []
    for i in range(n):
        k = draw.choice([0, 1, 5, 40])
        text = draw.choice([None, "", " ".join(draw.choice(words[:draw.choice([5, 50, 210])]) for _ in range(k))])
        rows.append((i, text, draw.choice(["en", "en", "de", None]), draw.choice(["a", "b", "c", "D", "é", None]), "x", 1))
    return rows


@pytest.mark.parametrize("batch, at_once", [(7, 5), (1000, 1 << 19)])
def test_drawn_documents(spark, monkeypatch, batch, at_once):
    monkeypatch.setattr(module, "small_batches", lambda s: s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch))
    monkeypatch.setattr(module, "_AT_ONCE", at_once)
    rows = drawn(batch, 400)
    got = source_divergence(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_odd_rows(spark):
    one = [(1, "a b", "en", "s", "x", 1)]
    assert source_divergence(spark.createDataFrame(one, SCHEMA)).collect() == []
    rows = one + [(2, None, "en", "t", "x", 1), (3, "12 34", None, None, "x", 1), (3, "12 34", None, "u", "x", 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(r) for r in source_divergence(frame).collect()) == brute(rows)  # no kept terms: divergences of 0
    rows = [(i, "a " * 100_000 + "b", "en", s, "x", 1) for i, s in enumerate("ssstt")] + rows
    assert sorted(tuple(r) for r in source_divergence(spark.createDataFrame(rows, SCHEMA)).collect()) == brute(rows)
    assert source_divergence(frame.limit(0)).collect() == []


def test_term_rows_stop_at_their_limit(spark):
    rows = [(i, " ".join("abcdefghij"[:10 - i // 3]), "en", "st"[i % 2], "x", 1) for i in range(24)]
    got = source_divergence(spark.createDataFrame(rows, SCHEMA), ranks=2)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, ranks=2)


def test_huge_counts_stay_exact(spark):
    frame = spark.createDataFrame([(20_000_000_000, 90_000_000_000, 7)], "n long, total long, terms long")
    from pyspark.sql import functions as F
    got = frame.select(module.share(F.col("n"), F.col("total"), F.col("terms"))).first()[0]
    assert got == 1 + 1_000_000_000 * 20_000_000_001 // 90_000_000_007
