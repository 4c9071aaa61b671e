import math
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest

from tripleloom.llm import katz
from tripleloom.llm.katz import Discounts, Model, katz_scores


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")), "</s>"]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def of_counts(counts):
    many = Counter(counts.values())
    return [many[r] for r in range(1, katz.GOOD_TURING + 2)] + [len(counts), sum(counts.values())]


def runs(text, n):
    """Each token of a text with the n - 1 tokens or start signs before it."""
    padded = ["<s>"] * (n - 1) + tokens(text)
    return [tuple(padded[i:i + n]) for i in range(len(padded) - n + 1)]


def brute(rows, order):
    """Scores by the plain recursion over counts of whole runs."""
    train = [t for i, t in rows if not held(i)]
    counts = [Counter(r for t in train for r in runs(t, n)) for n in range(1, order + 1)]
    model = Model.of([of_counts(c) for c in counts])
    after = defaultdict(dict)
    for of_length in counts[1:]:
        for run, c in of_length.items():
            after[run[:-1]][run[-1]] = c
    total = {h: sum(seen.values()) for h, seen in after.items()}

    @lru_cache(None)
    def p(run):
        *h, w = run
        if not h:
            return float(model.word(np.array(counts[0][w,])))
        h = tuple(h)
        if w in after[h]:
            return float(model.discounts[len(h)](np.array(after[h][w]))) / total[h]
        return alpha(h) * p(run[1:])

    @lru_cache(None)
    def alpha(h):
        if not after[h]:
            return 1.0
        return (1 - sum(p((*h, w)) for w in after[h])) / (1 - sum(p((*h[1:], w)) for w in after[h]))

    for h in [*total][::max(1, len(total) // 40)]:  # after a history all tokens, unseen ones too, sum to one
        assert abs(sum(p((*h, w)) for w, in counts[0]) + p((*h, "<never>")) - 1) < 1e-9
    out = []
    n, v = sum(counts[0].values()), len(counts[0])
    for i, t in rows:
        ones = runs(t, 1)
        base = sum(math.log10((counts[0][w] + 0.5) / (n + 0.5 * (v + 1))) for w in ones)
        out.append((i, held(i), len(ones), sum(counts[0][w] > 0 for w in ones), n, base,
                    sum(math.log10(p(r)) for r in runs(t, order))))
    return sorted(out, key=str)


def same(frame, rows, keep, order=3):
    path = f"{keep}/t"
    frame.write.mode("overwrite").parquet(path)
    got = sorted((tuple(r) for r in katz_scores(frame.sparkSession.read.parquet(path), order=order).collect()), key=str)
    want = brute(rows, order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    np.testing.assert_allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)
    return got


@pytest.mark.parametrize("block,bucket,order", [(1_500_000, 8 << 20, 3), (20_000, 20_000, 3), (20_000, 20_000, 2)])
def test_documents(spark, tmp_path, monkeypatch, block, bucket, order):
    monkeypatch.setattr(katz, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(katz, "BLOCK_TOKENS", block)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = same(docs.repartition(3), [tuple(r) for r in docs.collect()], tmp_path, order)
    assert sum(r[6] for r in got if r[1]) > sum(r[5] for r in got if r[1])


@pytest.mark.parametrize("order", [2, 3, 4])
def test_odd_rows(spark, tmp_path, order):
    rows = [(i, t) for i, t in enumerate(["a b a b", "", None, "A  b\tc", "x " * 5000, "a b", "c c c", "new words here"])]
    rows += [(1, ""), (None, "a b"), (None, None), (8, "a b"), (8, "a b")]
    docs = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, score string")
    same(docs.repartition(2), rows, tmp_path, order)


def test_nothing_to_learn(spark, tmp_path):
    one = next(i for i in range(100) if held(i))
    docs = spark.createDataFrame([(one, "a b")], "doc_id long, text string")
    same(docs, [(one, "a b")], tmp_path)
    docs.limit(0).write.parquet(f"{tmp_path}/e")
    assert katz_scores(spark.read.parquet(f"{tmp_path}/e")).collect() == []


def test_discounts_are_shares():
    for ones in ([100, 40, 20, 12, 8, 6], [0] * 6, [5, 0, 0, 0, 0, 0], [1, 9, 1, 9, 1, 9], [3, 3, 3, 3, 3, 3]):
        left = Discounts.of(ones)(np.arange(1, 50))
        assert ((0 < left) & (left < np.arange(1, 50))).all()
