import sys
from pathlib import Path

import corpus_pipeline

sys.path.insert(0, str(Path(__file__).resolve().parent))

from test_minmax import brute as near_brute, shingles  # noqa: E402
from test_packing import check as check_packed  # noqa: E402
from test_winnow import brute as benchmark_brute  # noqa: E402

from tripleloom.llm.feistel import TRIAL_KEY, Permutation, replace  # noqa: E402
from tripleloom.llm.qda import quality  # noqa: E402

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, score int"


def bag(frame):
    return sorted((tuple(r) for r in frame.select(*corpus_pipeline.COLUMNS).collect()), key=str)


def test_stages_as_brute_force(spark):
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r[0]: tuple(r) for r in docs.select(*corpus_pipeline.COLUMNS).collect()}
    good = {r.doc_id for r in quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("score >= 0.3").collect()}
    kept = stage["quality_classifier"](spark, docs, SF)
    rows = {i: r for i, r in rows.items() if i in good}
    assert bag(kept) == sorted(rows.values(), key=str) and 0 < len(rows) < 1000

    one = stage["minmax_near_dedup"](spark, kept, SF)
    keep = {r[0] for r in near_brute([r[:2] for r in rows.values()]) if r[3]}
    rows = {i: r for i, r in rows.items() if i in keep}
    assert bag(one) == sorted(rows.values(), key=str)

    clean = stage["benchmark_decontamination"](spark, one, SF)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {r[0] for r in benchmark_brute([r[:2] for r in rows.values()], items) if r[5]}
    rows = {i: r for i, r in rows.items() if i not in dirty}
    assert dirty and bag(clean) == sorted(rows.values(), key=str)

    hidden = stage["pii_pseudonyms"](spark, clean, SF)
    permute = Permutation(TRIAL_KEY)
    rows = {i: (i, new := replace(t, permute)[0], lang, source, len(new)) for i, (_, t, lang, source, _) in rows.items()}
    assert bag(hidden) == sorted(rows.values(), key=str)

    check_packed([r[:2] for r in rows.values()], stage["power_of_two_packing"](spark, hidden, SF).collect())
    fields = "doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset"
    whole = corpus_pipeline.run(spark, SF).select(*fields)
    assert whole.exceptAll(stage["power_of_two_packing"](spark, hidden, SF).select(*fields)).isEmpty()


def test_odd_rows_pass_every_stage(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, "en", "s", 3, "k", 1), (1, text, "en", "s", 3, "k", 1), (2, text.upper(), None, None, None, "k", 1),
            (3, None, "en", "s", 0, None, None), (4, "", "en", "s", 0, "k", 1), (4, "", "en", "s", 0, "k", 1),
            (None, "alone " * 7, "en", "s", 3, "k", 1), (5, "long " * 30_000, "en", "s", 3, "k", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert shingles(text) and len(corpus_pipeline.STAGES) == 5
    one = dict(corpus_pipeline.STAGES)["minmax_near_dedup"](spark, docs, SF)
    assert sorted(str(r.doc_id) for r in one.collect()) == ["1", "3", "4", "4", "5", "None"]
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        made.collect()
        assert stage(spark, docs.limit(0), SF).collect() == []
    assert made.columns[:3] == ["doc_id", "start", "length"]
