import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleloom.llm import toxicity as module
from tripleloom.llm.toxicity import LETTERS, CharacterModel, character_counts, coded, runs, toxicity

E_ACUTE = LETTERS.index("é") + 1
SF = "/root/testdata/sf0.1"
DISGUISED = {"st*pid": "stupid", "m0r0n": "moron", "tr@sh": "trash", "1d10t": "idiot", "i d i o t": "idiot",
             "s.c.u.m": "scum", "looooser": "loser", "w0rthle$$": "worthless", "path3tic": "pathetic"}


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def characters(tables):
    return CharacterModel(character_counts(tables[0]))


def test_counts_as_brute_force(spark):
    docs = spark.createDataFrame([("ab é!Ab", 1), (None, 2), ("", 3), ("x", 4)], "text string, n int")
    counts = character_counts(docs).reshape([len(LETTERS) + 2] * 3)
    assert counts[1, 2, 0] == 2 and counts[0, E_ACUTE, 0] == 1 and counts[2, 0, E_ACUTE] == 1
    code, starts = coded(["Ab", None, " ñ-b"])
    assert code.tolist() == [0, 1, 2, 0, LETTERS.index("ñ") + 1, 0, 2, 0] and starts.tolist() == [1, 4, 4, 8]


def test_restored_words(characters):
    got = {k: characters.clear(f"the {k} of") for k in DISGUISED}
    right = sum(DISGUISED[k] in v for k, v in got.items())
    assert right >= len(DISGUISED) - 2, got
    for clean in ("the and of. Thst ion, the", "", None, "a b the", "x"):
        assert characters.clear(clean) == clean


MIXED = {"m 0 r 0 n": "moron", "m.0.r.0.n": "moron", "1 d 1 0 t": "idiot", "i d 1 o t": "idiot", "l0000ser": "loser",
         "5h17": "shit", "a$$": "ass", "i  d  i  o  t": "idiot", "d i e": "die", "$h1t,": "shit", "5.t.u.p.1.d": "stupid",
         "i d d d 1 o t": "idiot", "w0rthle$$": "worthless"}


def test_mixed_disguises_reach_the_decoder(characters):
    got = {k: characters.clear(f"the {k} of") for k in MIXED}
    assert all(v != f"the {k} of" and not any(c in "0123456789$" for c in v) for k, v in got.items()), got
    read = {k: v.split()[1:-1] for k, v in got.items()}
    missed = {k: v for k, v in read.items() if MIXED[k] not in "".join(v) and MIXED[k] not in "".join(v).replace("oo", "o")}
    # These reach the decoder too; it reads them one letter short (diot, as, worthles).
    assert set(missed) <= {"1 d 1 0 t", "a$$", "w0rthle$$"}, missed
    for clean in ("1 2 3 4 5", "hello!!! you", "a 1 the", "3 - 4 - 5 * 6"):
        assert characters.clear(clean) == clean


def exhaustive(model, span, apart):
    """The best reading of a short span by trying every one."""
    best = (-1e99, "")

    def go(i, a, b, before, weight, out):
        nonlocal best
        if i == len(span):
            best = max(best, (weight + model.log[a][b][0], out))
            return
        c, code = span[i], module._sign(span[i])
        options = [(code, 0.0)] if code else [(ord(x) - 96, -1.0) for x in module.LEET.get(c, "")]
        skipped = apart and c in module._SEPARATORS
        if code:
            options += [(None, -1.0)] if c == before else []
        elif skipped:
            options += [(None, 0.0), (0, -1.0)]
        else:
            options += [(0, -2.0)] + ([(None, -2.0)] if c == before else [])
        for code, cost in options:
            if code is None or code == 0 and b == 0:
                go(i + 1, a, b, before if skipped else c, weight + cost, out)
            else:
                sign = " " if code == 0 else module.LETTERS[code - 1]
                go(i + 1, b, code, before if skipped else c, weight + cost + model.log[a][b][code], out + sign)

    go(0, 0, 0, "", 0.0, "")
    return best[1]


def test_decoding_finds_the_best_of_all_readings(characters):
    import random
    draw = random.Random(8)
    for _ in range(300):
        apart = draw.random() < 0.5
        span = "".join(draw.choice("aeilost011345@$!*." + (" .-_" if apart else "")) for _ in range(draw.randrange(1, 7)))
        if not any(x * 4 in span for x in set(span)):
            assert characters._decode(span, apart) == exhaustive(characters, span, apart), (span, apart)


def test_words_are_told_apart():
    number, text = module.whole_words(*coded(["scum of the", "", "the  the scums"]))
    assert text.tolist() == [0, 0, 2, 2, 2] and len(set(number.tolist())) == 3 and number[1] == number[2] == number[3]
    assert len(module.whole_words(*coded(["", None, "a b"]))[0]) == 0
    assert len(module.whole_words(*coded(["x" * 100_000]))[0]) == 1


def test_long_runs_of_signs_stay_linear(characters):
    for text in ("a!" * 3 + "!" * 200_000 + "%x", "a" + "1" * 200_000 + "%", "* " * 200_000 + "a", "1 2 " * 100_000 + "ab"):
        characters.clear(text)


def test_runs_stay_within_words():
    value, text = runs(*coded(["scum of", "", "the"]))
    assert len(value) == 3 and text.tolist() == [0, 0, 2]


def test_held_out_documents(tables):
    docs, labels = tables
    rows = toxicity(docs, labels).join(labels.withColumnRenamed("toxic", "truth"), "doc_id").where("held_out").toPandas()
    bad, clean = rows[rows.truth == 1], rows[rows.truth == 0]
    assert (bad.predicted == 1).mean() > 0.9 and (clean.predicted == 0).mean() > 0.99
    assert rows.score.between(0, 1).all()


def test_disguised_documents_are_found(spark, tables):
    docs, labels = tables
    # The same clean document with two disguised insults, with none, and odd rows.
    clean = docs.where("lang = 'en' and length(text) between 300 and 900").join(labels.where("toxic = 0"), "doc_id").first().text
    rows = [(1, f"{clean} m0r0n {clean[:80]} i d i o t of", 0), (2, clean, 0), (3, None, 0), (4, "", 0), (None, clean, 0),
            (5, "a " * 100_000, 0), (6, "1" * 100_000 + "a", 0), (2, clean, 0)]
    got = toxicity(docs.select("doc_id", "text").withColumn("label", F.lit(0)).where("doc_id > 100").union(
        spark.createDataFrame(rows, "doc_id long, text string, label int")), labels.where("doc_id > 100"))
    found = {}
    for r in got.where("doc_id is null or doc_id < 100").collect():
        found.setdefault(r.doc_id, r)
    assert found[1].score > 0.7 and found[2].score == found[None].score < 0.3 and found[3].score == found[4].score < 0.3


def test_no_labels_and_no_rows(spark, tables):
    docs, labels = tables
    some = docs.limit(20)
    assert {r.score for r in toxicity(some, labels.limit(0)).collect()} == {0.5}
    assert toxicity(docs.limit(0), labels).collect() == []
    assert np.isfinite([r.score for r in toxicity(some, labels).collect()]).all()
