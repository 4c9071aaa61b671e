import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleloom.llm.fit import labelled_sample
from tripleloom.llm.qda import fit, quality, score

SCHEMA = "doc_id long, text string, score string, quality string"


def test_score_is_the_density_difference():
    draw = np.random.default_rng(4)
    x = np.vstack([draw.normal(0, 1, (300, 3)), draw.normal(1, 2, (700, 3))])
    y = np.repeat([0.0, 1.0], [300, 700])
    model = fit(x, y, pooled=0.0, round_=0.0)

    def density(k):
        part = x[y == k]
        cov = np.cov(part, rowvar=False, bias=True) + 1e-6 * np.eye(3)
        z = x - part.mean(axis=0)
        return -0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z) - 0.5 * np.linalg.slogdet(cov)[1]

    gap = np.arcsinh((density(1) - density(0)) / 4)
    assert np.allclose(score(model, x), 1 / (1 + np.exp(-(gap * model.curve[0] + model.curve[1]))))


def test_constant_statistics_and_one_class():
    x = np.ones((20, 2))
    assert np.isfinite(score(fit(x, np.repeat([0.0, 1.0], 10)), x)).all()
    assert np.allclose(score(fit(x, np.ones(20)), x), 21 / 22)
    assert np.allclose(score(fit(np.zeros((0, 0)), np.zeros(0)), x), 0.5)


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    return read("documents"), read("labels")


def test_held_out_documents(spark, tables):
    docs, labels = tables
    rows = quality(docs, labels).join(labels.withColumnRenamed("quality", "truth"), "doc_id").where("held_out").toPandas()
    good, bad = rows[rows.truth == 1], rows[rows.truth == 0]
    assert len(good) > 400 and len(bad) > 50
    assert (good.predicted == 1).mean() > 0.97 and (bad.predicted == 0).mean() > 0.8
    assert rows.score.between(0, 1).all()


def test_odd_rows(spark, tables):
    docs, labels = tables
    odd = spark.createDataFrame(
        [(1, None, "a", "b"), (2, "", "a", "b"), (3, "x " * 200_000, "a", "b"), (None, "text", "a", "b"),
         (4, "same words", "a", "b"), (4, "same words", "c", "d")], SCHEMA)
    got = quality(odd, labels.withColumn("text", F.lit("clash")), carry=("score", "quality")).collect()
    assert len(got) == 6 and all(0 <= r[4] <= 1 for r in got)
    assert len({r[4] for r in got if r.doc_id == 4}) == 1
    assert quality(odd.limit(0), labels).collect() == []
    few = labels.limit(0)
    assert {r.score for r in quality(odd, few).collect()} == {0.5}


def test_labels_of_held_out_documents_are_not_used(spark, tables):
    docs, labels = tables
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    some = docs.limit(300)
    first = {r.doc_id: r.score for r in quality(docs, labels).collect()}
    assert some.count() == 300 and {r.doc_id: r.score for r in quality(docs, turned).collect()} == first


def test_one_row_per_labelled_id(spark):
    docs = spark.range(20_000).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 7).alias("text"))
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (2, 0)], "doc_id long, quality int")
    picks = [sorted(map(tuple, labelled_sample(d, labels, "quality", F.lit(True), 10).collect())) for d in (docs, docs.orderBy(F.desc("text")))]
    assert [r[0] for r in picks[0]] == [0, 1] and picks[0] == picks[1]
