"""Document quality by a regularised quadratic discriminant.

A document becomes a vector of transformed statistics (logarithms of counts
and log-odds of shares).  For each class a mean and a covariance are fitted; a
covariance is shrunk towards the pooled one and towards its own mean variance,
so that it can be inverted even where a statistic is constant.  The score is
the difference of the two log densities, from Mahalanobis distances by the
inverse Cholesky factors, which are computed once and kept in the model; a
logistic curve turns it into a probability.

Only texts are read for a score.  Null and empty texts have all counts zero
and get a score as any other.  Without labels of both classes the score is the
smoothed share of good labels.  Repeated rows get equal scores; extra columns
pass only if named in ``carry``.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.fit import fit_logistic, labelled_sample, sigmoid
from tripleloom.llm.store import id_crc, small_batches
from tripleloom.llm.text import find_words, gram_hashes, utf8, word_hashes

#: Labelled rows that the model is fitted on, at most.
FIT_ROWS = 20_000
#: Parts of the pooled covariance and of the scaled identity in a class covariance.
POOLED, ROUND = 0.1, 0.02
ACCEPT = 0.3

# Kinds of bytes whose shares count.
_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#$%&*<>|@^~\\{}[]=_+",
    "bar": b"|", "shout": b"!?", "stop": b".", "comma": b",;:", "line": b"\n", "space": b" \t\r\x0b\x0c",
}
_FLAGS = np.zeros((len(_KINDS) + 1, 256), dtype=np.uint8)
for _row, _bytes in enumerate(_KINDS.values()):
    _FLAGS[_row, list(_bytes)] = 1
_FLAGS[-1, 128:] = 1


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Log-odds of a share, pulled to the middle where there is little to count."""
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5)) / 4


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of transformed statistics per text."""
    data, at = utf8(texts)
    words = find_words(texts)
    hashes = word_hashes(words)
    trigrams = gram_hashes(hashes, 3)
    size, n = np.diff(at).astype(float), np.diff(words.bounds)
    full = np.flatnonzero(size)
    counts = np.zeros((len(_FLAGS), len(size)))
    for k, flags in enumerate(_FLAGS):
        if len(full):
            counts[k, full] = np.add.reduceat(flags[data], at[:-1][full], dtype=np.int64)
    length = words.ends - words.starts
    chars, short, distinct, top, repeated = (np.zeros(len(n)) for _ in range(5))
    for i in np.flatnonzero(n):
        low, high = words.bounds[i], words.bounds[i + 1]
        _, many = np.unique(hashes[low:high], return_counts=True)
        distinct[i], top[i] = len(many), many.max()
        chars[i], short[i] = length[low:high].sum(), (length[low:high] <= 3).sum()
        if n[i] >= 3:
            _, many = np.unique(trigrams[low:high - 2], return_counts=True)
            repeated[i] = many[many > 1].sum()
    return np.column_stack([
        np.log1p(n), np.log1p(chars / np.maximum(n, 1)), _share(short, n), _share(distinct, n), _share(top, n),
        _share(repeated, n), *(_share(row, size) for row in counts)])


class Model(NamedTuple):
    means: np.ndarray
    inverses: np.ndarray  # of the Cholesky factors
    constants: np.ndarray
    curve: np.ndarray
    prior: float


def _difference(model: Model, x: np.ndarray) -> np.ndarray:
    density = [constant - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1)
               for mean, inverse, constant in zip(model.means, model.inverses, model.constants, strict=True)]
    gap = density[1] - density[0]
    return np.arcsinh(gap / 4)


def fit(x: np.ndarray, y: np.ndarray, pooled: float = POOLED, round_: float = ROUND) -> Model:
    prior = (y.sum() + 1) / (len(y) + 2)
    d = x.shape[1] if x.ndim == 2 else 0
    if min(y.sum(), len(y) - y.sum()) < 2:
        return Model(np.zeros((0, d)), np.zeros((0, d, d)), np.zeros(0), np.zeros(2), float(prior))
    means = np.stack([x[y == k].mean(axis=0) for k in (0, 1)])
    own = [np.cov(x[y == k], rowvar=False, bias=True) for k in (0, 1)]
    both = sum(c * (y == k).mean() for k, c in enumerate(own))
    inverses, constants = [], []
    for c in own:
        c = (1 - pooled - round_) * c + pooled * both
        c += np.eye(d) * (round_ * np.trace(both) / d + 1e-6)
        factor = np.linalg.cholesky(c)
        inverses.append(np.linalg.inv(factor))
        constants.append(-np.log(np.diag(factor)).sum())
    model = Model(means, np.stack(inverses), np.array(constants), np.zeros(2), float(prior))
    return model._replace(curve=fit_logistic(_difference(model, x)[:, None], y))


def score(model: Model, x: np.ndarray) -> np.ndarray:
    if not len(model.means):
        return np.full(len(x), model.prior)
    return sigmoid(_difference(model, x) * model.curve[0] + model.curve[1])


def train(docs: DataFrame, labels: DataFrame, keep, fit_rows: int = FIT_ROWS) -> Model:
    """Fits on at most ``fit_rows`` labelled documents that ``keep`` admits."""
    sample = labelled_sample(docs, labels, "quality", keep, fit_rows)

    def run(batches):
        for batch in batches:
            x = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"),
                 pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))],
                names=["doc_id", "label", "x"])

    rows = sample.mapInArrow(run, "doc_id long, label int, x array<double>").toPandas()
    rows = rows.sort_values("doc_id")
    x = np.stack(rows["x"].to_list()) if len(rows) else np.zeros((0, 0))
    return fit(x, rows["label"].to_numpy(dtype=float))


def quality(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = (), accept: float = ACCEPT) -> DataFrame:
    """doc_id, the ``carry`` columns, held_out, score and predicted of every row of ``docs``.

    Labels of documents with crc32(doc_id) mod 5 = 0 are held out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = id_crc() % 5 == 0
    model = spark.sparkContext.broadcast(train(docs, labels, ~held))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"),
                       *[docs[c].alias(f"_c{k}") for k, c in enumerate(carry)])
    base = base.withColumn("_held", held)

    def run(batches):
        for batch in batches:
            value = score(model.value, statistics(batch.column("_text")))
            kept = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(value)], names=[*kept, "_score"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema if f.name != "_text")
    scored = base.mapInArrow(run, f"{fields}, _score double")
    return scored.select("doc_id", *[F.col(f"_c{k}").alias(c) for k, c in enumerate(carry)],
                         F.col("_held").alias("held_out"), F.col("_score").alias("score"),
                         (F.col("_score") >= accept).cast("int").alias("predicted"))
