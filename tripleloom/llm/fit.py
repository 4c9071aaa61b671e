"""Labelled samples of bounded size, and a calibrated score in one dimension."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep, bound: int) -> DataFrame:
    """doc_id, text and label of at most ``bound`` labelled documents that ``keep`` admits.

    The ids with the least hashes are taken, so the choice does not depend on
    the order of rows.  An id with labels that disagree, or without an id or a
    label, is left out; of repeated rows of an id the one with the least hash of
    its text counts, chosen in the map tasks first.  The list of ids has at most
    ``bound`` rows and is therefore broadcast.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
             .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & keep)
             .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_high"))
             .where("label = _high").drop("_high"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(known), "doc_id")
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "label")).alias("row")
    return rows.groupBy("doc_id").agg(first).select("doc_id", "row.text", "row.label")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Coefficients of a logistic regression by damped Newton steps; the last is the constant.

    The ridge holds for columns scaled to deviation one, so that classes which a
    column splits without error still give finite coefficients.
    """
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    penalty = np.append(np.full(x.shape[1], ridge), 1e-6)

    def loss(w):
        m = z @ w
        return np.logaddexp(0, m).sum() - y @ m + 0.5 * penalty @ w**2

    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = sigmoid(z @ w)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty) + 1e-9 * np.eye(len(w)),
                               z.T @ (y - p) - penalty * w)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-8 or size <= 1e-6:
            break
    slope = w[:-1] / scale
    return np.append(slope, w[-1] - slope @ centre)


def fit_steps(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of y as a rising function of z: places and values between which to interpolate.

    Neighbours out of order are pooled; each pool's share is drawn to a half by one case.
    """
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    places, first = np.unique(z, return_index=True)
    hits, sizes = np.add.reduceat(y, first), np.diff(np.append(first, len(z)))
    pools: list[list[float]] = []  # hits, size, lowest and highest place
    for h, n, place in zip(hits, sizes, places, strict=True):
        pools.append([h, n, place, place])
        while len(pools) > 1 and (pools[-2][0] + 0.5) * (pools[-1][1] + 1) >= (pools[-1][0] + 0.5) * (pools[-2][1] + 1):
            h, n, _, high = pools.pop()
            pools[-1] = [pools[-1][0] + h, pools[-1][1] + n, pools[-1][2], high]
    at = np.array([p for pool in pools for p in (pool[2], pool[3])])
    value = np.repeat([(pool[0] + 0.5) / (pool[1] + 1) for pool in pools], 2)
    return at, value
