"""A bounded sample of labelled documents, and small dense fits on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod

#: Most labelled documents a fit looks at, chosen by a hash of their ids.
SAMPLE_ROWS = 8_000


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text, label of at most ``rows`` labelled documents outside the held-out fold.

    The ids broadcast are at most ``rows``; of rows that repeat an id the least text counts, so that texts are as few.  What
    is found is dealt anew over the cores.  Labels other than 0 and 1 are left out; of several for a document the largest
    counts.
    """
    chosen = (
        labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod("doc_id", folds) != held_out))
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    once = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    return once.repartition(docs.sparkSession.sparkContext.defaultParallelism)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights, the intercept last, of a ridge logistic regression by Newton's method."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(a.shape[1]), ridge * np.eye(a.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))
