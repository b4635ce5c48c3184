"""Bounded samples of labelled rows, and one-dimensional helpers for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCALE = 1_000_000


def labelled_texts(documents: DataFrame, labels: DataFrame, label: str, max_rows: int) -> tuple[DataFrame, dict]:
    """(doc_id, text, label 0/1) of a bounded sample of the labelled documents, and row weights by label.

    The sample is drawn from the labels, so it is small enough to broadcast, and documents' texts aren't shuffled.
    """
    rows = labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias(label))
    sample, weight = bounded_sample(rows, label, max_rows)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(sample), "doc_id"), weight


def bounded_sample(rows: DataFrame, label: str, max_rows: int, classes: int = 2) -> tuple[DataFrame, dict]:
    """About max_rows / classes rows of each label value at most, chosen by a hash of doc_id, and the weight of a row by label.

    A class with fewer rows is taken whole. Only the class sizes reach the driver.
    """
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    shares = {k: min(1.0, max_rows / classes / n) for k, n in sizes.items()}
    limit = F.lit(0)
    for k, share in shares.items():
        limit = F.when(F.col(label) == F.lit(k), F.lit(round(share * _SCALE))).otherwise(limit)
    return rows.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(_SCALE)) < limit), {k: 1 / share for k, share in shares.items()}


def logistic_fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the last coefficient is the intercept."""
    x = np.column_stack((x, np.ones(len(x))))
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ b)
        g = x.T @ (weight * (p - y)) + ridge * b
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return b


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
