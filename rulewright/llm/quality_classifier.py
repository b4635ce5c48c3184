"""Operator 8: text quality by hashed word n-gram logistic regression, trained with FTRL-proximal updates.

Features are single words and punctuation runs and their pairs, hashed to `size` slots; a word that
repeats the one before counts as one "same" mark, so that repetition shows whatever the word. The
sample is dealt into shards that are trained each on its own, and the shards' weights are averaged
after every round. A score is the logistic of a sparse dot product.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.llm.common import cut_lineage
from rulewright.llm.labelled import labelled_texts, sigmoid

_TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|[^\x09-\x0d\x200-9a-z\x80-\xff]+")
SIZE = 1 << 18


def features(text: str | None, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Slots and their values (square roots of counts, scaled to length 1); none for a text without tokens."""
    crc = zlib.crc32
    h = np.array([crc(t) for t in _TOKEN.findall(text.encode("utf-8", "surrogatepass").lower())] if text else [], np.uint64)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0)
    h[1:][h[1:] == h[:-1]] = 12345  # the "same" mark
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    slots = np.concatenate((h * np.uint64(0xD6E8FEB86659FD93), pairs)) >> np.uint64(40)
    slots, counts = np.unique(slots.astype(np.int64) % size, return_counts=True)
    values = np.sqrt(counts)
    return slots, values / np.sqrt((values**2).sum())


@dataclass
class Rates:
    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 0.01
    l2: float = 0.003


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int, float]], start: np.ndarray, rates: Rates) -> np.ndarray:
    """One pass of FTRL-proximal over (slots, values, label, weight) rows, from the weights `start`; the last weight is the intercept."""
    n = np.full(len(start), 1e-2)
    # z such that the closed form gives `start` back
    z = -(start * ((rates.beta + np.sqrt(n)) / rates.alpha + rates.l2)) - np.sign(start) * rates.l1
    last = len(start) - 1
    for slots, values, y, weight in rows:
        i, x = np.append(slots, last), np.append(values, 1.0)
        zi, ni = z[i], n[i]
        w = np.where(np.abs(zi) <= rates.l1, 0.0, -(zi - np.sign(zi) * rates.l1) / ((rates.beta + np.sqrt(ni)) / rates.alpha + rates.l2))
        g = (sigmoid(w @ x) - y) * x * weight
        z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / rates.alpha * w
        n[i] = ni + g * g
    return np.where(np.abs(z) <= rates.l1, 0.0, -(z - np.sign(z) * rates.l1) / ((rates.beta + np.sqrt(n)) / rates.alpha + rates.l2))


def _trainer(sent, rates: Rates, size: int):
    """A function that trains one shard from the broadcast weights, in an order that a hash of doc_id sets."""

    def one(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.assign(at=[zlib.crc32(f"{x}".encode()) for x in shard["doc_id"]]).sort_values("at", kind="stable")
        w = ftrl([(*features(t, size), y, 1.0) for t, y in zip(shard["text"], shard["quality"])], sent.value, rates)
        slots = np.nonzero(w)[0]
        return pd.DataFrame({"slot": slots, "w": w[slots]})

    return one


def train(documents: DataFrame, labels: DataFrame, max_rows: int = 16_000, shards: int = 8, rounds: int = 6, size: int = SIZE, rates: Rates = Rates()) -> np.ndarray:
    """Weights (size + 1, intercept last) from documents (doc_id, text) with labels (doc_id, quality 0/1), of which about `max_rows` rows at most are used, half of each class.

    The intercept is set for the class shares of all labelled rows. Other labels are ignored;
    with no rows all weights are 0.
    """
    sample, weight = labelled_texts(documents, labels, "quality", max_rows)
    dealt = cut_lineage(sample.select(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(shards)).cast("int").alias("shard"), "doc_id", "text", "quality"))
    weights = np.zeros(size + 1)
    for _ in range(rounds):
        sent = documents.sparkSession.sparkContext.broadcast(weights)

        # at most size + 1 rows come back
        found = dealt.groupBy("shard").applyInPandas(_trainer(sent, rates, size), "slot long, w double").groupBy("slot").agg((F.sum("w") / shards).alias("w")).toArrow()
        weights = np.zeros(size + 1)
        weights[found.column("slot").to_numpy()] = found.column("w").to_numpy()
    if len(weight) == 2:  # the sample's class shares are not those of all labelled rows
        weights[-1] += np.log(weight[1] / weight[0])
    return weights


def score(documents: DataFrame, weights: np.ndarray) -> DataFrame:
    """Per row: doc_id and score, 0 to 1, higher for better text. Null and empty texts get the intercept's score; repeated rows and rows without doc_id are scored each; extra columns are ignored; an empty table gives an empty result."""
    sent = documents.sparkSession.sparkContext.broadcast(weights)
    size = len(weights) - 1

    def run(batches):
        w = sent.value
        for batch in batches:
            found = (features(t, size) for t in batch.column("text").to_pylist())
            dots = np.array([w[i] @ x + w[-1] for i, x in found], float)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sigmoid(dots))], names=["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
