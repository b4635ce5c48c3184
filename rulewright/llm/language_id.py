"""Operator 10: language identification with a string kernel.

The blended-spectrum presence kernel counts the character n-grams (n = 1 to 3, hashed to `bins`) that
two texts both have, normalised by their own numbers. Nystroem landmarks from a bounded sample give
an explicit map, and one-versus-rest kernel ridge regression its weights. The kernel is linear in
the presence vectors, so landmarks, map and weights multiply out to one matrix, and texts are scored
by batched products with it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.llm.labelled import bounded_sample

BINS = 1 << 14
_LETTER = re.compile(r"[^\W\d_]")
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
UNKNOWN = "und"


def presence(text: str, bins: int = BINS, longest: int = 3) -> np.ndarray:
    """Which hashed n-grams a text has, case ignored."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    found = np.zeros(bins, bool)
    code = np.zeros(len(c), np.uint64)
    shift = np.uint64(64 - bins.bit_length() + 1)
    for n in range(min(longest, len(c))):
        code = code[: len(c) - n] + (c[n:] + np.uint64(n + 1)) * _MIX[n]
        found[((code ^ (code >> np.uint64(29))) * _MIX[0]) >> shift] = True
    return found


@dataclass
class Model:
    languages: list[str]
    matrix: np.ndarray  # bins x languages

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; UNKNOWN and 0 if it has no letter or nothing was learned."""
        languages, scores = [], np.zeros(len(texts))
        for a in range(0, len(texts), 256):
            part = texts[a : a + 256]
            has = [bool(t and _LETTER.search(t)) for t in part]
            x = np.zeros((len(part), len(self.matrix)), np.float32)
            for i, t in enumerate(part):
                if has[i]:
                    x[i] = presence(t, len(self.matrix))
            y = (x @ self.matrix) / np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]
            e = np.exp(6 * (y - y.max(axis=1, keepdims=True))) if y.shape[1] else y
            best = y.argmax(axis=1) if y.shape[1] else np.zeros(len(part), int)
            for i, ok in enumerate(has):
                ok = ok and bool(self.languages)
                languages.append(self.languages[best[i]] if ok else UNKNOWN)
                scores[a + i] = e[i, best[i]] / e[i].sum() if ok else 0.0
        return languages, scores


def train(labelled: DataFrame, max_rows: int = 4_000, landmarks: int = 256, ridge: float = 1e-2, bins: int = BINS) -> Model:
    """Fit on `labelled` (doc_id, text, lang), of which about `max_rows` rows at most are used, spread over languages; null lang or text and texts without letters are left out. Repeated rows count each, extra columns are ignored, and with nothing left nothing is learned: every text is UNKNOWN."""
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    n = max(1, rows.select("lang").distinct().count())
    sample, _ = bounded_sample(rows, "lang", max_rows, n)

    def bits(batches):
        for batch in batches:
            keep = [(i, t, l) for i, t, l in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "lang"))) if _LETTER.search(t)]
            packed = [np.packbits(presence(t, bins)).tobytes() for _, t, _ in keep]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keep], pa.int64()), pa.array([k[2] for k in keep], pa.string()), pa.array(packed, pa.binary())], names=["doc_id", "lang", "bits"])

    got = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").mapInArrow(bits, "doc_id long, lang string, bits binary").orderBy("doc_id", "lang", "bits").toArrow()
    langs = got.column("lang").to_pylist()
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.zeros((bins, 0), np.float32))
    x = np.unpackbits(np.frombuffer(b"".join(got.column("bits").to_pylist()), np.uint8).reshape(len(langs), -1), axis=1)[:, :bins].astype(np.float32)
    x /= np.sqrt(x.sum(axis=1, keepdims=True))
    y = np.array([[1.0 if l == k else -1.0 for k in languages] for l in langs])
    # landmarks: the languages' rows in turn
    turn = np.argsort(_turns(langs), kind="stable")[:landmarks]
    marks = x[turn]
    value, vector = np.linalg.eigh((marks @ marks.T).astype(float))
    root = vector / np.sqrt(np.maximum(value, 1e-6 * value.max())) @ vector.T
    z = (x @ marks.T).astype(float) @ root
    weights = np.linalg.solve(z.T @ z + ridge * len(z) / len(languages) * np.eye(z.shape[1]), z.T @ y)
    return Model(languages, (marks.T @ (root @ weights)).astype(np.float32))


def _turns(langs: list[str]) -> list[int]:
    seen: dict[str, int] = {}
    out = []
    for l in langs:
        out.append(seen.get(l, 0))
        seen[l] = out[-1] + 1
    return out


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, lang_pred and score. A null text, or one without letters, gets UNKNOWN and 0. Repeated rows and rows without doc_id are judged each; extra columns are ignored; an empty table gives an empty result."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            languages, scores = sent.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(languages, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
