"""Operator 7: toxicity by two class-conditional Kneser-Ney word models.

Each class has an interpolated Kneser-Ney model of word pairs. Counts are continuation counts, after how many
different words a pair or a word occurs, so that copies of a text count once. What a pair is discounted backs
off to the class's words, and what those are discounted to shared counts, those of both classes together, and
in the end to all words alike. Discounts come from counts of counts of both classes: an expression that is rare
in both tells nothing of either and is left to the shared counts. Every word and pair of the sample that follows
another word is counted and scored.

A toxic text is an ordinary one but for some words: its likelihood mixes the toxic model, by a small share,
with the ordinary one. The score compares both log-likelihoods of a text, of its words alone and of its pairs,
normalised by its length (and its square root), through a logistic curve of their logarithms that is fitted on
labelled rows which the counts leave out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.llm.common import cut_lineage
from rulewright.llm.decontaminate import SEPARATE
from rulewright.llm.labelled import labelled_texts, logistic_fit, sigmoid
from rulewright.llm.words import numbered_words, text_parts

#: Bytes of text that are counted or scored together.
PART_BYTES = 1 << 20
#: The share of a toxic text's words that the toxic model speaks for, and what is added to a feature before its logarithm, by feature.
SHARE = 0.002
FLOOR = np.array([1e-3, 1e-2, 1e-2])


def _numbered(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Each word's number, the distinct words, and each text's first word (and the end); words are of ASCII letters (lower-cased), digits and non-ASCII characters."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    plain = (data.to_pybytes() if data else b"")[at[0] : at[-1]].translate(SEPARATE)
    return numbered_words(pa.StringArray.from_buffers(len(texts), pa.py_buffer((at - at[0]).tobytes()), pa.py_buffer(plain)), lower=False)


def _before(code: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
    """The number of the word before each; `start` for a text's first."""
    out = np.concatenate(([start], code[:-1]))[: len(code)]
    out[first[:-1][np.diff(first) > 0]] = start
    return out


#: Least counts of the classes of counts that discounts are estimated for.
COUNTS = np.array([1, 2, 3, 4, 5, 9])


def discounts(counts: np.ndarray) -> np.ndarray:
    """What counts (2 x words or pairs) are discounted, by counts of counts: from 0 to the count itself.

    What a count tells of its class, where the other class has none, is seen by leaving out one occurrence. Those with
    k + 1 here and none there leave k for one that is here, and those with k here and one there leave k for one that is
    there. If the former come r times as often as the latter, and as the classes' sizes have it, 1 / r of the count is
    taken, all of it if r is 1 or less: then a count of k tells nothing. The larger r of both classes holds for both,
    which so treat what is rare alike. Where both classes have a count, at most 1 is taken, as Kneser and Ney estimate it.
    """
    best = np.ones(len(COUNTS))
    of = lambda c: np.maximum(np.searchsorted(COUNTS, c, "right") - 1, 0)
    for own, other in zip(counts, counts[::-1]):
        base = (own.sum() + 1) / (other.sum() + 1)
        alone, met = own[(other == 0) & (own > 1)], own[(other == 1) & (own > 0)]
        here, there = np.bincount(of(alone - 1), weights=alone, minlength=len(COUNTS)), np.bincount(of(met), minlength=len(COUNTS))
        best = np.maximum(best, (here + base) / ((there + 1) * base))
    n1, n2 = (np.array([(c == k).sum() for c in counts]) for k in (1, 2))
    in_both = counts.min(axis=0) > 0
    return np.stack([np.where(in_both, (a + 1) / (a + 2 * b + 2), own / best[of(own)]) for own, a, b in zip(counts, n1, n2)])


def kneser_ney(v: np.ndarray, w: np.ndarray, counts: np.ndarray, n_words: int, block: int = 500_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log ratios of probabilities, toxic to ordinary, from counts (2 x pairs) of words w after v: of words (the last is any unknown one), of the masses that contexts leave to words (0 for unknown contexts, and none, the last), and of pairs."""
    seen = np.stack([np.bincount(w[c > 0], minlength=n_words + 1) for c in counts])
    both = np.bincount(w, minlength=n_words + 1).astype(float)
    # what unknown words get: as large a share as words that occur once
    once = np.minimum(both, 1) * ((both == 1).sum() + 1) / (n_words + 1)
    shared = (both - once + once.sum() / (n_words + 1)) / both.sum()
    left = discounts(seen)
    word = (seen - left + left.sum(axis=1, keepdims=True) * shared) / seen.sum(axis=1, keepdims=True)
    left = discounts(counts).astype(np.float32)
    total, open_ = (np.stack([np.bincount(v, weights=c, minlength=n_words + 2) for c in x]) for x in (counts, left))
    mass = np.where(total > 0, np.maximum(open_, 1e-6) / np.maximum(total, 1), 1.0)
    pair = np.empty(len(v), np.float32)
    for a in range(0, len(v), block):
        at, to, own = v[a : a + block], w[a : a + block], counts[:, a : a + block] - left[:, a : a + block]
        p = own / np.maximum(total[:, at], 1) + mass[:, at] * word[:, to]
        pair[a : a + block] = np.log(p[1] / p[0])
    return np.log(word[1] / word[0]).astype(np.float32), np.log(mass[1] / mass[0]).astype(np.float32), pair


@dataclass
class Model:
    """Log ratios, toxic to ordinary."""

    words: pa.Array
    word: np.ndarray  # of words' probabilities; of unknown words last
    context: np.ndarray  # of the masses that contexts leave to words; 0 for unknown ones, and for none, the last
    pairs: np.ndarray  # context * (words + 1) + word of each pair, sorted
    pair: np.ndarray  # of pairs' probabilities
    curve: np.ndarray  # coefficients of the features, and intercept

    def ratios(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word its log ratio alone and after the word before it, and each text's first word (and the end)."""
        code, strings, first = _numbered(texts)
        n = len(self.words)
        known = pc.fill_null(pc.index_in(strings, value_set=self.words), n).to_numpy().astype(np.int64)
        w = known[code] if len(code) else np.zeros(0, np.int64)
        v = _before(w, first, n + 1)
        alone = self.word[w].astype(float)
        after = alone + self.context[v]
        if len(self.pairs):
            key = v * (n + 1) + w
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            after = np.where(self.pairs[at] == key, self.pair[at], after)
        return alone, after, first

    def features(self, texts: pa.Array) -> np.ndarray:
        alone, after, first = self.ratios(texts)
        sums = []
        for r in (alone, after):
            total = np.concatenate(([0.0], np.cumsum(np.log1p(SHARE * np.expm1(r)))))
            sums.append(np.maximum(total[first[1:]] - total[first[:-1]], 0))
        n = np.maximum(np.diff(first), 1)
        return np.log(FLOOR + np.column_stack((sums[0] / n, sums[0] / np.sqrt(n), sums[1] / n)))

    def score(self, texts: pa.Array) -> np.ndarray:
        return sigmoid(self.features(texts) @ self.curve[:-1] + self.curve[-1])


def _triples(batches):
    """Distinct words u, v, w in a row, u empty at a text's start, and whether ordinary and toxic texts have them."""
    for batch in text_parts(batches, PART_BYTES):
        code, strings, first = _numbered(batch.column("text"))
        n, code = len(strings), code.astype(np.int64)
        toxic = np.repeat(batch.column("toxic").to_numpy(), np.diff(first))
        v = _before(code, first, n)
        u = _before(v, first, n)
        inner = np.nonzero(v < n)[0]  # a text's first word follows none
        order = inner[np.lexsort((u[inner], v[inner], code[inner]))]
        rows = np.column_stack((u, v, code))[order]
        begin = np.nonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1)))[0] if len(rows) else np.zeros(0, int)
        named = pa.concat_arrays([strings.cast(pa.string()), pa.array([""], pa.string())])
        has = [np.add.reduceat(toxic[order] == k, begin) > 0 if len(begin) else np.zeros(0, bool) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*(named.take(pa.array(rows[begin, k])) for k in range(3)), *(pa.array(x.astype(np.int64)) for x in has)], names=["u", "v", "w", "ordinary", "toxic"])


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Coefficients of the features, fitted on standardised ones: one that doesn't vary has none. No sum of evidence for toxic speaks against it."""
    middle, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    x = (x - middle) / spread
    curve = logistic_fit(x, y, weight, ridge)
    if (curve[:-1] < 0).any():
        x[:, curve[:-1] < 0] = 0
        curve = logistic_fit(x, y, weight, ridge)
    curve[:-1] /= spread
    curve[-1] -= curve[:-1] @ middle
    return curve


def train(documents: DataFrame, labels: DataFrame, max_rows: int = 16_000) -> Model:
    """Fit on documents (doc_id, text) with labels (doc_id, toxic 0/1), of which about `max_rows` rows at most are used, half of each class.

    Other labels than 0 and 1, and labels without a document, are ignored; null and empty texts have no words; repeated
    rows count each; extra columns are ignored. With only one class, or none, nothing is compared: every text gets that
    class's share. The model has the sample's words and pairs, all of them, and so is bounded by the sample.
    """
    sample, weight = labelled_texts(documents, labels, "toxic", max_rows)
    sample = cut_lineage(sample)
    part = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(4))
    triples = sample.where(part > 0).select("text", "toxic").mapInArrow(_triples, "u string, v string, w string, ordinary long, toxic long")
    triples = triples.repartition("v", "w")  # one shuffle for both groupings
    for key, count in ((("u", "v", "w"), F.max), (("v", "w"), F.sum)):
        triples = triples.groupBy(*key).agg(count("ordinary").alias("ordinary"), count("toxic").alias("toxic"))
    table = triples.toArrow()
    counts = np.stack([table.column(c).to_numpy().astype(np.int32) for c in ("ordinary", "toxic")])
    none = np.zeros(0)
    model = Model(pa.array([], pa.string()), np.zeros(1, np.float32), np.zeros(2, np.float32), none.astype(np.int64), none, np.array([0.0] * len(FLOOR) + [-40.0 if not weight.get(1) else 40.0 if not weight.get(0) else 0.0]))
    if not counts.sum(axis=1).all():
        return model
    named = pc.unique(pa.concat_arrays([pc.unique(table.column(c).cast(pa.string())) for c in ("w", "v")]))
    v, w = (pc.index_in(table.column(c).cast(pa.string()), value_set=named).to_numpy() for c in ("v", "w"))
    del table
    n = len(named)
    word, context, pair = kneser_ney(v, w, counts, n)
    key = v.astype(np.int64) * (n + 1) + w
    order = np.argsort(key)
    model = Model(named, word, context, key[order], pair[order], model.curve)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        for batch in text_parts(batches, PART_BYTES):
            found = sent.value.features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(found.tolist(), pa.list_(pa.float64())), batch.column("toxic")], names=["x", "toxic"])

    left = sample.where(part == 0).select("text", "toxic").mapInArrow(measure, "x array<double>, toxic int").toArrow()
    sent.destroy()  # each executor has a copy; scoring sends the whole model
    x, y = np.array(left.column(0).to_pylist(), float).reshape(-1, len(FLOOR)), left.column(1).to_numpy()
    if len(x):
        model.curve = _curve(x, y, np.array([weight[k] for k in y.tolist()]))
    return model


def score(documents: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id and score, 0 to 1, higher for likelier toxic. Null and empty texts get the score of no words."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), score_column(documents, model).alias("score"))


def score_column(documents: DataFrame, model: Model) -> Column:
    """The score of each text as a Column of `documents`."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def toxicity(text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text], names=["text"])
        found = [sent.value.score(part.column("text")) for part in text_parts([batch], PART_BYTES)]
        pa.default_memory_pool().release_unused()
        return pa.array(np.concatenate([np.zeros(0), *found]))

    return toxicity(documents["text"].cast("string"))


def keep_ordinary(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents, all columns kept, whose score is below `threshold`. Null and empty texts are scored as no words; repeated rows each go or stay alike."""
    return documents.where(score_column(documents, model) < threshold)
