"""Operator 11: periodic runs of words by the runs theorem.

A run is a stretch of consecutive words with smallest period q, at least 2 q long, that neither neighbouring
word extends. Each run holds a Lyndon word of its period's length that is the longest Lyndon word of its start
under one of two orders of words, an order and its reverse. The longest Lyndon word of place i ends before the
next place whose suffix is smaller: the next smaller value of the inverse suffix array, and for the reversed
order the next greater one. So 2 n Lyndon words are extended to both sides by the longest common prefix, and
the longest common suffix, of both its ends; those that reach twice their length are the runs, each once or
more.

Suffix arrays and next smaller values are made for many texts at once: the inverse suffix array by prefix
doubling over places that aren't told apart yet, next smaller values by jumping over places already known to
be larger. Extensions are compared word by word up to `NEAR` words. Texts with longer ones get their LCP
array, and a sparse table for its range minima, once forwards and once backwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.llm.words import numbered_words, text_parts

#: Words by which extensions are compared directly, before range minima are asked.
NEAR = 16


def inverse_suffix_array(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each place's rank among the suffixes of its text, in one numbering over all texts; a text's end is smaller than any word. first: where texts begin, and the end."""
    n = len(words)
    ends = np.repeat(first[1:], np.diff(first))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    rank = np.zeros(n + 1, np.int64)
    places, key, step = np.arange(n), text * (int(words.max(initial=0)) + 1) + words, 0
    while len(places):
        order = np.argsort(key, kind="stable")
        places, key = places[order], key[order]
        new = np.append(True, key[1:] != key[:-1])
        begin = np.nonzero(new)[0]
        size = np.diff(np.append(begin, len(key)))
        if step:  # places of a group that stood together lie together; the first has the group's rank
            old = rank[places]
            group = np.append(True, old[1:] != old[:-1])
            start = np.maximum.accumulate(np.where(group, np.arange(len(places)), 0))
            rank[places] = old + np.repeat(begin, size) - start
        else:
            rank[places] = np.repeat(begin, size)
        places = places[np.repeat(size > 1, size)]
        step = 2 * step or 1
        key = rank[places] * (n + 2) + np.where(places + step < ends[places], rank[np.minimum(places + step, n)] + 1, 0)
    return rank[:n]


def next_smaller(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each place the next one of its text with a smaller value, or the text's end."""
    ends = np.repeat(first[1:], np.diff(first))
    to = np.arange(1, len(values) + 1)
    active = np.nonzero(to < ends)[0]
    while len(active):
        active = active[values[to[active]] > values[active]]
        # all values between a place and where it points are larger than its own, and so on from there
        to[active] = to[to[active]]
        active = active[to[active] < ends[active]]
    return to


class Lce:
    """Longest common prefixes of two suffixes of one text: the LCP array and a sparse table of its range minima."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.n, self.rank = n, inverse_suffix_array(words, np.array([0, n]))
        suffixes = np.empty(n, np.int64)
        suffixes[self.rank] = np.arange(n)
        levels = [np.array(self._lcp(words.tolist(), self.rank.tolist(), suffixes.tolist()), np.int32)]
        while 2 << (len(levels) - 1) <= n:
            half, last = 1 << (len(levels) - 1), levels[-1]
            levels.append(np.minimum(last[:-half], last[half:]))
        self.levels = levels

    @staticmethod
    def _lcp(words: list[int], rank: list[int], suffixes: list[int]) -> list[int]:
        """Of each rank: words that its suffix has in common with the one of the rank before."""
        n, out, h = len(words), [0] * len(words), 0
        for i, r in enumerate(rank):
            if r:
                j = suffixes[r - 1]
                most = n - max(i, j)
                while h < most and words[i + h] == words[j + h]:
                    h += 1
                out[r] = h
                h -= h > 0
            else:
                h = 0
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common prefix lengths of suffixes i < j; a suffix may be the text's end."""
        out = np.zeros(len(i), np.int64)
        inside = np.nonzero(j < self.n)[0]
        a, b = self.rank[i[inside]], self.rank[j[inside]]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(float))[1] - 1
        for k in np.unique(level).tolist():
            at = np.nonzero(level == k)[0]
            out[inside[at]] = np.minimum(self.levels[k][low[at]], self.levels[k][high[at] - (1 << k)])
        return out


def _near(words: np.ndarray, i: np.ndarray, j: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """Words, NEAR at most and `room` at most, that agree from i and j on, forwards (step 1) or backwards (-1)."""
    out = np.zeros(len(i), np.int64)
    active = np.arange(len(i))
    for _ in range(NEAR):
        active = active[out[active] < room[active]]
        active = active[words[i[active] + step * out[active]] == words[j[active] + step * out[active]]]
        out[active] += 1
    return out


def runs_of(words: np.ndarray, first: np.ndarray, min_length: int = 12) -> np.ndarray:
    """Runs of at least `min_length` words of some texts as rows (text, start in the text, length, period), by text, start and period. words: numbers, equal for equal words."""
    if not len(words):
        return np.zeros((0, 4), np.int64)
    rank = inverse_suffix_array(words, first)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    begin, end = first[:-1][text], first[1:][text]
    found = []
    for values in (rank, -rank):
        i, j = np.arange(len(words)), next_smaller(values, first)
        back = _near(words, i - 1, j - 1, i - begin, -1)
        fore = _near(words, i, np.minimum(j, len(words) - 1), end - j, 1)
        open_back, open_fore = (back == NEAR) & (i - begin > NEAR), (fore == NEAR) & (end - j > NEAR)
        keep = open_back | open_fore | ((back + fore >= j - i) & (back + fore + j - i >= min_length))
        found.append(np.column_stack((i, j, back, fore, open_back, open_fore))[keep])
    i, j, back, fore, open_back, open_fore = np.concatenate(found).T.copy()
    far = np.nonzero(open_back | open_fore)[0]
    far = far[np.argsort(text[i[far]], kind="stable")]
    for own in np.split(far, np.nonzero(np.diff(text[i[far]]))[0] + 1) if len(far) else []:
        a, b = first[text[i[own[0]]]], first[text[i[own[0]]] + 1]
        p, q = i[own] - a, j[own] - a
        fore[own] = Lce(words[a:b])(p, q)
        back[own] = Lce(words[a:b][::-1])(b - a - q, b - a - p)
    start, length, period = i - back, back + fore + j - i, j - i
    runs = np.column_stack((text[i], start - begin[i], length, period))[(length >= 2 * period) & (length >= min_length)]
    runs = runs[np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1], runs[:, 0]))]
    # in the reversed order a text's end is the largest: a word before it may be a power, of which the least period counts
    runs = runs[np.append(True, (runs[1:, :3] != runs[:-1, :3]).any(axis=1))] if len(runs) else runs
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def _found(batch: pa.RecordBatch, min_length: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Of each text: its number of words, its runs, and the text without repeats."""
    code, strings, first = numbered_words(batch.column("text"), lower=False)
    code = code.astype(np.int64)
    runs = runs_of(code, first, min_length)
    # words that any run holds after its first period
    change = np.zeros(len(code) + 1, np.int64)
    np.add.at(change, first[runs[:, 0]] + runs[:, 1] + runs[:, 3], 1)
    np.add.at(change, first[runs[:, 0]] + runs[:, 1] + runs[:, 2], -1)
    kept = np.cumsum(change[:-1]) == 0
    at = np.concatenate(([0], np.cumsum(kept)))[first]
    words = pa.ListArray.from_arrays(pa.array(at, pa.int32()), strings.take(pa.array(code[kept])))
    bounds = np.searchsorted(runs[:, 0], np.arange(len(first)))
    structs = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], ["start", "length", "period"])
    return pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), structs), pc.binary_join(words, " ")


def find_runs(documents: DataFrame, min_length: int = 12) -> DataFrame:
    """Per row of documents (doc_id, text): doc_id, n_words, runs (start, length, period; by start, then period) and collapsed, its words but those that repeat a run's first period, joined by one space.

    Words stand between ASCII white space and are told apart by case. Null, empty and blank texts have no words, no
    runs and an empty collapsed text. Repeated rows are searched each; rows without doc_id too; extra columns are
    ignored; an empty table gives an empty result. A text is searched whole, in memory that grows with its words.
    """

    def search(batches):
        for part in text_parts(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *_found(part, min_length)], names=["doc_id", "n_words", "runs", "collapsed"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(search, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
