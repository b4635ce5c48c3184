"""Operator 6: token counts that follow edits.

A document keeps a segment tree over its pre-tokens: a leaf covers a run of them and ends at a safe
cut (see tokens.py), where tokenising falls apart whatever lies on both sides. Inner nodes hold the
sums of characters and of tokens below. An edit finds its leaves by descending the character sums,
takes in a neighbour where the edit comes too near a leaf's end for the cut to be sure, re-encodes
that region alone, and updates the sums on the way up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.llm import tokens

#: Segments a leaf covers when built, and how many times that many characters-per-leaf a leaf may reach before the tree is dealt anew.
LEAF, GROWN = 32, 4

EDITS = "array<struct<start:long,length:long,insert:string>>"


class Tree:
    """Segment tree of one text; `chars` and `tokens` hold leaf values from `base` on and sums before."""

    def __init__(self, text: str, tokenizer: tokens.SegmentTokenizer, leaves: tuple[np.ndarray, np.ndarray] | None = None):
        """`leaves` are the characters and tokens of its leaves, where they are known."""
        self.text, self.tokenizer, self.reencoded = text, tokenizer, 0
        self._deal(*(leaves or next(_leaves([text], tokenizer))[1]))

    def _deal(self, chars: np.ndarray, counts: np.ndarray) -> None:
        """Build the tree over leaves of so many characters and tokens."""
        self.base = 1
        while self.base < len(chars):
            self.base *= 2
        self.used = len(chars)
        self.chars, self.tokens = np.zeros(2 * self.base, np.int64), np.zeros(2 * self.base, np.int64)
        self.chars[self.base : self.base + self.used], self.tokens[self.base : self.base + self.used] = chars, counts
        level = self.base
        while level > 1:
            for sums in (self.chars, self.tokens):
                sums[level // 2 : level] = sums[level : 2 * level : 2] + sums[level + 1 : 2 * level : 2]
            level //= 2

    def _anew(self) -> None:
        """Encode the whole text and deal its leaves out evenly."""
        self._deal(*next(_leaves([self.text], self.tokenizer))[1])
        self.reencoded += len(self.text)

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and where the leaf starts."""
        node, start = 1, 0
        while node < self.base:
            node *= 2
            if place >= start + self.chars[node]:
                start += int(self.chars[node])
                node += 1
        return node - self.base, start

    def _set(self, leaf: int, chars: int, count: int) -> None:
        node = self.base + leaf
        for sums, value in ((self.chars, chars), (self.tokens, count)):
            delta, at = value - int(sums[node]), node
            while at:
                sums[at] += delta
                at //= 2

    def edit(self, start: int, length: int, insert: str) -> None:
        """Replace text[start:start + length]; places beyond the text's end count as its end."""
        n = len(self.text)
        start = min(max(start, 0), n)
        stop = min(start + max(length, 0), n)
        self.text = self.text[:start] + insert + self.text[stop:]
        if not n:
            self._anew()
            return
        # a cut depends on the characters at its place and on both sides
        first, a = self._leaf_at(max(start - 2, 0))
        last, b = self._leaf_at(min(stop + 1, n - 1))
        b += int(self.chars[self.base + last])
        grown = b - a + len(insert) - (stop - start)
        self.reencoded += grown
        average = max(1, n // max(self.used, 1))
        self._set(first, grown, self.tokenizer.count(self.text[a : a + grown]))
        for leaf in range(first + 1, last + 1):
            self._set(leaf, 0, 0)
        if grown > 2 * GROWN * max(average, 64):
            self._anew()


def _leaves(texts: list[str], tokenizer: tokens.SegmentTokenizer):
    """For each text (its number first) the characters and tokens of its leaves; none for an empty text."""
    for a, b, part in tokenizer.parts(pa.array(texts, pa.string())):
        chars, counts = part.chars[part.unit], part.count[part.unit]
        for i in range(b - a):
            x, y = part.first[i], part.first[i + 1]
            at = np.arange(0, y - x if texts[a + i] else 0, LEAF)
            yield a + i, tuple(np.add.reduceat(v[x:y], at) if len(at) else v[:0] for v in (chars, counts))


COUNTS = "doc_id long, n_tokens long, n_tokens_after long, n_chars_after long, n_edits long, n_leaves long, encoded_chars long, reencoded_chars long, text_after string, leaf_chars array<int>, leaf_tokens array<int>"


def apply_edits(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """Count each document's tokens, then after its edits; `documents` has doc_id, text and edits (array of start, length, insert, applied in order).

    The tree's leaves after the edits come back as leaf_chars and leaf_tokens beside text_after. Given as columns of those names with a later batch of
    edits, they are taken up again: then only what edits touch is encoded, and encoded_chars, which counts what building trees took, is 0.
    Leaves that don't add up to the text's length are made anew. reencoded_chars counts what edits made the tree encode.

    Null texts count as empty and null edit lists as none; a null edit and null places are zeros, a null insert is empty. Strings of special
    tokens are ordinary text here. Each row is a document of its own; an empty table gives none; extra columns are ignored.
    """
    stored = {"leaf_chars", "leaf_tokens"} <= set(documents.columns)
    names = [c.split()[0] for c in COUNTS.split(", ")]
    kinds = [*[pa.int64()] * 8, pa.string(), *[pa.list_(pa.int32())] * 2]

    def run(batches):
        tokenizer = tokens.load(tokenizer_path, special_as_text=True)
        for batch in batches:
            ids, texts, edits, chars, counts = (batch.column(c).to_pylist() for c in ("doc_id", "text", "edits", "leaf_chars", "leaf_tokens"))
            texts = [t or "" for t in texts]
            known = [c is not None and k is not None and len(c) == len(k) and None not in c and None not in k and min(c, default=0) >= 0 and sum(c) == len(t) for t, c, k in zip(texts, chars, counts)]
            fresh = iter(_leaves([t for t, k in zip(texts, known) if not k], tokenizer))
            rows = []
            for i, text in enumerate(texts):
                tree = Tree(text, tokenizer, (np.array(chars[i], np.int64), np.array(counts[i], np.int64)) if known[i] else next(fresh)[1])
                first = tree.total
                for e in edits[i] or []:
                    e = e or {"start": 0, "length": 0, "insert": ""}
                    tree.edit(e["start"] or 0, e["length"] or 0, e["insert"] or "")
                used = slice(tree.base, tree.base + tree.used)
                rows.append((ids[i], first, tree.total, len(tree.text), len(edits[i] or []), tree.used, 0 if known[i] else len(text), tree.reencoded, tree.text, tree.chars[used], tree.tokens[used]))
            columns = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    leaves = [F.col(c).cast("array<int>").alias(c) if stored else F.lit(None).cast("array<int>").alias(c) for c in ("leaf_chars", "leaf_tokens")]
    kept = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("edits").cast(EDITS).alias("edits"), *leaves)
    return kept.mapInArrow(run, COUNTS)
