"""Byte-BPE tokenising of whole Arrow batches, each distinct segment of text encoded once.

A *safe cut* is a single space between two non-space characters. The pre-tokeniser always starts a
piece there, and whether a place is a safe cut depends on its two neighbours only. So the ids of a
text are those of its segments between safe cuts, joined. Texts are split and their segments numbered
in Arrow, distinct segments encoded in one call of the library, and the ids put together by index.
"""

from __future__ import annotations

import os
import re
import sys
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# one thread per task: Spark runs as many tasks as there are cores
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Bytes of text put together at a time; words encoded in one string, and other pieces in one call; pieces remembered per worker since
#: the memory was last dealt anew, which then keeps those before as the older half; characters of the longest that is remembered; pieces
#: up to which looking them up would take longer than encoding them.
PART_BYTES, TOGETHER, MEMORY, LONGEST, FEW = 2 << 20, 1000, 400_000, 40, 1000

_loaded: dict[tuple[str, bool], "SegmentTokenizer"] = {}


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices flat[start:start + length], one after another."""
    ends = np.cumsum(length)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)]


def _true(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(bool)


class Remembered:
    """Pieces of text with their ids, in Arrow and numpy: as Python's strings in a dict they would take several times the memory."""

    def __init__(self):
        self.pieces, self.flat, self.count = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int32)

    def find(self, pieces: pa.Array) -> np.ndarray:
        """Where each piece is among those remembered, or -1."""
        return pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1).to_numpy()

    def add(self, pieces: pa.Array, flat: np.ndarray, count: np.ndarray) -> None:
        """Remember pieces that aren't yet, with their ids one after another and how many each has."""
        self.pieces = pa.concat_arrays([self.pieces, pieces])
        self.flat, self.count = np.concatenate((self.flat, flat)), np.concatenate((self.count, count), dtype=np.int32)


@dataclass
class Segments:
    """Segments of some texts: of text i those from first[i] to first[i + 1]."""

    first: np.ndarray
    unit: np.ndarray  # which distinct segment each is
    chars: np.ndarray  # of each distinct segment, the space before it included
    count: np.ndarray  # ids of each distinct segment
    flat: np.ndarray  # their ids, one after another

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, and where each text's begin (and the end)."""
        count = self.count[self.unit]
        ends = np.concatenate(([0], np.cumsum(count)))
        return gather(self.flat, (np.cumsum(self.count) - self.count)[self.unit], count), ends[self.first]


class SegmentTokenizer:
    """ids of texts by the `tokenizers` library, without special tokens being added."""

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.special = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known, self.older = Remembered(), Remembered()
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.begins[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True  # byte-level BPE's sign for a space

    def _plain(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of pieces of text, as they stand, one after another, and how many each has."""
        flat, count = [np.zeros(0, np.uint32)], []
        for i in range(0, len(pieces), TOGETHER):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces[i : i + TOGETHER], add_special_tokens=False)]
            flat.append(np.fromiter(chain.from_iterable(found), np.uint32))
            count += map(len, found)
        return np.concatenate(flat), np.array(count, np.int64)

    def count(self, text: str) -> int:
        """How many ids a piece of text has, as it stands."""
        return len(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0])

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids and counts of words, each a space and letters: encoded many in one string, and told apart by the spaces that tokens begin with."""
        made = [(np.zeros(0, np.uint32), np.zeros(0, np.int64))]
        for i in range(0, len(words), TOGETHER):
            group = words[i : i + TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(group)], add_special_tokens=False)[0].ids, np.uint32)
            at = np.append(np.nonzero(self.begins[ids])[0], len(ids))
            made.append((ids, np.diff(at)) if len(at) == len(group) + 1 and not at[0] else self._plain(group))
        flat, count = zip(*made)
        return np.concatenate(flat), np.concatenate(count)

    def _encoded(self, pieces: pa.Array, are_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct pieces, of which the first `are_words` are words: an array of ids, where each piece's begin in it, and how many they are."""
        few = len(pieces) <= FEW
        if len(self.known.pieces) > MEMORY:
            self.older, self.known = self.known, Remembered()
        sources = [] if few else [self.known, self.older]
        flat, count, place, left, total = [], [], np.empty(len(pieces), np.int64), np.arange(len(pieces)), 0
        for source in sources:
            found = source.find(pieces.take(pa.array(left)))
            place[left] = found + total
            left = left[found < 0]
            flat.append(source.flat)
            count.append(source.count)
            total += len(source.count)
        strings, split = pieces.take(pa.array(left)).to_pylist(), int(np.searchsorted(left, are_words))
        for made in (self._words(strings[:split]), self._plain(strings[split:])):
            flat.append(made[0])
            count.append(made[1])
        place[left] = total + np.arange(len(left))
        known = len(self.known.count)
        flat, count = np.concatenate(flat), np.concatenate(count)
        start, count = (np.cumsum(count) - count)[place], count[place]
        if not few:
            new = np.nonzero(place >= known)[0]
            new = new[pc.utf8_length(pieces.take(pa.array(new))).to_numpy() <= LONGEST]
            self.known.add(pieces.take(pa.array(new)), gather(flat, start[new], count[new]), count[new])
        return flat, start, count

    def _split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Strings of the texts' segments, without the space before each but the first, which string each segment is, and each text's first segment."""
        parts = pc.split_pattern(texts, " ")
        coded = parts.flatten().dictionary_encode()
        strings, code, first = coded.dictionary, coded.indices.to_numpy(), parts.offsets.to_numpy().astype(np.int64)
        first -= first[0]
        size = pc.binary_length(strings).to_numpy()
        begins, ends = ((size == 0) | (pc.binary_length(trim(strings)).to_numpy() < size) for trim in (pc.utf8_ltrim_whitespace, pc.utf8_rtrim_whitespace))
        odd = np.zeros(len(texts), bool)
        if len(code) > 1:
            unsafe = ends[code[:-1]] | begins[code[1:]]
            unsafe[first[1:-1] - 1] = False
            odd[np.searchsorted(first, np.nonzero(unsafe)[0], "right") - 1] = True
        whole = np.zeros(len(texts), bool)
        for s in self.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        at = np.nonzero(odd | whole)[0]
        if not len(at):
            return strings, code, first
        # texts with other spaces are split by pattern; those with special tokens are one segment
        others = [[t] if w else SAFE_CUT.split(t) for t, w in zip(texts.take(pa.array(at)).to_pylist(), whole[at].tolist())]
        more = pa.array([x for xs in others for x in xs], pa.string()).dictionary_encode()
        start, count = first[:-1].copy(), np.diff(first)
        count[at] = list(map(len, others))
        start[at] = len(code) + np.cumsum(count[at]) - count[at]
        code = gather(np.concatenate((code, more.indices.to_numpy() + len(strings))), start, count)
        return pa.concat_arrays([strings, more.dictionary]), code, np.concatenate(([0], np.cumsum(count)))

    def segments(self, texts: pa.Array) -> Segments:
        """Segments of texts (null: empty)."""
        strings, code, first = self._split(pc.fill_null(texts.cast(pa.string()), ""))
        unit = code.astype(np.int64)
        unit[first[:-1]] += len(strings)
        used = np.zeros(2 * len(strings), bool)
        used[unit] = True
        unit = (np.cumsum(used) - 1)[unit]
        later, leading = (strings.take(pa.array(np.nonzero(u)[0])) for u in (used[: len(strings)], used[len(strings) :]))
        # letters, a stop or comma, a line end and letters are pieces of their own, which recur far more often
        lines = pc.split_pattern(later, "\n")
        at, flat = lines.offsets.to_numpy().astype(np.int64), lines.flatten()
        at -= at[0]
        two = np.diff(at) == 2
        head, after = flat.take(pa.array(at[:-1])), flat.take(pa.array(np.where(two, at[:-1] + 1, 0), mask=~two))
        word = pc.utf8_rtrim(head, ".,")
        stops = (pc.binary_length(head).to_numpy() - pc.binary_length(word).to_numpy()) if len(head) else np.zeros(0, int)
        fits = (np.diff(at) <= 2) & (stops <= 1) & _true(pc.utf8_is_alpha(word)) & (~two | _true(pc.utf8_is_alpha(pc.fill_null(after, ""))))
        simple = pa.array(fits)
        stop = pc.if_else(pc.ends_with(head, "."), ".", ",")
        pick = lambda use, x: pc.if_else(pa.array(fits & use), x, "")
        blank = pa.array([""] * len(leading), pa.string())
        words = pc.binary_join_element_wise(" ", word.filter(simple), "").dictionary_encode()
        rest = pa.concat_arrays([pc.binary_join_element_wise(" ", later.filter(pa.array(~fits)), ""), leading, *(pa.concat_arrays([x, blank]) for x in (pick(stops == 1, stop), pick(two, "\n"), pick(two, after)))]).dictionary_encode()
        raw, start, sizes = self._encoded(pa.concat_arrays([words.dictionary, rest.dictionary]), len(words.dictionary))
        n_odd, n = int((~fits).sum()), len(later) + len(leading)
        index = rest.indices.to_numpy().astype(np.int64) + len(words.dictionary)
        of = np.empty((n, 4), np.int64)
        of[np.nonzero(fits)[0], 0] = words.indices.to_numpy()
        of[np.nonzero(~fits)[0], 0] = index[:n_odd]
        of[len(later) :, 0] = index[n_odd : n_odd + len(leading)]
        of[:, 1:] = index[n_odd + len(leading) :].reshape(3, n).T
        count = sizes[of]
        chars = np.concatenate((pc.utf8_length(later).to_numpy() + 1, pc.utf8_length(leading).to_numpy()))
        return Segments(first, unit, chars.astype(np.int64), count.sum(axis=1), gather(raw, start[of.ravel()], count.ravel()))

    def parts(self, texts: pa.Array):
        """(from, to) ranges of texts of about PART_BYTES together, at least one text each, and their Segments."""
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + PART_BYTES, "right")))
            yield a, b, self.segments(texts.slice(a, b - a))
            pa.default_memory_pool().release_unused()  # else a worker keeps it through later stages
            a = b

    def ids(self, text: str | None) -> bytes:
        """ids of one whole text as little-endian unsigned 32-bit numbers; none for null."""
        return next(self.batch_ids(pa.array([text], pa.string()))).tobytes()

    def batch_ids(self, texts: pa.Array):
        """For each text in turn its ids as an array of little-endian unsigned 32-bit numbers."""
        for _, _, part in self.parts(texts):
            flat, bounds = part.ids()
            flat = flat if sys.byteorder == "little" else flat.astype("<u4")
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                yield flat[a:b]


def load(path: str, special_as_text: bool = False) -> SegmentTokenizer:
    """The tokenizer of a vocabulary file, loaded once per worker process."""
    key = (path, special_as_text)
    if key not in _loaded:
        _loaded[key] = SegmentTokenizer(path, special_as_text)
    return _loaded[key]
