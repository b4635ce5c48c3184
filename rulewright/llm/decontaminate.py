"""Operator 4: benchmark decontamination with suffix arrays over the training text.

Each shard (an Arrow batch of documents) gets a word-level suffix array: its suffixes in the order
of their first `window` words. Every distinct window of the benchmark is looked up in it by binary
search, which gives the places that share it; a place has at most one window of each length, so hits
grow with the text whatever repeats. Words that no benchmark text has end a run, and a suffix enters
the array only if its run is long enough for some window that begins with the same word: others can't
match. For the longest verbatim matches, suffixes at the hits and those of the items hit are put in
their whole order together, by doubling the words compared; a suffix's longest match is with a
neighbour there.

The benchmark is sent to the tasks in blocks of about `block_words` words, one after another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.llm import tokens
from rulewright.llm.common import row_key, without_rows, written

#: Bytes of a lower-cased text that separate words: ASCII other than 0-9 and a-z (A-Z become a-z).
SEPARATE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

FOUND = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>, longest long, longest_item string, longest_start long"


def alnum_words(text: str | None) -> list[bytes]:
    """Words of ASCII letters (lower-cased), digits and non-ASCII characters; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(SEPARATE).split() if text else []


class TestSuffixes:
    """A block of the benchmark: word numbers from 1, and its distinct windows."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.number, self.items = window, {}, [item for item, _ in items]
        ids = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], np.int32) for _, words in items]
        sizes = np.array([len(x) for x in ids], np.int64)
        self.flat = np.concatenate([*ids, np.zeros(window, np.int32)])
        self.first = np.cumsum(sizes) - sizes
        # every window: the item and place where it starts, and its words, padded
        least = np.minimum(sizes, window)
        count = np.where(sizes > 0, sizes - least + 1, 0)
        self.item = np.repeat(np.arange(len(items)), count)
        self.place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + self.first[self.item]
        size = least[self.item]
        rows = self.flat[self.place[:, None] + np.arange(window)] if len(self.place) else np.zeros((0, window), np.int32)
        beyond = np.arange(window) >= size[:, None]
        keys, self.key = np.unique(_keys(np.where(beyond, 0, rows)), return_inverse=True)
        where = np.zeros(len(keys), np.int64)
        where[self.key] = np.arange(len(self.key))
        self.size = size[where]
        self.low, self.high = keys, _keys(np.where(beyond, 2**31 - 1, rows)[where])
        # items of each distinct window
        pairs = np.unique(np.stack((self.key, self.item), axis=1), axis=0) if len(self.key) else np.zeros((0, 2), np.int64)
        self.bounds, self.items_of = np.searchsorted(pairs[:, 0], np.arange(len(keys) + 1)), pairs[:, 1]
        self.least = np.full(len(self.number) + 1, 2**31 - 1, np.int64)
        np.minimum.at(self.least, rows[:, 0], size)


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings in the same order."""
    return np.ascontiguousarray(rows.astype(">i4")).view(f"S{4 * rows.shape[1]}").ravel()


def _shard_matches(texts: list[str | None], test: TestSuffixes):
    """Word counts of the texts, arrays (doc, start, window): where each distinct window of the benchmark occurs, the texts' word numbers and first words."""
    get, window = test.number.get, test.window
    counts, ids = [], []
    for text in texts:
        words = alnum_words(text)
        counts.append(len(words))
        ids.append(np.array([get(w, 0) for w in words] + [0], np.int32))
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    first = np.concatenate(([0], np.cumsum(np.array(counts, np.int64) + 1)))[:-1]
    # words left in the run of known words that a place is in
    ends = np.nonzero(flat == 0)[0]
    place = np.nonzero(flat)[0]
    left = ends[np.searchsorted(ends, place)] - place
    place = place[left >= test.least[flat[place]]]
    padded = np.concatenate((flat, np.zeros(window, np.int32)))
    keys = padded[place[:, None] + np.arange(window)]
    keys[np.logical_or.accumulate(keys == 0, axis=1)] = 0  # a run ends the key
    keys = _keys(keys)
    order = np.argsort(keys, kind="stable")
    suffixes, place = keys[order], place[order]  # the shard's suffix array
    lo = np.searchsorted(suffixes, test.low, "left")
    hi = np.searchsorted(suffixes, test.high, "right")
    hits = np.nonzero(hi > lo)[0]
    which = np.repeat(hits, (hi - lo)[hits])
    offset = np.arange(len(which)) - np.repeat(np.cumsum((hi - lo)[hits]) - (hi - lo)[hits], (hi - lo)[hits])
    at = place[lo[which] + offset]
    doc = np.searchsorted(first, at, "right") - 1
    return counts, doc, at - first[doc], which, flat, first


def _suffix_ranks(words: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4 … words, until a run's end; a 0 in `words` equals nothing, itself included."""
    ends = words == 0
    at = np.append(np.nonzero(ends)[0], len(words))
    longest = int(np.diff(np.append(-1, at)).max())
    rank = np.where(ends, words.max(initial=0) + 1 + np.arange(len(words)), words).astype(np.int64)
    rank = np.unique(rank, return_inverse=True)[1]
    out, step = [rank], 1
    while step < longest:
        after = np.zeros(len(words), np.int64)
        after[: len(words) - step] = rank[step:] + 1
        rank = np.unique(rank * (len(words) + 1) + after, return_inverse=True)[1]
        out.append(rank)
        step *= 2
    return out


def _longest_matches(words: np.ndarray, places: np.ndarray, tests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of `places` in `words` the most words that it shares with one of the places `tests`, and which of these that is."""
    ranks = _suffix_ranks(words)
    test_order = tests[np.argsort(ranks[-1][tests], kind="stable")]
    at = np.searchsorted(ranks[-1][test_order], ranks[-1][places])
    best, which = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
    for near in (np.minimum(at, len(test_order) - 1), np.maximum(at - 1, 0)):
        mine, theirs, shared = places.copy(), test_order[near].copy(), np.zeros(len(places), np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            inside = np.maximum(mine, theirs) < len(words)
            same = inside & (ranks[k][np.where(inside, mine, 0)] == ranks[k][np.where(inside, theirs, 0)])
            for x in (mine, theirs, shared):
                x[same] += 1 << k
        which = np.where(shared > best, test_order[near], which)
        best = np.maximum(best, shared)
    return best, which


def _merged(start: np.ndarray, end: np.ndarray) -> list[dict[str, int]]:
    spans: list[dict[str, int]] = []
    for a, b in sorted(zip(start.tolist(), end.tolist())):
        if spans and a <= spans[-1]["end"]:
            spans[-1]["end"] = max(spans[-1]["end"], b)
        else:
            spans.append({"start": a, "end": b})
    return spans


def _search(batches, items, window):
    test = TestSuffixes(items, window)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string())), ("longest", pa.int64()), ("longest_item", pa.string()), ("longest_start", pa.int64())])
    for batch in batches:
        counts, doc, start, which, flat, first = _shard_matches(batch.column("text").to_pylist(), test)
        order = np.argsort(doc, kind="stable")
        doc, start, which = doc[order], start[order], which[order]
        bounds = np.searchsorted(doc, np.arange(len(counts) + 1))
        if len(doc):
            # texts hit and items hit, in one line, each ended by a 0
            texts, windows = np.unique(doc), np.unique(which)
            items_hit = np.unique(test.items_of[tokens.gather(np.arange(len(test.items_of)), test.bounds[windows], np.diff(test.bounds)[windows])])
            sizes = np.array(counts, np.int64)[texts] + 1
            at = np.concatenate(([0], np.cumsum(sizes)))
            ends = np.append(test.first, len(test.flat) - window)
            own = np.isin(test.item, items_hit)
            lengths = (ends[1:] - ends[:-1])[items_hit]
            begins = at[-1] + np.cumsum(lengths + 1) - lengths - 1
            line = np.zeros(int(at[-1] + (lengths + 1).sum()), np.int32)
            line[: at[-1]] = tokens.gather(flat, first[texts], sizes)
            for b, item, n in zip(begins.tolist(), items_hit.tolist(), lengths.tolist()):
                line[b : b + n] = test.flat[test.first[item] : test.first[item] + n]
            places, tests = at[np.searchsorted(texts, doc)] + start, begins[np.searchsorted(items_hit, test.item[own])] + test.place[own] - test.first[test.item[own]]
            best, near = _longest_matches(line, places, tests)
            # a hit of an item shorter than a window is that item's whole length
            short = best < window
            near_item = np.where(short, test.items_of[test.bounds[which]], items_hit[np.searchsorted(begins, near, "right") - 1])
            best = np.where(short, test.size[which], best)
        rows = []
        for d, (n, id_) in enumerate(zip(counts, batch.column("doc_id").to_pylist())):
            a, b = bounds[d], bounds[d + 1]
            row = {"doc_id": id_, "n_words": n, "spans": [], "items": [], "longest": 0, "longest_item": None, "longest_start": None}
            if b > a:
                row["spans"] = _merged(start[a:b], start[a:b] + test.size[which[a:b]])
                found = np.unique(which[a:b])
                row["items"] = sorted({test.items[i] for w in found.tolist() for i in test.items_of[test.bounds[w] : test.bounds[w + 1]].tolist()})
                x = a + np.lexsort((start[a:b], -best[a:b]))[0]
                row |= {"longest": int(best[x]), "longest_item": test.items[near_item[x]], "longest_start": int(start[x])}
            rows.append(row)
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def find_matches(documents: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 2_000_000) -> DataFrame:
    """One row per document: doc_id, n_words, spans (merged word spans covered by benchmark windows), items
    (sorted distinct ids), and the longest verbatim match: its length in words, item and first word.

    A window is `window` consecutive words of an item; an item of fewer words is one window. Null and
    empty texts have no words. Repeated documents each get a row; items that share an id count as one;
    items without id or words are no items. An empty benchmark finds nothing. Extra columns are ignored.
    """
    kept = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.size(F.split("text", "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")))).first()[0] or 0
    blocks = max(1, -(-int(size) // block_words))

    def block(i: int) -> list[tuple[str, list[bytes]]]:
        """Items of a block and their words; those without a word are left out. Items that share an id share a block."""
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).toArrow()
        return [(k, w) for k, t in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()) if (w := alnum_words(t))]

    context = documents.sparkSession.sparkContext
    if blocks == 1:
        sent = context.broadcast(block(0))
        return kept.mapInArrow(lambda b: _search(b, sent.value, window), FOUND)
    numbered = kept.withColumn("doc_id", F.struct("doc_id", F.monotonically_increasing_id().alias("row")))
    tagged = FOUND.replace("doc_id long", "doc_id struct<doc_id:long,row:long>")
    union = None
    for i in range(blocks):
        sent = context.broadcast(block(i))

        def run(batches, sent=sent):
            for batch in batches:
                ids = batch.column("doc_id")
                for out in _search([batch.set_column(0, "doc_id", ids.field(0))], sent.value, window):
                    yield out.set_column(0, "doc_id", ids)

        # each block's finds are written before the next is sent, so the driver holds one block at a time
        part = written(numbered.mapInArrow(run, tagged))
        sent.destroy()
        union = part if union is None else union.unionByName(part)
    best = F.max_by(F.struct("longest", "longest_item", "longest_start"), F.col("longest"))
    both = union.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), best.alias("b"))
    # sorted spans that touch become one
    last = lambda acc: F.element_at(acc, -1)
    merge = F.aggregate(
        "s",
        F.lit(None).cast("array<struct<start:long,end:long>>"),
        lambda acc, x: F.when(acc.isNull(), F.array(x)).when(x["start"] <= last(acc)["end"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))),
    )
    return both.select(F.col("doc_id.doc_id").alias("doc_id"), "n_words", F.coalesce(merge, F.array().cast("array<struct<start:long,end:long>>")).alias("spans"), "items", "b.longest", "b.longest_item", "b.longest_start")


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 10, by_row: bool = False) -> DataFrame:
    """The documents, all columns kept, in which no window of the benchmark occurs.

    Rows that share a doc_id go together; with `by_row` each goes by its own text, whatever its doc_id.
    """
    key = row_key(documents) if by_row else documents["doc_id"].cast("long")
    hit = find_matches(documents.select(key.alias("doc_id"), "text"), benchmark, window).where(F.size("spans") > 0).select(F.col("doc_id").alias("_hit"))
    return without_rows(documents, hit, key)
