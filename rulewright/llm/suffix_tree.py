"""Operator 3: a probabilistic suffix tree over words, as a language model.

Tokens are lower-cased words and one end per text. A state of the tree is a context of up to `depth`
preceding words. A context is retained if its next-word distribution diverges from its parent's (its
longest proper suffix) by at least `min_gain` nats a token, measured by leaving each occurrence out in
turn; one that occurs once never does. Every context and every next word that occurs is counted,
whatever its share, so the tree grows with the corpus. A token is scored in the longest retained suffix
of what precedes it.

Distributions are smoothed by absolute discounting: a state gives a word (count - discount) / total, and
the mass that is taken off goes to the parent's distribution. The root does the same over single words;
what it discounts goes to one symbol that stands for all unknown words.

All contexts that end with the same word form one subtree. Every token is dealt to the bucket of the word
before it, with its other context words; there the subtree is counted, pruned and used to score. One
shuffle does it all, of compressed columns: a row holds a bucket's tokens of one part of a batch.
Contexts with more tokens than a bucket should hold are *hot*. Their tokens are dealt by one more context
word, and their own distributions are counted ahead and broadcast, with entries for words of at least the
share `min_joint` of all tokens (1 / min_joint entries a length at most). Entries of rarer words are kept in a table;
buckets ask for those that their tokens meet, by a join, and get them with their tokens. The root's frequent words are
broadcast likewise. A rare word's count, which gives its root probability, is known in the bucket of the
tokens that follow it; what a text's buckets found comes together by part of a batch, where both meet.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.llm.common import written
from rulewright.llm.words import hashes, numbered_words, text_parts

#: What ends every text, and what precedes its first word.
END, START = (np.uint64(xxhash.xxh64_intdigest(x, 7)) for x in (b"\n", b"\n\n"))
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Level:
    """Hot contexts of one length, by hash, and their entries, by hash of context and word."""

    context: np.ndarray
    rest: np.ndarray  # mass that goes to the parent
    entry: np.ndarray
    share: np.ndarray
    rarer: bool  # whether there are entries that aren't broadcast


@dataclass
class Model:
    """The broadcast part: counts of all training tokens, the frequent words, and the hot contexts."""

    total: int
    types: int
    texts: int
    cut: float  # the root's discount
    words: np.ndarray  # sorted hashes of frequent words
    count: np.ndarray
    depth: int
    buckets: int
    capacity: int
    min_word: float
    min_gain: float
    discount: float
    hot: list[Level] = field(default_factory=list)

    def root(self, count: np.ndarray) -> np.ndarray:
        """Root probability of words by their counts; all unknown words share one symbol."""
        total = max(self.total, 1)
        unknown = self.cut * self.types / total if self.total else 1.0
        return np.where(count > 0, (count - self.cut) / total, max(unknown, 1e-300))

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.total + self.types + 1))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two."""
    x = (a ^ (b + _ODD + (a << np.uint64(6)) + (a >> np.uint64(2)))) * _ODD
    return x ^ (x >> np.uint64(29))


def _short(hashes: np.ndarray) -> np.ndarray:
    """A rare word's number: 31 bits of its hash, with the sign bit."""
    return (hashes >> np.uint64(33)).astype(np.int64) - (1 << 31)


def _place(ordered: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted number is in an ordered array, or -1."""
    if not len(ordered):
        return np.full(len(wanted), -1, np.int64)
    at = np.searchsorted(ordered, wanted)
    at[at == len(ordered)] = 0
    return np.where(ordered[at] == wanted, at, -1)


@dataclass
class Tokens:
    """Tokens of some texts, ends included: which text each is of, its word's number, and the distinct words' hashes (the end last but one, then the start)."""

    text: np.ndarray
    word: np.ndarray
    hash: np.ndarray
    position: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Tokens:
        code, distinct, first = numbered_words(texts)
        n = len(first) - 1
        size = np.diff(first) + 1
        text = np.repeat(np.arange(n), size)
        ends = np.cumsum(size) - 1
        word = np.full(len(text), len(distinct), np.int64)
        words = np.ones(len(text), bool)
        words[ends] = False
        word[words] = code
        position = np.arange(len(text)) - np.repeat(ends + 1 - size, size)
        return cls(text, word, np.concatenate((hashes(distinct, 0), [END, START])), position)

    def before(self, k: int) -> np.ndarray:
        """The number of the word k places before each token; the start's number there is none."""
        out = np.full(len(self.word), len(self.hash) - 1, np.int64)
        out[k:] = self.word[: len(self.word) - k] if k < len(self.word) else out[k:]
        out[self.position < k] = len(self.hash) - 1
        return out

    def contexts(self, depth: int):
        """The hash of each token's context of 1, 2 … words."""
        made = None
        for k in range(1, depth + 1):
            h = self.hash[self.before(k)]
            made = h if made is None else _mix(made, h)
            yield made


def _word_counts(batches):
    """(k, n, m): a part's training tokens by word, and with the end the number of all tokens."""
    for part in text_parts(batches):
        tokens = Tokens.of(part.column("text"))
        learn = part.column("learn").to_numpy(zero_copy_only=False).astype(bool)
        n = np.bincount(tokens.word[learn[tokens.text]], minlength=len(tokens.hash))[:-1]
        m = np.zeros(len(n), np.int64)
        m[-1] = len(tokens.word)
        some = (n > 0) | (m > 0)
        yield pa.RecordBatch.from_arrays([pa.array(tokens.hash[:-1][some].view(np.int64)), pa.array(n[some]), pa.array(m[some])], names=["k", "n", "m"])


def _hot_entries(batches, hot: np.ndarray, depth: int):
    """(c, k, next, n): training tokens that follow hot contexts of a length, by context and word, and the hash of the longer context they make."""
    for part in text_parts(batches):
        tokens = Tokens.of(part.column("text"))
        *_, context = tokens.contexts(depth)
        longer = tokens.hash[tokens.word]
        for k in range(1, depth + 1):
            longer = _mix(longer, tokens.hash[tokens.before(k)])
        use = (_place(hot, context) >= 0) & part.column("learn").to_numpy(zero_copy_only=False).astype(bool)[tokens.text]
        rows = np.stack((context[use], tokens.hash[tokens.word[use]], longer[use]), axis=1)
        _, at, n = np.unique(_mix(rows[:, 0], rows[:, 1]), return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([*(pa.array(rows[at, i].view(np.int64)) for i in range(3)), pa.array(n.astype(np.int64))], names=["c", "k", "next", "n"])


def _table(documents: DataFrame, learn: Column) -> DataFrame:
    """(row, doc_id, text, learn), row being a number of its own for each row."""
    return documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))


def _rarer_entries(batches, hot: np.ndarray, size: np.ndarray, discount: float):
    """(entry, share) of entries (c, k, n)."""
    for batch in batches:
        c, k = (batch.column(x).to_numpy().view(np.uint64) for x in ("c", "k"))
        share = (batch.column("n").to_numpy() - discount) / size[_place(hot, c)]
        yield pa.RecordBatch.from_arrays([pa.array(_mix(c, k).view(np.int64)), pa.array(share)], names=["entry", "share"])


def _broadcast_part(rows: DataFrame, depth: int = 2, capacity: int = 1_200_000, min_word: float = 1e-6, min_joint: float = 2.5e-7, hot_share: float = 0.005, min_gain: float = 0.02, discount: float = 0.75) -> tuple[Model, DataFrame | None]:
    """From rows (text, learn): the broadcast part of the model, and the hot contexts' other entries (entry, share), if any.

    A bucket has about `capacity` tokens, and a context of more than half as many is hot, or of more than `hot_share` of all. At most 1 / min_word words, 1 / min_joint entries
    a length and 1 / hot_share or twice all tokens / capacity hot contexts reach the driver.
    """
    counted = rows.select("text", "learn").mapInArrow(_word_counts, "k long, n long, m long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    counted = written(counted)
    end = int(END.view(np.int64))
    total, types, once, twice, texts, tokens = (int(x or 0) for x in counted.agg(F.sum("n"), F.count_if(F.col("n") > 0), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2), F.sum(F.when(F.col("k") == end, F.col("n"))), F.sum("m")).first())
    cut = once / (once + 2 * twice) if once and twice else 0.5
    frequent = counted.where(((F.col("n") > 0) & (F.col("n") >= min_word * total)) | (F.col("k") == end)).select("k", "n").toArrow()
    words, n = frequent.column("k").to_numpy().view(np.uint64), frequent.column("n").to_numpy()
    order = np.argsort(words)
    model = Model(total, types, texts, cut, words[order], n[order], depth, max(1, -(-tokens // capacity)), capacity, min_word, min_gain, discount)
    limit = min(capacity // 2, hot_share * total)
    # longer hot contexts are made of broadcast entries
    least = min(min_joint * total, limit)
    often = (n > limit) & (words != END)
    hot, size = words[often], n[often]
    if texts > limit:
        hot, size = np.append(hot, START), np.append(size, texts)
    rarer = None
    while len(hot) and len(model.hot) < depth:
        order = np.argsort(hot)
        hot, size = hot[order], size[order]
        d = len(model.hot) + 1
        found = rows.select("text", "learn").mapInArrow(lambda b, h=hot, d=d: _hot_entries(b, h, d), "c long, k long, next long, n long").groupBy("c", "k").agg(F.max("next").alias("next"), F.sum("n").alias("n"))
        found = written(found)
        entries = found.where(F.col("n") >= least).toArrow()
        # an entry gives up the discount, whether it is broadcast or not
        types_of = found.groupBy("c").agg(F.count("*").alias("types"), F.count_if(F.col("n") < least).alias("rarer")).toArrow()
        kinds, others = np.zeros(len(hot)), types_of.column("rarer").to_numpy().sum()
        kinds[_place(hot, types_of.column("c").to_numpy().view(np.uint64))] = types_of.column("types").to_numpy()
        if others:
            table = found.where(F.col("n") < least).mapInArrow(lambda b, h=hot, s=size: _rarer_entries(b, h, s, discount), "entry long, share double")
            rarer = table if rarer is None else rarer.unionByName(table)
        c, k, longer, times = (entries.column(x).to_numpy() for x in ("c", "k", "next", "n"))
        at = _place(hot, c.view(np.uint64))
        share = (times - discount) / size[at]
        keys = _mix(c.view(np.uint64), k.view(np.uint64))
        order = np.argsort(keys)
        model.hot.append(Level(hot, discount * kinds / size, keys[order], share[order], bool(others)))
        more = (times > limit) & (k != end)
        hot, size = longer[more].view(np.uint64), times[more]
    return model, rarer


#: Columns of a bucket's tokens, in the order of a row's compressed bytes: words, the words before and how many
#: tokens follow each, texts, hot contexts' lengths and what they make of root probabilities; and of texts that end here their ids, their
#: numbers of tokens and of known frequent words, and these words' base score; and tokens whose entry of a hot context isn't broadcast, by
#: their place here, with the entry's hash and what its share is multiplied by.
KINDS = {"word": np.int32, "before": np.uint64, "run": np.int32, "text": np.int32, "deep": np.int8, "a": np.float64, "b": np.float64, "end": np.int32, "id": np.int64, "has": np.int8, "tokens": np.int32, "known": np.int32, "base": np.float64, "rarer_at": np.int32, "rarer": np.uint64, "by": np.float64}
#: Columns of a bucket's results for a part: texts and their scores there; rare words' texts, numbers and counts; texts and numbers of rare
#: words that a state has an entry for, with what it makes of their root probabilities; and the ends as above.
FOUND = {"text": np.int32, "score": np.float32, "rare_text": np.int32, "rare": np.int32, "count": np.int32, "held_text": np.int32, "held": np.int32, "a": np.float32, "b": np.float32, "end": np.int32, "id": np.int64, "has": np.int8, "tokens": np.int32, "known": np.int32, "base": np.float64}


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns with like bytes of their numbers side by side, compressed."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns]
    return np.array([len(c) for c in columns], np.int64).tobytes() + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpacked(raw: bytes, kinds: list) -> list[np.ndarray]:
    sizes = np.frombuffer(raw[: 8 * len(kinds)], np.int64)
    planes, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[8 * len(kinds) :]), np.uint8), 0, []
    for n, kind in zip(sizes.tolist(), kinds):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(planes[at : at + n * width].reshape(width, n).T).view(kind).ravel())
        at += n * width
    return out


def _met(tokens: Tokens, model: Model):
    """Of each token its bucket, and what its hot contexts make of it: their number, a and b. Also tokens without a broadcast entry of a hot context that has more: places, entries, and what their shares are multiplied by."""
    deep, a, b = np.zeros(len(tokens.word), np.int8), np.zeros(len(tokens.word)), np.ones(len(tokens.word))
    rarer: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0))]
    for d, context in enumerate(tokens.contexts(model.depth), 1):
        # dealt by the shortest context that isn't hot
        target = context if d == 1 else np.where(deep == d - 1, context, target)
        if d > len(model.hot):
            break
        level = model.hot[d - 1]
        found = _place(level.context, context)
        at = np.nonzero((found >= 0) & (deep == d - 1))[0]
        key = _mix(context[at], tokens.hash[tokens.word[at]])
        entry = _place(level.entry, key)
        rest = level.rest[found[at]]
        a[at] = np.where(entry >= 0, np.append(level.share, 0.0)[entry], 0.0) + rest * a[at]
        b[at] *= rest
        deep[at] = d
        if level.rarer:
            rarer.append((at[entry < 0], key[entry < 0], b[at[entry < 0]]))
    if len(model.hot) == model.depth:
        target = np.where(deep == model.depth, _mix(target, tokens.hash[tokens.word]), target)
    at, key, own = (np.concatenate(x) for x in zip(*rarer))
    # longer contexts take their part of a share
    return ((target >> np.uint64(20)) % np.uint64(model.buckets)).astype(np.int64), deep, a, b, (at, key, b[at] / own)


def _asked(batches, model: Model):
    """(bucket, entry): entries that aren't broadcast and that tokens of a bucket may need, once a part."""
    for part in text_parts(batches):
        bucket, _, _, _, (at, key, _) = _met(Tokens.of(part.column("text")), model)
        pairs = np.unique(np.stack((bucket[at], key.view(np.int64)), axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["bucket", "entry"])


def _answer(table: pa.Table) -> pa.Table:
    """A bucket's entries and shares as a row (bucket, row, tokens), its row being -1."""
    entry, at = np.unique(table.column("entry").to_numpy().view(np.uint64), return_index=True)
    packed = _packed([entry, table.column("share").to_numpy()[at]])
    return pa.table({"bucket": table.column("bucket")[:1], "row": pa.array([-1], pa.int64()), "tokens": pa.array([packed], pa.binary())})


def _deal(batches, model: Model):
    """Rows (bucket, row, tokens): a part's tokens by bucket; `row` is that of the part's first text."""
    kinds = [*KINDS.values(), *[np.int32] * (model.depth - 1)]
    for part in text_parts(batches):
        rows = part.column("row").to_numpy()
        # texts are told apart by their place from the part's first row
        offset, learn = rows - rows[0], part.column("learn").to_numpy(zero_copy_only=False).astype(np.int64)
        ids, has = part.column("doc_id").fill_null(0).to_numpy(), part.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
        tokens = Tokens.of(part.column("text"))
        place = _place(model.words, tokens.hash)
        place[-1] = -1
        short = np.where(place >= 0, place, _short(tokens.hash)).astype(np.int32)
        bucket, deep, a, b, (rarer_at, rarer, by) = _met(tokens, model)
        before = tokens.hash[tokens.before(1)]
        order = np.argsort(before)
        order = order[np.argsort(bucket[order].astype(np.uint16) if model.buckets < 1 << 16 else bucket[order], kind="stable")]
        bounds = np.searchsorted(bucket[order], np.arange(model.buckets + 1))
        count = np.append(model.count, 0)[place]
        size = np.bincount(tokens.text)
        usual = place[tokens.word] >= 0
        known, base = (np.bincount(tokens.text[usual], x[tokens.word[usual]], minlength=len(size)) for x in (count > 0, model.base(count)))
        earlier = [short[tokens.before(k)] for k in range(2, model.depth + 1)]
        word, text = short[tokens.word], (offset[tokens.text] * 2 + learn[tokens.text]).astype(np.int32)
        # where each token stands in its bucket
        in_bucket = np.empty(len(order), np.int64)
        in_bucket[order] = np.arange(len(order)) - bounds[bucket[order]]
        rarer_order = np.argsort(bucket[rarer_at], kind="stable")
        rarer_at, rarer, by = rarer_at[rarer_order], rarer[rarer_order], by[rarer_order]
        rarer_bounds = np.searchsorted(bucket[rarer_at], np.arange(model.buckets + 1))
        made: tuple[list, list] = ([], [])
        for i in np.nonzero(np.diff(bounds))[0].tolist():
            at = order[bounds[i] : bounds[i + 1]]
            more = slice(rarer_bounds[i], rarer_bounds[i + 1])
            c = before[at]
            starts = np.nonzero(np.concatenate(([True], c[1:] != c[:-1])))[0]
            some = deep[at]
            hot = np.nonzero(some)[0]
            ends = tokens.text[at[tokens.word[at] == len(tokens.hash) - 2]]
            columns = [word[at], c[starts], np.diff(np.append(starts, len(c))), text[at], some if len(hot) else some[:0], a[at[hot]], b[at[hot]], offset[ends], ids[ends], has[ends], size[ends], known[ends], base[ends], in_bucket[rarer_at[more]], rarer[more], by[more]]
            made[0].append(i)
            made[1].append(_packed([np.asarray(x, k) for x, k in zip([*columns, *(e[at] for e in earlier)], kinds)]))
        yield pa.RecordBatch.from_arrays([pa.array(made[0], pa.int64()), pa.array([rows[0]] * len(made[0]), pa.int64()), pa.array(made[1], pa.binary())], names=["bucket", "row", "tokens"])


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers from 0 for equal keys."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.concatenate(([False], ordered[1:] != ordered[:-1]))
    out = np.empty(len(keys), np.int32)
    out[order] = np.cumsum(new)
    return out, int(new.sum()) + 1 if len(keys) else 0


def _score_bucket(table: pa.Table, model: Model) -> pa.Table:
    """Count, prune and use the subtrees of a bucket; a row for each part with its texts' scores and rare words' counts."""
    kinds = [*KINDS.values(), *[np.int32] * (model.depth - 1)]
    rows = table.column("row").to_numpy()
    firsts = rows[rows >= 0]
    parts = [_unpacked(x.as_py(), kinds) for x, row in zip(table.column("tokens"), rows) if row >= 0]
    answers = [_unpacked(x.as_py(), [np.uint64, np.float64]) for x, row in zip(table.column("tokens"), rows) if row < 0]
    joined = lambda i: np.concatenate([p[i] for p in parts])
    sizes = [len(p[0]) for p in parts]
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    text = joined(3)
    learn = (text & 1).astype(np.float32)
    # words by number: frequent ones as they are, then the rare ones of this bucket
    word = joined(0)
    number, is_rare = word.copy(), word < 0
    rare_number, n_rare = _ranked(number[is_rare])
    number[is_rare] = len(model.words) + rare_number
    n_words = len(model.words) + n_rare
    p0 = np.append(model.root(model.count), model.min_word / 2)[np.minimum(number, len(model.words))]
    deep = np.concatenate([p[4] if len(p[4]) else np.zeros(n, np.int8) for p, n in zip(parts, sizes)])
    a, b = np.zeros(len(number)), np.ones(len(number))
    a[deep > 0], b[deep > 0] = joined(5), joined(6)
    for entries, shares in answers:
        asked = _place(entries, joined(14))
        at = np.concatenate([start + p[13] for start, p in zip(bounds, parts)])
        np.add.at(a, at[asked >= 0], (np.append(shares, 0.0)[asked] * joined(15))[asked >= 0])
    # the word before, as a token of its own: a rare one's count is known here
    before, run = joined(1), joined(2)
    order, n_first = _ranked(before)
    first = np.repeat(order, run)
    count = np.bincount(first, learn, minlength=n_first).astype(np.int32)
    odd = np.repeat((_place(model.words, before) < 0) & (before != START), run)
    odd_short = np.repeat(_short(before).astype(np.int32), run)
    counts = [(text[i:j][o] >> 1, odd_short[i:j][o], count[first[i:j][o]]) for i, j, o in ((i, j, odd[i:j]) for i, j in zip(bounds, bounds[1:]))]
    del odd, odd_short
    context, n_context = first, n_first
    for d in range(1, model.depth + 1):
        if d > 1:
            context, n_context = _ranked((context.astype(np.int64) << 32) | (joined(len(KINDS) + d - 2).astype(np.int64) & 0xFFFFFFFF))
        entry, n_entry = _ranked(context.astype(np.int64) * n_words + number)
        times = np.bincount(entry, learn, minlength=n_entry)
        context_of = np.zeros(n_entry, np.int32)
        context_of[entry] = context
        total = np.bincount(context, learn, minlength=n_context)
        types = np.bincount(context_of, times > 0, minlength=n_context)
        n, t, k = times[entry], total[context], types[context]
        del entry, context_of, times
        p = a + b * p0
        # each training token's probability without its own occurrence, against its parent's
        without = np.where(t > 1, (np.maximum(n - 1 - model.discount, 0) + model.discount * (k - (n == 1)) * p) / np.maximum(t - 1, 1), p)
        gain = np.bincount(context, learn * np.log(np.maximum(without, 1e-300) / p), minlength=n_context)
        del without, p
        # hot contexts were counted as a whole; only part of their tokens is here
        keep = ((gain >= model.min_gain * np.maximum(total, 1)) & (total > 0))[context] & (deep < d)
        n, t, k, of = n[keep], t[keep], k[keep], np.nonzero(keep)[0]
        rest = model.discount * k / t
        a[of] = np.maximum(n - model.discount, 0) / t + rest * a[of]
        b[of] *= rest
    held = is_rare & (a > 0)
    score = np.where(held, 0.0, np.log10(np.where(is_rare, b, a + b * p0)))
    found = []
    for i, j, part, rare_counts in zip(bounds, bounds[1:], parts, counts):
        texts = text[i:j] >> 1
        sums = np.bincount(texts, score[i:j])
        mine, h = np.nonzero(np.bincount(texts))[0], held[i:j]
        found.append(_packed([np.asarray(x, kind) for x, kind in zip([mine, sums[mine], *rare_counts, texts[h], word[i:j][h], a[i:j][h], b[i:j][h], *part[7:13]], FOUND.values())]))
    return pa.Table.from_arrays([pa.array(firsts), pa.array(found, pa.binary())], names=["row", "found"])


TEXTS = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _texts(table: pa.Table, model: Model) -> pa.Table:
    """Each text of a part: what its buckets found, added up."""
    parts = [_unpacked(x.as_py(), list(FOUND.values())) for x in table.column("found")]
    text, score, rare_text, rare, count, held_text, held, a, b, end, id_, has, tokens, known, base = (np.concatenate([p[i] for p in parts]) for i in range(len(FOUND)))
    n = int(end.max()) + 1
    scores = np.bincount(text, score, minlength=n) + np.bincount(rare_text, np.log10(model.root(count)), minlength=n)
    bases, knowns = np.bincount(rare_text, model.base(count), minlength=n), np.bincount(rare_text, count > 0, minlength=n)
    # of a rare word with an entry the root probability that is already in, and its own instead
    order = np.argsort(rare)
    p0 = model.root(count[order][np.searchsorted(rare[order], held)]) if len(held) else a
    scores += np.bincount(held_text, np.log10(a / p0 + b), minlength=n)
    columns = [pa.array(id_, mask=has == 0), pa.array(tokens.astype(np.int64)), pa.array(known + knowns[end].astype(np.int64)), pa.array(base + bases[end]), pa.array(scores[end])]
    return pa.Table.from_arrays(columns, names=[c.split()[0] for c in TEXTS.split(", ")])


def score(documents: DataFrame, learn: Column, **options) -> DataFrame:
    """Learn from the rows of `documents` (doc_id, text) where `learn` is true, and score all: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    base_score is the add-one unigram log10 probability; score is the tree's. A null text has the end token alone. Rows that repeat, in part
    or whole, are scored each on its own, and learned from as often. With nothing to learn from, every token is unknown. Empty tables give
    none; extra columns are ignored. Options: see _broadcast_part(). To score other texts than those learned from, union both and mark them.
    """
    rows = _table(documents, learn)
    model, rarer = _broadcast_part(rows, **options)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    dealt = rows.mapInArrow(lambda b: _deal(b, shared.value), "bucket long, row long, tokens binary")
    if rarer is not None:
        asked = rows.select("text").mapInArrow(lambda b: _asked(b, shared.value), "bucket long, entry long")
        answers = asked.join(rarer, "entry").groupBy("bucket").applyInArrow(_answer, dealt.schema)
        dealt = dealt.unionByName(answers)
    if model.buckets > int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        dealt = dealt.repartition(model.buckets, "bucket")
    found = dealt.groupBy("bucket").applyInArrow(lambda t: _score_bucket(t, shared.value), "row long, found binary")
    texts = found.groupBy("row").applyInArrow(lambda t: _texts(t, shared.value), TEXTS)
    return texts.select("doc_id", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
