"""Each corpus operator against brute force on a small, awkward table."""

import hashlib
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from rulewright.llm import chat_format, components, decontaminate, edit_counts, language_id, packing, quality_classifier, quality_rules, simhash, suffix_tree, tokens, toxicity
from rulewright.llm.queries import sample_edits, tokenizer_path

SCHEMA = "doc_id long, text string, score double, sequence_id string, n_words int, lang string"


def prose(seed, n, stem=""):
    r = random.Random(seed)
    return " ".join(stem + "".join(r.choice(["ba", "ti", "ron", "ées", "ul", "ma"]) for _ in range(r.randint(1, 3))) for _ in range(n)).capitalize() + "."


def awkward():
    base = prose(1, 120)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "One"), (5, base), (6, base), (7, base.replace("ron", "ROn", 1) + " extra"), (5, base), (None, base), (None, None)]
    rows += [(8, prose(2, 6000)), (9, "a  b\n\nc   d " * 30), (10, "x" * 5000), (11, "###" * 60 + " $$$ word " * 80)]
    rows += [(i, prose(i, 20 + i)) for i in range(20, 40)]
    return [(i, t, 0.5, "clash", 7, "en") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def as_words(text):
    return [w for w in re.split("[\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) if w]


def key(rows):
    return sorted(rows, key=repr)


def test_tokens_equal_the_library(spark):
    t = tokens.SegmentTokenizer(tokenizer_path())
    r, alphabet = random.Random(5), list(" a b  .,'s\n\t\x1c\x85\xa0 　é1٣中🙂") + ["'ll", "<|endoftext|>", "word", "End.\nNext"]
    for _ in range(3000):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 25)))
        assert np.frombuffer(t.ids(text), "<u4").tolist() == t.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_words_of_some_parts_ago_are_not_encoded_again():
    t, letters = tokens.SegmentTokenizer(tokenizer_path()), "abcdefghijklmnopqrstuvwxyz"
    word = lambda n: "x" + "".join(letters[n // 26**k % 26] for k in range(4))
    texts = [" ".join(map(word, range(a, a + 152_000))) for a in (0, 152_000, 304_000)]
    made, encode = [], t._words
    t._words = lambda words: made.append(len(words)) or encode(words)
    ids = [t.ids(x) for x in [*texts, texts[0]]]
    assert ids[3] == ids[0] and made[-1] == 0
    some = " ".join(texts[0].split(" ")[:500])
    assert np.frombuffer(t.ids(some), "<u4").tolist() == t.tokenizer.encode(some, add_special_tokens=False).ids


def test_remembered_words_take_little_memory():
    t, letters = tokens.SegmentTokenizer(tokenizer_path()), "abcdefghijklmnopqrstuvwxyz"
    texts = [" ".join("x" + "".join(letters[n // 26**k % 26] for k in range(4)) for n in range(a, a + 20_000)) for a in (0, 20_000, 40_000)]
    t.ids(texts[0])
    tracemalloc.start()
    try:
        arrow = pa.total_allocated_bytes()
        for text in texts[1:]:
            t.ids(text)
        assert (tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow) / 40_000 < 60
    finally:
        tracemalloc.stop()


def test_remembered_words_keep_their_ids(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 300)
    monkeypatch.setattr(tokens, "FEW", 10, raising=False)
    t, r = tokens.SegmentTokenizer(tokenizer_path()), random.Random(8)
    some = ["".join(r.choices("abcdefgé1,.\n", k=r.randint(1, 7))) for _ in range(900)] + ["long" * 12]
    for k in range(60):
        text = " ".join(r.choices(some[k * 10 :], k=r.choice([3, 200])))
        assert np.frombuffer(t.ids(text), "<u4").tolist() == t.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_cut_lengths():
    for n in range(1, 9000, 7):
        cut = packing.cut_lengths(n, 2048)
        assert sum(cut) == n and max(cut) <= 2048 and min(cut) > 0


def test_packing(spark, docs, none):
    t = tokens.SegmentTokenizer(tokenizer_path())
    got = [tuple(r) for r in packing.pack_documents(docs, tokenizer_path(), 256).collect()]
    whole = Counter()
    for i, text, *_ in awkward():
        whole[i, len(t.ids(text)) // 4 + 1] += 1
    pieces = Counter()
    for doc, start, length, crc, n, *_ in got:
        pieces[doc, n] += length
    assert pieces == Counter({k: v * k[1] for k, v in whole.items()})
    ids = {i: t.ids(x) + np.array([1], "<u4").tobytes() for i, x, *_ in awkward() if i is not None}
    assert all(zlib.crc32(ids[d][4 * s : 4 * (s + n)]) == c for d, s, n, c, *_ in got if d is not None)
    at = {}
    for *_, n_, sequence, offset in [(r[2], r[5], r[6]) for r in got]:
        at.setdefault(sequence, []).append((offset, n_))
    for pieces in at.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 256
    assert sum(sum(x for _, x in p) for p in at.values()) / (256 * len(at)) > 0.95
    assert packing.pack_documents(none, tokenizer_path()).count() == 0
    unique = docs.where("doc_id >= 8").select("doc_id", "text")
    plan = packing.pack_documents(unique, tokenizer_path(), 256)
    made = {r["sequence_id"]: r["ids"] for r in packing.materialise(unique, plan, tokenizer_path()).collect()}
    for r in plan.collect():
        part = np.array(made[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]], "<u4").tobytes()
        assert zlib.crc32(part) == r["ids_crc32"]


def brute_fingerprint(text):
    w = as_words(text)
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    ids = list(range(len(prints)))
    for i in ids:
        for j in ids[:i]:
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                a, b = ids[i], ids[j]
                ids = [min(a, b) if x in (a, b) else x for x in ids]
    return ids


@pytest.mark.parametrize("tile_rows", [2, 4096])
def test_simhash(spark, docs, none, tile_rows):
    got = simhash.near_duplicates(docs, tile_rows=tile_rows).collect()
    rows = [(i, brute_fingerprint(t)) for i, t, *_ in awkward()]
    label = brute_components([f for _, f in rows])
    first = {}
    for (i, _), c in zip(rows, label):
        if i is not None:
            first[c] = min(first.get(c, i), i)
    assert key((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got) == key((i, f, first.get(c)) for (i, f), c in zip(rows, label))
    assert simhash.near_duplicates(none).count() == 0


def test_links_of_random_fingerprints_and_crowded_groups(spark):
    r = random.Random(3)
    values = [r.getrandbits(64) for _ in range(150)]
    values += [v ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for v in values[:60]]
    values = sorted(set(values))
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    label = brute_components(values)
    want = {(values[i], values[label[i]]) for i in range(len(values))}
    for tile_rows in (2, 1000):
        edges = simhash.link_edges(spark.createDataFrame(signed, "fp long"), tile_rows=tile_rows)
        root = {x["node"] % 2**64: x["root"] % 2**64 for x in components.connected_components(edges).collect()}
        groups = {}
        for v in values:
            groups.setdefault(root.get(v, v), set()).add(v)
        mine = {}
        for v, c in want:
            mine.setdefault(c, set()).add(v)
        assert key(map(sorted, groups.values())) == key(map(sorted, mine.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.range(60).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).union(spark.createDataFrame([(100, 100), (None, 3), (200, 201)], "u long, v long"))
    root = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    assert root == {**{i: 0 for i in range(61)}, 200: 200, 201: 200}


def test_keep_first(spark, docs):
    kept = sorted(r["doc_id"] for r in simhash.keep_first(docs.where("doc_id is not null")).collect())
    groups = simhash.near_duplicates(docs.where("doc_id is not null")).collect()
    assert kept == sorted({r["component_id"] for r in groups})
    assert simhash.keep_first(docs).columns == docs.columns


def brute_suffix_tree(rows, depth, gain=0.02, discount=0.75):
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of rows (doc_id, text, learn), context by context."""
    end, start = object(), object()
    texts = [(i, learn, [*as_words(t), end]) for i, t, learn in rows]
    count = Counter(w for _, learn, t in texts if learn for w in t)
    n, v, once, twice = sum(count.values()), len(count), sum(x == 1 for x in count.values()), sum(x == 2 for x in count.values())
    cut = once / (once + 2 * twice) if once and twice else 0.5
    context = lambda t, j, d: tuple(t[j - k] if j >= k else start for k in range(1, d + 1))
    follow, kept = defaultdict(Counter), {}
    for _, learn, t in texts:
        for j, w in enumerate(t if learn else []):
            for d in range(1, depth + 1):
                follow[context(t, j, d)][w] += 1

    def p(c, w):
        if not c:
            return (count[w] - cut) / n if count[w] else cut * v / n if n else 1.0
        if not kept.get(c):
            return p(c[:-1], w)
        total = sum(follow[c].values())
        return max(follow[c][w] - discount, 0) / total + discount * len(follow[c]) / total * p(c[:-1], w)

    for c in sorted(follow, key=len):
        total, won = sum(follow[c].values()), 0.0
        for w, k in follow[c].items():
            parent = p(c[:-1], w)
            without = (max(k - 1 - discount, 0) + discount * (len(follow[c]) - (k == 1)) * parent) / (total - 1) if total > 1 else parent
            won += k * math.log(max(without, 1e-300) / parent)
        kept[c] = won >= gain * total
    return [(i, len(t), sum(count[w] > 0 for w in t), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), sum(math.log10(p(context(t, j, depth), w)) for j, w in enumerate(t))) for i, _, t in texts]


def same_scores(got, want, score=True):
    got, want = (sorted(x, key=lambda r: (repr(r[0]), r[1], r[4], r[5])) for x in (map(tuple, got), want))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert all(abs(a[4] - b[4]) < 1e-6 * (1 - b[4]) and (not score or abs(a[5] - b[5]) < 1e-5 * (1 - b[5])) for a, b in zip(got, want))


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_suffix_tree(spark, docs, none, depth):
    r = random.Random(3)
    vocabulary = [f"W{int(r.paretovariate(0.7))}" for _ in range(400)]
    rows = [(i, t, i is None or i % 3 > 0) for i, t, *_ in awkward() if i not in (8, 9)] + [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60))), i % 3 > 0) for i in range(100, 160)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, learn boolean").repartition(3)
    want = brute_suffix_tree(rows, depth)
    same_scores(suffix_tree.score(frame, F.col("learn"), depth=depth, hot_share=1.0).collect(), want)
    # many buckets, and hot contexts, which are always retained, so scores differ a little
    hot = suffix_tree.score(frame, F.col("learn"), depth=depth, capacity=100, min_joint=0.0).collect()
    same_scores(hot, want, score=False)
    assert abs(sum(x["score"] for x in hot) / sum(x[5] for x in want) - 1) < 0.05


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_suffix_tree_finds_entries_that_are_not_broadcast(spark, depth):
    r = random.Random(3)
    vocabulary = [f"w{int(r.paretovariate(0.7))}" for _ in range(400)]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60))), i % 3 > 0) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, learn boolean").repartition(3)
    scores = lambda least: [r["score"] for r in suffix_tree.score(frame, F.col("learn"), depth=depth, capacity=100, min_joint=least).orderBy("doc_id").collect()]
    want = scores(0.0)
    for least in (0.003, 1.0):
        assert scores(least) == pytest.approx(want, rel=1e-6)


def test_suffix_tree_without_training(spark, docs, none):
    got = suffix_tree.score(docs, F.lit(False)).collect()
    assert len(got) == len(awkward()) and {(x["n_known"], x["train_tokens"], x["score"]) for x in got} == {(0, 0, 0.0)}
    assert suffix_tree.score(none, F.lit(True)).count() == 0


def test_suffix_tree_learns_contexts(spark):
    r = random.Random(2)
    texts = [(i, " ".join(x for _ in range(40) for x in (("left", "shoe") if r.random() < 0.5 else ("right", "glove")))) for i in range(60)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    for row in suffix_tree.score(frame, F.col("doc_id") < 50).where("doc_id >= 50").collect():
        assert row["score"] > 0.7 * row["base_score"]


def brute_hits(docs, items, window):
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) if w]
    out = []
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for item, text in items:
            x = split(text)
            size = min(window, len(x))
            for a in range(len(x) - size + 1 if x else 0):
                for b in range(len(w) - size + 1):
                    if w[b : b + size] == x[a : a + size]:
                        hit |= set(range(b, b + size))
                        found.add(str(item))
        out.append((i, len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block_words", [2_000_000, 20])
def test_decontamination(spark, docs, none, block_words):
    long = prose(1, 120)
    items = [(1, " ".join(long.split()[30:55])), (2, prose(30, 14)), (3, "one"), (4, "c D"), (5, None), (6, ""), (7, "zz yy xx"), (8, " ".join(prose(2, 6000).split()[4000:4030])), (8, "c d a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_matches(docs, bench, block_words=block_words).collect()
    want = brute_hits([(i, t) for i, t, *_ in awkward()], items, 10)
    assert key((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), list(r["items"])) for r in got) == key(want)
    assert max(r["longest"] for r in got if r["doc_id"] == 8) == 30
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    dirty = {w[0] for w in want if w[2]}
    assert key(r["doc_id"] for r in clean.collect()) == key(w[0] for w in want if w[0] not in dirty)
    assert decontaminate.find_matches(docs, bench.where("item_id > 99")).where("size(spans) > 0").count() == 0
    assert decontaminate.find_matches(none, bench).count() == 0


def search(texts, items, window=10):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    known = [(i, w) for i, t in items if (w := decontaminate.alnum_words(t))]
    return [r for b in decontaminate._search([batch], known, window) for r in b.to_pylist()]


def test_longest_matches_equal_brute_force():
    r, split = random.Random(4), decontaminate.alnum_words
    for trial in range(80):
        letters, window = "abc" if trial % 2 else "abcdefgh", r.choice([2, 3, 5])
        items = [(str(i), " ".join(r.choice(letters) for _ in range(r.randint(0, 12)))) for i in range(5)]
        texts = [" ".join(r.choice(letters + "z") for _ in range(r.randint(0, 30))) for _ in range(6)] + [None]
        for row, text in zip(search(texts, items, window), texts):
            w, best = split(text), 0
            for _, t in items:
                x = split(t)
                size = min(window, len(x))
                for a in range(len(x) - size + 1 if x else 0):
                    for b in range(len(w) - size + 1):
                        n = 0
                        while a + n < len(x) and b + n < len(w) and x[a + n] == w[b + n]:
                            n += 1
                        best = max(best, n if n >= size else 0)
            assert row["longest"] == best
            assert (0, sum(s["end"] - s["start"] for s in row["spans"]), row["items"]) == (0, *brute_hits([(0, text)], items, window)[0][2:])


def test_repeated_words_cost_no_more_than_their_length():
    began = time.time()
    (row,) = search(["a " * 20_000], [("i", "a " * 3000)])
    assert time.time() - began < 10 and row["longest"] == 3000 and row["spans"] == [{"start": 0, "end": 20_000}]


def test_quality_statistics(spark, docs, none):
    got = quality_rules.judge(docs).collect()
    want = []
    for i, t, *_ in awkward():
        t = t or ""
        w = [x for x in re.split("[\x20\x09-\x0D]+", t) if x]
        grams, covered = Counter(zip(w, w[1:], w[2:])), set()
        for k in range(len(w) - 2):
            if grams[tuple(w[k : k + 3])] > 1:
                covered |= {k, k + 1, k + 2}
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 2 * len(covered) > len(w)))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert key(tuple(r[c] for c in names) for r in got) == key(want)
    verdict = {r["doc_id"]: r["kept"] for r in got if r["doc_id"] is not None}
    assert verdict[5] and verdict[35] and not verdict[11] and not verdict[1]
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and key(r["doc_id"] for r in kept.collect()) == key(r["doc_id"] for r in got if r["kept"])
    assert quality_rules.judge(none).count() == 0


def two_class_em(patterns, rounds=3000):
    """Expectation-maximisation over a list of single documents' votes, by numpy, from the same start."""
    votes = np.array([v for v, n in patterns for _ in range(n)])
    share, found, alarm = 0.1, np.full(votes.shape[1], 0.7), np.full(votes.shape[1], 0.05)
    for _ in range(rounds):
        odds = share / (1 - share) * np.where(votes < 0, found / alarm, np.where(votes > 0, (1 - found) / (1 - alarm), 1)).prod(axis=1)
        p = odds / (1 + odds)
        share = (p.sum() + 0.2) / (len(p) + 2)
        bad, cast = votes < 0, votes != 0
        found = ((p[:, None] * bad).sum(axis=0) + 1.4) / ((p[:, None] * cast).sum(axis=0) + 2)
        alarm = (((1 - p)[:, None] * bad).sum(axis=0) + 0.1) / (((1 - p)[:, None] * cast).sum(axis=0) + 2)
    return share, found, alarm


def test_expectation_maximisation_equals_one_over_single_documents():
    patterns = [((1, 1, 1), 900), ((-1, -1, -1), 40), ((-1, -1, 1), 20), ((1, 1, -1), 25), ((0, -1, -1), 9), ((0, 0, 1), 60), ((-1, 0, 0), 5)]
    found = quality_rules.estimate(patterns, 3)
    share, hits, alarms = two_class_em(patterns)
    assert np.allclose([found.share, *found.found, *found.alarm], [share, *hits, *alarms], atol=1e-6)


def test_votes_are_weighed_by_what_the_data_say_of_them():
    # the third rule's bad votes come alone mostly: one is outvoted, and two others' outweigh its good vote
    patterns = [((1, 1, 1), 9000), ((-1, -1, -1), 300), ((-1, -1, 1), 200), ((1, 1, -1), 400)]
    found = quality_rules.estimate(patterns, 3)
    assert found.posterior((1, 1, -1)) < 0.1 and found.posterior((-1, -1, 1)) > 0.9
    # the same vote among other data has another verdict: a tenth of votes changed
    other = quality_rules.estimate([((1, 1, 1), 9000), ((-1, -1, -1), 300), ((-1, 0, -1), 300), ((0, 1, -1), 300), ((0, 0, -1), 20)], 3)
    assert other.posterior((0, 0, -1)) > 0.9 > found.posterior((0, 0, -1))
    # nothing to learn from: where estimation starts
    assert quality_rules.estimate([], 3) == quality_rules.Estimate(0.1, [0.7] * 3, [0.05] * 3)


def test_votes_on_one_defect_say_nothing_of_another(spark):
    # symbols for words, among texts that else are repetitive: found though every other rule votes good
    plain = [(i, prose(i, 120)) for i in range(300)]
    repeats = [(1000 + i, " ".join(prose(i, 12).split() * 9)) for i in range(30)]
    marks = [(2000 + i, " ".join(w if k % 2 else "#%$" for k, w in enumerate(prose(i, 120).split()))) for i in range(12)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(plain + repeats + marks, "doc_id long, text string")).collect()}
    assert all(got[i] for i, _ in plain) and not any(got[i] for i, _ in repeats + marks)


def test_posterior_column_equals_python(spark):
    found = quality_rules.estimate([((1, 0, -1), 40), ((1, 1, 1), 400), ((0, -1, -1), 30)], 3)
    votes = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    rows = spark.createDataFrame(votes, "a int, b int, c int").withColumn("p", quality_rules._defect(["a", "b", "c"], found)).collect()
    assert all(abs(r["p"] - found.posterior((r["a"], r["b"], r["c"]))) < 1e-12 for r in rows)


def test_edit_counts(spark, docs, none):
    t = tokens.SegmentTokenizer(tokenizer_path(), special_as_text=True)
    count = lambda x: len(t.tokenizer.encode(x, add_special_tokens=False).ids)
    got = edit_counts.apply_edits(sample_edits(docs), tokenizer_path()).collect()
    want = []
    for i, text, *_ in awkward():
        text = text or ""
        note = f" [edited {'-' if i is None else i}]"
        new = text
        a, b = len(text) // 3, len(text) // 2
        new = new[:a] + note + new[a + 17 :]
        b = min(b, len(new))
        new = new[:b] + "so it  goes\non, " + new[b:]
        want.append((i, count(text), count(new), len(new), 2))
    assert key(tuple(r)[:5] for r in got) == key(want)
    assert all(sum(r["leaf_tokens"]) == r["n_tokens_after"] for r in got)
    assert next(r["reencoded_chars"] for r in got if r["doc_id"] == 8) < 4000
    assert edit_counts.apply_edits(sample_edits(none), tokenizer_path()).count() == 0


def test_many_random_edits_equal_encoding_anew():
    t, r = tokens.SegmentTokenizer(tokenizer_path(), special_as_text=True), random.Random(9)
    for seed in range(6):
        tree = edit_counts.Tree(prose(seed, r.choice([0, 5, 400])), t)
        for _ in range(60):
            tree.edit(r.randint(0, len(tree.text) + 3), r.choice([0, 1, 5, 300]), r.choice(["", " ", "  ", "x", "\n", " two words ", prose(seed, 50), "<|endoftext|>"]))
            assert tree.total == len(t.tokenizer.encode(tree.text, add_special_tokens=False).ids)


def labelled(spark, good, bad, n=60):
    rows = [(i, good(i), 1, 0) if i % 2 else (i, bad(i), 0, 1) for i in range(n)] + [(n + 1, None, 1, 0), (n + 2, "", 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")


def test_toxicity(spark, docs, none):
    def insulting(i):
        w = prose(i, 80).split()
        w[10 + i % 5], w[40 + i % 7] = "nastyword", "Vileness!"
        return " ".join(w)

    frame = labelled(spark, lambda i: prose(i, 80), insulting, 200)
    model = toxicity.train(frame.where("doc_id < 160"), frame.select("doc_id", "toxic"))
    got = toxicity.score(frame.where("doc_id between 160 and 199").join(frame.select("doc_id", F.col("toxic").alias("y")), "doc_id"), model)
    y = {r["doc_id"]: r["toxic"] for r in frame.collect()}
    assert all((r["score"] >= 0.3) == (y[r["doc_id"]] == 1) for r in got.collect())
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == len(awkward()) and all(0 <= r["score"] <= 1 for r in odd)
    kept = toxicity.keep_ordinary(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(awkward())
    assert toxicity.score(none, model).count() == 0
    blank = toxicity.train(none, none.select("doc_id", F.lit(1).alias("toxic")))
    assert toxicity.score(docs, blank).count() == len(awkward())


def naive_kneser_ney(texts):
    """Log ratio of each pair's probability, toxic to ordinary, of (words, toxic) texts: dictionaries and the text's formulas."""
    triples = [{t for w, y in texts if y == k for t in zip([b"", *w], w, w[1:])} for k in (0, 1)]
    pairs = [Counter((v, w) for _, v, w in t) for t in triples]
    words = [Counter(w for _, w in p) for p in pairs]
    both = Counter(w for _, w in set(pairs[0]) | set(pairs[1]))
    names = {w for p in pairs for vw in p for w in vw}
    once = (sum(n == 1 for n in both.values()) + 1) / (len(names) + 1)
    left = {w: min(n, 1) * once for w, n in both.items()}
    shared = lambda w: (both[w] - left.get(w, 0) + sum(left.values()) / (len(names) + 1)) / sum(both.values())

    def taken(counts):
        keys = sorted(set(counts[0]) | set(counts[1]))
        cut = toxicity.discounts(np.array([[c[k] for k in keys] for c in counts], float))
        return [dict(zip(keys, row)) for row in cut]

    cut_w, cut_p = taken(words), taken(pairs)

    def word(k, w):
        return (words[k][w] - cut_w[k].get(w, 0) + sum(cut_w[k].values()) * shared(w)) / sum(words[k].values())

    def pair(k, v, w):
        total = sum(n for (a, _), n in pairs[k].items() if a == v)
        if not total:
            return word(k, w)
        mass = max(sum(n for (a, _), n in cut_p[k].items() if a == v), 1e-6) / total
        return (pairs[k][v, w] - cut_p[k].get((v, w), 0)) / total + mass * word(k, w)

    assert all(abs(sum(word(k, w) for w in [*names, b"?"]) - 1) < 1e-9 for k in (0, 1))
    return word, pair


def test_toxicity_probabilities_equal_brute_force(spark):
    r = random.Random(8)
    texts = [(i, " ".join(r.choice(["ja", "ne", "da", "vil" if i % 2 else "mir", f"w{r.randint(0, 30)}"]) for _ in range(25)), i % 2) for i in range(50)]
    frame = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    model = toxicity.train(frame, frame.select("doc_id", "toxic"))
    used = {x["doc_id"] for x in frame.where(F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(4)) > 0).collect()}
    word, pair = naive_kneser_ney([(decontaminate.alnum_words(t), y) for i, t, y in texts if i in used])
    said = "Ja vil ne unknown da mir vil vil w3"
    alone, after, _ = model.ratios(pa.array([said]))
    w = decontaminate.alnum_words(said)
    assert np.allclose(alone, [math.log(word(1, x) / word(0, x)) for x in w], atol=1e-5)
    assert np.allclose(after[1:], [math.log(pair(1, v, x) / pair(0, v, x)) for v, x in zip(w, w[1:])], atol=1e-5)


def test_a_toxic_phrase_of_ordinary_words_raises_the_score(spark):
    phrase = "maron tibaul"  # both words are common in all texts, but together in toxic ones only
    rows = []
    for i in range(240):
        w = prose(i, 60).split() + ["maron", "ti", "tibaul", "ba"]
        random.Random(i).shuffle(w)
        w = [x for k, x in enumerate(w) if (x, w[k - 1]) != ("tibaul", "maron")]
        rows.append((i, " ".join([*w[:20], phrase, *w[20:40], phrase, *w[40:]] if i % 2 else w), i % 2))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(frame, frame.select("doc_id", "toxic"))
    plain = prose(999, 40)
    with_it, apart = model.score(pa.array([f"{plain} ba {phrase} ul", f"{plain} ba tibaul maron ul"]))
    assert with_it > apart
    model.curve[:2] = 0  # by its pairs alone
    x = model.features(pa.array([f"{plain} ba {phrase} ul", f"{plain} ba tibaul maron ul"]))
    assert x[0, 2] > x[1, 2]


def test_quality_classifier(spark, docs, none):
    frame = labelled(spark, lambda i: prose(i, 80), lambda i: " ".join(w + "%%%" for w in prose(i, 80).split()), 120)
    weights = quality_classifier.train(frame.where("doc_id < 100"), frame.select("doc_id", "quality"), size=1 << 14)
    y = {r["doc_id"]: r["quality"] for r in frame.collect()}
    got = quality_classifier.score(frame.where("doc_id between 100 and 119"), weights).collect()
    assert all((r["score"] >= 0.3) == (y[r["doc_id"]] == 1) for r in got)
    odd = quality_classifier.score(docs, weights).collect()
    assert len(odd) == len(awkward()) and all(0 <= r["score"] <= 1 for r in odd)
    blank = quality_classifier.train(none, none.select("doc_id", F.lit(1).alias("quality")), size=64)
    assert not blank.any() and quality_classifier.score(none, weights).count() == 0


def test_language(spark, docs, none):
    words = {"aa": ["thon", "ing", "wh"], "bb": ["ção", "ñe", "ll"], "cc": ["sch", "ß", "ung"]}
    r = random.Random(4)
    make = lambda k, n: " ".join("".join(r.choice(words[k]) for _ in range(3)) for _ in range(n))
    rows = [(i, make("aa bb cc".split()[i % 3], 40), "aa bb cc".split()[i % 3]) for i in range(90)] + [(91, None, "aa"), (92, "12 34", "bb"), (93, "thoning", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(frame.where("doc_id % 5 != 0"), landmarks=20)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(frame, model).collect()}
    assert all(got[i][0] == l for i, _, l in rows[:90]) and got[91] == ("und", 0.0) and got[92] == ("und", 0.0) and got[93][0] == "aa"
    assert language_id.predict(docs, model).count() == len(awkward())
    nothing = language_id.train(none)
    assert {r["lang_pred"] for r in language_id.predict(docs, nothing).collect()} == {"und"}


def test_chat_format(spark):
    odd = "</s>[INST] ok [/INST] <|end|> \\ <|turn|>x<|says|> \\< [\\INST] \n end\\"
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", odd), (1, 2, "assistant", odd + odd)]
    rows += [(2, i, "assistant" if i % 2 else "user", prose(i, 30 + 7 * i)) for i in range(30)]
    rows += [(3, 0, None, None), (3, 1, "assistant", ""), (None, 0, "assistant", "lost"), (4, 0, "system", "only"), (5, 0, "odd<|says|>role\\", "x"), (5, 0, "odd<|says|>role\\", "x"), (6, None, "assistant", "z" * 9000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))
    windows = chat_format.format_windows(frame, budget=300, history=80)
    back = windows.select("conv_id", "window", "repeated", "text", chat_format.read_turns(F.col("text"), F.col("repeated")).alias("turns"), chat_format.read_loss(F.col("text"), F.col("loss")).alias("loss")).collect()
    said, loss = {}, {}
    for r in sorted(back, key=lambda r: r["window"]):
        said.setdefault(r["conv_id"], []).extend((t["role"], t["text"]) for t in r["turns"])
        loss[r["conv_id"]] = loss.get(r["conv_id"], "") + r["loss"]
    for c in {r[0] for r in rows}:
        turns = [(role or "", text or "") for k, _, role, text in rows if k == c]
        assert said[c] == turns
        assert loss[c] == "".join(t for role, t in turns if role == "assistant")
    token = re.compile(r" ?[^\W\d_]+| ?\d+| ?[^\s\w]+|\s+")
    for r in back:
        if r["conv_id"] == 2 and len(r["turns"]) > 1:
            assert sum(len(token.findall(t["text"])) + chat_format.TURN_TOKENS for t in r["turns"]) <= 300
    assert any(r["repeated"] for r in back if r["conv_id"] == 2)
    assert chat_format.format_windows(frame.where("false")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    base = [prose(i, 150) for i in range(40)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(base)] + [(50, base[0], "en", "s", 1), (51, base[1].replace("ron", "run", 1), "en", "s", 1), (52, "too short", "en", "s", 1), (53, None, "en", "s", 1), (54, " ".join(f"{w}%%%" for w in base[2].split()), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, " ".join(base[5].split()[20:40]))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    left = {r["doc_id"] for r in corpus_pipeline.run(spark, folder).select("doc_id").distinct().collect()}
    assert left == set(range(40)) - {5}
    assert hashlib.sha256(b"").hexdigest()
