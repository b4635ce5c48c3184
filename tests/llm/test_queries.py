"""Every registered query of the corpus operators over the smallest tables, against brute force by its contract."""

import hashlib
import math
import os
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from rulewright.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(x):
    return zlib.crc32(str(x).encode())


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"select doc_id, text, lang, source from '{FOLDER}/documents.parquet' order by doc_id").fetchall()


@pytest.fixture(scope="module")
def got(spark):
    known = {}

    def run(name):
        if name not in known:
            known[name] = [r.asDict() for r in queries.queries()[name](spark, FOLDER).collect()]
        return known[name]

    return run


def key(rows):
    return sorted(map(repr, rows))


def picked(rows, *names):
    return key(tuple(r[n] for n in names) for r in rows)


def test_op1(got, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x, *_ in documents}
    pieces, sequences = {}, {}
    for r in got("op1_packing"):
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, own in ids.items():
        assert sum(n for _, n in pieces[i]) == len(own) and all(a + n == b for (a, n), (b, _) in zip(sorted(pieces[i]), sorted(pieces[i])[1:]))
    for own in sequences.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 2048


def test_op2(got, documents):
    prints = {}
    for i, t, *_ in documents:
        w = SPACE.findall(lower(t))
        grams = [" ".join(w[k : k + 4]) for k in range(max(len(w) - 3, 1))] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert picked(got("op2_simhash"), "doc_id", "fingerprint", "component_id") == key((i, f"{prints[i]:016x}", find(i)) for i in ids)


def test_op3(got, documents):
    words = {i: [*SPACE.findall(lower(t)), "\n"] for i, t, *_ in documents}
    counts = Counter(w for i, ws in words.items() if crc(i) % 7 != 2 for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    by = {r["doc_id"]: r for r in got("op3_suffix_tree")}
    assert set(by) == set(words)
    for i, ws in words.items():
        r = by[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(i) % 7 == 2, len(ws), sum(w in counts for w in ws), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in ws), rel=1e-9)
    # the tree is a better model of texts that it wasn't fitted on
    assert sum(r["score"] for r in by.values() if r["held_out"]) > sum(r["base_score"] for r in by.values() if r["held_out"])


def test_op4(got, documents):
    items = duckdb.sql(f"select item_id, text from '{FOLDER}/benchmark.parquet'").fetchall()
    split = {i: ALNUM.findall(lower(t)) for i, t in items}
    windows = {}
    for i, w in split.items():
        for k in range(max(len(w) - 9, 1) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    sizes = {len(x) for x in windows}
    want = []
    for i, t, *_ in documents:
        w = ALNUM.findall(lower(t))
        hit, of = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    of |= found
                    hit |= set(range(k, k + n))
        want.append((i, len(w), len(hit), len(of), sha(",".join(sorted(of))), bool(hit)))
    assert picked(got("op4_decontamination"), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == key(want)


def test_op5(got, documents):
    want = []
    for i, t, *_ in documents:
        w, t = SPACE.findall(t or ""), t or ""
        grams, inside = Counter(zip(w, w[1:], w[2:])), set()
        for k, g in enumerate(zip(w, w[1:], w[2:])):
            inside |= {k, k + 1, k + 2} if grams[g] > 1 else set()
        lines = [x for x in t.split("\n") if SPACE.search(x)]
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w)))
    rows = got("op5_quality_rules")
    assert picked(rows, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == key(want)
    assert not any(r["kept"] and r["base_failed"] for r in rows) and any(r["kept"] for r in rows)


def test_op6(got, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    t.encode_special_tokens = True
    rows = {r["doc_id"]: r for r in got("op6_edit_counts")}
    for i, x, *_ in documents:
        x = x or ""
        a, b = len(x) // 3, len(x) // 2
        x = x[:a] + f" [edited {i}]" + x[a + 17 :]
        x = x[:b] + "so it  goes\non, " + x[b:]
        assert next(v for k, v in rows[i].items() if k in ("tokens_after", "n_tokens_after", "tokens")) == len(t.encode(x, add_special_tokens=False).ids)


@pytest.mark.parametrize("name, modulus, left", [("op7_toxicity", 4, 2), ("op8_quality_classifier", 5, 0)])
def test_scores(got, documents, name, modulus, left):
    rows = got(name)
    assert key(r["doc_id"] for r in rows) == key(i for i, *_ in documents)
    assert all(r["held_out"] == (crc(r["doc_id"]) % modulus == left) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_op9(got):
    turns = duckdb.sql(f"select conv_id, turn, role, coalesce(text, '') from '{FOLDER}/conversations.parquet' order by conv_id, turn").fetchall()
    turns += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    by = {}
    for c, _, role, text in turns:
        by.setdefault(c, []).append((role, text))
    said = {c: "".join(x for role, x in ts if role == "assistant") for c, ts in by.items()}
    want = [(c, len(ts), sha("".join(f"{a}\n{b}\n" for a, b in ts)), len(said[c]), sha(said[c])) for c, ts in by.items()]
    assert picked(got("op9_chat_format"), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == key(want)


def test_op10(got, documents):
    rows, known = {r["doc_id"]: r for r in got("op10_language_id")}, {x for *_, x, _ in documents} - {None}
    assert set(rows) == {i for i, *_ in documents}
    for i, t, *_ in documents:
        r = rows[i]
        assert r["held_out"] == (crc(i) % 3 == 1) and 0 <= r["score"] <= 1
        assert r["lang_pred"] == "und" if not any(c.isalpha() for c in t or "") else r["lang_pred"] in known
    held = [(rows[i]["lang_pred"], x) for i, t, x, _ in documents if rows[i]["held_out"] and x and len(SPACE.findall(t or "")) >= 20]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)


def runs(w, least=12):
    """Runs (start, length, period) by trying every period."""
    number, found = {}, {}
    a = np.array([number.setdefault(x, len(number)) for x in w])
    for q in range(1, len(w) // 2 + 1):
        same = np.concatenate(([False], a[:-q] == a[q:], [False]))
        edges = np.nonzero(same[1:] != same[:-1])[0]
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if e - s + q >= max(least, 2 * q):
                found.setdefault((s, e - s + q), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def test_op11(got, documents):
    want = []
    for i, t, *_ in documents:
        w, h = SPACE.findall(t or ""), crc(i)
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        found = runs(w)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        best = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None, None, None)
        want.append((i, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    assert sum(x[1] > 0 for x in want) > 5
    assert picked(got("op11_periodic_runs"), "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256") == key(want)


def test_op12(got, documents):
    rows = got("op12_sharding")
    assert picked(rows, "doc_id", "size", "text_crc32", "law", "grown_shard") == key((i, len((t or "").encode()) + 1, crc(t or ""), "rows", None) for i, t, *_ in documents)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    # every shard has its share of every source, but for rows at its ends
    sizes, met = Counter(s for *_, s in documents), Counter((r["shard"], r["source"]) for r in rows)
    assert all(abs(met[k, s] - n / 8) < 2 for k in range(8) for s, n in sizes.items())


def test_op13(got):
    rows = duckdb.sql(f"select vec_id, embedding from '{FOLDER}/embeddings.parquet'").fetchall()
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    points = np.array([v for _, v in kept])
    centroids = [list(kept[k][1]) for k in sorted(range(len(kept)), key=lambda k: sha(f"1:{kept[k][0]}"))[:16]]
    for turn in range(4):
        distance = np.stack([((points - np.array(c)) ** 2).sum(axis=1) for c in centroids], axis=1)
        to = distance.argmin(axis=1)
        if turn < 3:
            centroids = [[int(x) // int((to == c).sum()) for x in points[to == c].sum(axis=0)] if (to == c).any() else v for c, v in enumerate(centroids)]
    best = distance.min(axis=1)
    want = [(i, int(c), int(x), int(best[to == c].sum()), int(best.sum()), sha(",".join(map(str, centroids[c])))) for (i, _), c, x in zip(kept, to, best)]
    assert picked(got("op13_centroid_clustering"), "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256") == key(want)


def test_sql(got):
    db = duckdb.connect()
    for f in os.listdir(FOLDER):
        db.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{FOLDER}/{f}'")
    for name, sql in queries.oracle_sql().items():
        found = db.sql(sql)
        assert sorted(found.columns) == sorted(got(name)[0])
        assert key(tuple(r) for r in found.fetchall()) == picked(got(name), *found.columns)
