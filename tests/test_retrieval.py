"""Hybrid retrieval with whole benchmark items as queries, against brute force."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rulewright.operators import retrieval
from rulewright.plans import catalog
from rulewright.sources.scratch import scratch

WORDS = [f"word{i}" for i in range(60)]


def tables():
    r = random.Random(7)
    text = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    docs = [(i, "common " + text(r.randint(3, 40))) for i in range(50)] + [(50, None), (51, ""), (52, "lateterm only here")]
    items = [(0, "absent " * 12 + "lateterm " + text(5)), (1, text(20)), (4, text(20)), (100, text(25) + " common"), (200, text(40)), (300, None)]
    return docs, items


def brute(docs, queries, k=10):
    words = lambda t: re.findall(r"[\w()/-]+", (t or "").lower())
    index = {i: Counter(w) for i, t in docs if (w := words(t))}
    n, df = len(index), Counter(x for c in index.values() for x in c)
    avg = sum(sum(c.values()) for c in index.values()) / n
    idf = {t: math.log((1 + n) / (1 + f)) + 1 for t, f in df.items()}
    out = {}
    for q, t in queries:
        asked = Counter(x for x in words(t) if x in df)
        q_norm = math.sqrt(sum((f * idf[x]) ** 2 for x, f in asked.items()))
        found = []
        for i, c in index.items():
            if common := [x for x in asked if x in c]:
                bm = sum(asked[x] * math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * c[x] * 2.5 / (c[x] + 1.5 * (0.25 + 0.75 * sum(c.values()) / avg)) for x in common)
                dot = sum(c[x] * asked[x] * idf[x] ** 2 for x in common)
                found.append((i, bm, dot / q_norm / math.sqrt(sum((f * idf[x]) ** 2 for x, f in c.items()))))
        if found:
            top, near = max(x[1] for x in found), max(x[2] for x in found)
            ranked = sorted(((-round(0.55 * b / top + 0.45 * c / near, 6), i) for i, b, c in found))[:k]
            out[q] = [(i, -s) for s, i in ranked]
    return out


def ranks(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for q, rows in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in rows]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in rows], abs=2e-6)


def test_hybrid_topk_whole_asks_every_hundredth_item_with_its_whole_text(spark, tmp_path):
    docs, items = tables()
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = ranks(catalog.queries()["hybrid_topk_whole"](spark, str(tmp_path)).collect())
    same(got, brute(docs, [x for x in items if x[0] % 100 == 0]))
    assert set(got) == {0, 100, 200} and 52 in [i for i, _ in got[0]]


def test_terms_too_many_to_broadcast(spark):
    docs, items = tables()
    chunks, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "query_id long, query string")
    same(ranks(retrieval.search(chunks, "doc_id", F.col("text"), asked, most=0).collect()), brute(docs, items))


def test_a_stored_index_answers_again(spark, tmp_path):
    docs, items = tables()
    chunks, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "query_id long, query string")
    retrieval.build(chunks, "doc_id", F.col("text"), f"{tmp_path}/index")
    index = retrieval.load(spark, f"{tmp_path}/index", "doc_id")
    for few in (items, items[:2]):
        same(ranks(retrieval.search_index(index, asked.where(F.col("query_id").isin([i for i, _ in few]))).collect()), brute(docs, few))
    # one scan of postings a search, filtered by term
    plan = retrieval.search_index(index, asked)
    assert plan.count() and index.postings.count() == sum(len(set(re.findall(r"[\w()/-]+", (t or "").lower()))) for _, t in docs)
    assert retrieval.search_index(index, asked.where("query_id = 300")).count() == 0


def test_a_named_rule_is_found_alone_and_half_a_point_up(spark):
    rules = [(1, "net quantity of the package", "R6(1)"), (2, "quantity and price of it", "R6(1)"), (3, "rule 6 (1) quantity quantity", "R7"), (4, "nothing of it", None)]
    chunks = spark.createDataFrame(rules, "chunk_id long, text string, rule_id string")
    asked = spark.createDataFrame([(1, "what does Rule 6 (1) say of quantity"), (2, "quantity by rule 99"), (3, "price and quantity")], "query_id long, query string")
    may = chunks.select("chunk_id", "rule_id").crossJoin(asked.select("query_id")).where("not (query_id = 3 and chunk_id = 2)")
    index = retrieval.build(chunks, "chunk_id", F.col("text"), scratch(spark, "index"))
    got = retrieval.search_index(index, asked, eligible=may).collect()
    found = {q: {r["chunk_id"]: r["score"] for r in got if r["query_id"] == q} for q in (1, 2, 3)}
    # scaled by the best of all that are eligible, of the rule or not
    assert set(found[1]) == {1, 2} and all(0.5 < s < 1.5 for s in found[1].values())
    assert set(found[2]) == {1, 2, 3} and max(found[2].values()) <= 1
    assert 2 not in found[3] and 1 in found[3]
