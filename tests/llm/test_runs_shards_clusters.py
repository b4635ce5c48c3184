"""Periodic runs, sharding and clustering on odd tables: nulls, ties, repeated rows, hot groups, none at all."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulewright.llm import clustering, runs, sharding
from tests.llm.test_operators import awkward, key, prose
from tests.llm.test_queries import runs as every_run


def numbers(texts):
    known = {}
    flat = np.array([known.setdefault(w, len(known)) for t in texts for w in t], np.int64)
    return flat, np.cumsum([0, *map(len, texts)])


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_every_period_tried(seed):
    r = random.Random(seed)
    for _ in range(150):
        texts = []
        for _ in range(r.randint(1, 4)):
            n, kinds = r.choice([0, 1, 2, 5, 20, 60, 120]), r.choice([1, 2, 3, 8])
            w = [r.randrange(kinds) for _ in range(n)]
            if n > 4 and r.random() < 0.4:
                a, p = r.randrange(n), r.randint(1, n // 2)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        least = r.choice([2, 4, 12])
        want = [(k, *x) for k, t in enumerate(texts) for x in every_run(t, least)]
        assert [tuple(x) for x in runs.runs_of(*numbers(texts), least).tolist()] == want


def test_runs_of_many_words():
    fibonacci = [0, 1]
    while len(fibonacci) < 3000:
        fibonacci += fibonacci[: max(1, int(len(fibonacci) * 0.618))]
    for w in (fibonacci, [0] * 5000, [0, 1] * 2500, [*range(1500), *range(1500)]):
        assert [tuple(x[1:]) for x in runs.runs_of(*numbers([w]), 12).tolist()] == every_run(w, 12)


def test_runs_of_odd_tables(spark):
    rows = awkward() + [(50, "x y " * 9 + "X y x y", 0.0, "", 0, ""), (None, "a " * 30, 0.0, "", 0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs double, n_words string, length int, lang string").repartition(3)
    want = []
    for i, t, *_ in rows:
        w = [x for x in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if x]
        found = every_run(w)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        want.append((i, len(w), [tuple(x) for x in found], " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.find_runs(docs).collect()]
    assert key(got) == key(want)
    assert runs.find_runs(docs.limit(0)).count() == 0


def placed(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(by.get(k, [])) for k in range(shards)]
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(sizes) - min(sizes) <= 1 and set(by) <= set(range(shards))


def test_shards_have_equal_counts_and_the_mixture(spark):
    # a hot source, sources of one row, null sources and ids, repeated rows
    rows = [(i, prose(i % 7, 5), "hot") for i in range(400)] + [(i, "t", f"s{i}") for i in range(400, 500)] + [(None, None, None)] * 60 + [(7, "same", "twice")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    for shards, range_rows in ((8, 20_000), (7, 1), (1000, 50)):
        got = sharding.shard_documents(docs, shards, seed=3, range_rows=range_rows).collect()
        placed(got, shards)
        assert key((r["doc_id"], r["source"]) for r in got) == key((i, s) for i, _, s in rows)
        if shards < 10:
            met = Counter((r["shard"], r["source"]) for r in got)
            assert all(abs(met[k, s] - n / shards) <= 8 for s, n in (("hot", 400), (None, 60), ("twice", 40)) for k in range(shards))
    again, other = (sharding.shard_documents(docs.where("doc_id is not null and source != 'twice'"), seed=s).collect() for s in (3, 4))
    first = sharding.shard_documents(docs.where("doc_id is not null and source != 'twice'").repartition(2), seed=3).collect()
    assert key(map(tuple, again)) == key(map(tuple, first)) != key(map(tuple, other))
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_written_shards_hold_whole_rows(spark, tmp_path):
    docs = spark.createDataFrame(awkward(), "doc_id long, text string, shard double, source string, slot int, lang string")
    sharding.write_shards(docs, f"{tmp_path}/s", 3)
    got = spark.read.parquet(f"{tmp_path}/s")
    placed([r.asDict() for r in got.collect()], 3)
    assert key((r["doc_id"], r["text"], r["lang"]) for r in got.collect()) == key((x[0], x[1], x[5]) for x in awkward())


def naive_clusters(points, ids, k, rounds):
    import hashlib

    order = sorted(range(len(ids)), key=lambda i: (hashlib.sha256(f"1:{'' if ids[i] is None else ids[i]}".encode()).hexdigest(), points[i].tolist()))[:k]
    centroids = points[order].astype(np.int64)
    for turn in range(rounds + 1):
        distance = ((points[:, None, :] - centroids[None]) ** 2).sum(axis=2)
        to = distance.argmin(axis=1)
        for c in range(len(centroids)) if turn < rounds else ():
            if (to == c).any():
                centroids[c] = [int(x) // int((to == c).sum()) for x in points[to == c].sum(axis=0)]
    return to, distance.min(axis=1), centroids


@pytest.mark.parametrize("block, leaf", [(8192, 32), (50, 3)])
def test_clusters_equal_every_distance(spark, monkeypatch, block, leaf):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(rng.normal(size=8) * 3, 0.2, (40, 8)) for _ in range(6)] + [np.tile(rng.normal(size=8), (120, 1)), np.zeros((3, 8)), rng.normal(size=(2, 8)) * 50]).astype(np.float32)
    ids = [i if i % 50 else None for i in range(len(x) - 5)] + [3, 3, 3, 4, 4]
    rows = [(i, [float(v) for v in p], 1) for i, p in zip(ids, x)]
    bad = [(900, None, 1), (901, [], 1), (902, [1.0] * 7, 1), (903, [1.0] * 7 + [None], 1), (904, [float("nan")] * 8, 1), (905, [float("inf")] + [0.0] * 7, 1)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, cluster int").repartition(3)
    grown = clustering.trees
    monkeypatch.setattr(clustering, "trees", lambda v, d: grown(v, d, block, leaf))
    points = np.floor(x.astype(float) * 64).astype(np.int64)
    for k in (16, 1):
        to, distance, centroids = naive_clusters(points, ids, k, 3)
        found, last = clustering.cluster(table, k, 3, 8)
        assert last.tolist() == centroids.tolist()
        assert key((r["vec_id"], r["cluster"], r["distance"]) for r in found.collect()) == key((i, int(c), int(d)) for i, c, d in zip(ids, to, distance))


def test_clusters_of_few_rows_and_none(spark):
    few = spark.createDataFrame([(1, [0.5] * 64), (2, [-0.5] * 64), (1, [0.5] * 64)], "vec_id long, embedding array<double>")
    found = clustering.with_inertia(*clustering.cluster(few)).collect()
    assert sorted((r["vec_id"], r["distance"], r["inertia"]) for r in found) == [(1, 0, 0), (1, 0, 0), (2, 0, 0)]
    none = clustering.with_inertia(*clustering.cluster(few.limit(0)))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="might not fit a long"):
        clustering.cluster(few.withColumn("embedding", F.transform("embedding", lambda v: v * 1e9)))
