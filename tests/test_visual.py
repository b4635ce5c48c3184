"""Visual similarity against all pairs, in one block and in several."""

import numpy as np
from pyspark.sql import functions as F

from rulewright.operators import visual


def test_blocks_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 70))
    x = np.concatenate([base[rng.integers(0, 6, 60)] + rng.normal(scale=0.3, size=(60, 70)), np.zeros((2, 70))]).round(3)
    rows = [(i, [float(v) for v in r], float(i % 3) if i % 5 else None) for i, r in enumerate(x)] + [(100, None, 1.0), (101, [float("nan")] * 70, 1.0)]
    items = visual.prepared(spark.createDataFrame(rows, "id long, v array<double>, mrp double"), "id", visual.bits(F.col("v")), F.col("v"), "mrp")
    queries = items.where("id % 10 = 0")
    want = {}
    for q in range(0, 62, 10):
        found = []
        for i in range(62):
            if i != q:
                agree = round(1 - ((x[i] > 0) != (x[q] > 0)).sum() / 70, 9)
                a, b = x[i] - x[i].mean(), x[q] - x[q].mean()
                flat = (a @ a) * (b @ b) <= np.finfo(float).eps
                look = round(min(max(((1.0 if flat else a @ b / np.sqrt((a @ a) * (b @ b))) + 1) / 2, 0), 1), 9)
                found.append((-round(0.65 * agree + 0.35 * look, 6), -agree, -look, i))
        want[q] = [i for s, *_, i in sorted(found) if -s >= 0.55][:5]
    for block in (1000, 2):
        got = {}
        for r in visual.similar(items, queries, "id", 70, block=block).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["id"])
        assert got == {q: ids for q, ids in want.items() if ids}
    changed = {r["query_id"]: (r["id"], r["other_price"]) for r in visual.price_changes(items, queries, "id", 70, "mrp", least=0.55).collect()}
    price = {i: p for i, _, p in rows}
    expected = {}
    for q, ids in want.items():
        priced = [i for i in ids if price[i] is not None]
        if priced and price[q] is not None and price[q] != price[priced[0]]:
            expected[q] = (priced[0], price[priced[0]])
    assert changed == expected
    assert visual.similar(items.limit(0), queries.limit(0), "id", 70).count() == 0
