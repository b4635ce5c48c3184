"""similar_looks over vectors of every length against a plain walk and its SQL."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from rulewright.plans import evidence


def _table(folder):
    """Vectors of 64, 32 and 70 components, copies, flat ones, ones with NaN or infinities, and entries that are none."""
    rng = np.random.default_rng(11)
    rows = []
    for n, start in ((64, 0), (32, 2000), (70, 4000)):
        base = rng.normal(size=(3, n))
        rows += [(start + 20 * i, i % 4, (base[i % 3] + rng.normal(scale=0.4, size=n)).astype("float32").tolist()) for i in range(40)]
    x = rng.normal(size=64).astype("float32").tolist()
    rows += [(10_000, 1, [float("nan"), *x[1:]]), (10_001, 2, [float("inf"), *x[1:]]), (10_002, None, x), (10_100, 3, x), (10_003, 4, [-v for v in x])]
    rows += [(11_000, 1, [0.0] * 64), (11_001, 2, [-0.5] * 64), (11_002, 2, [0.0] * 32), (11_100, 3, [float("nan")] * 64), (11_101, 3, [float("nan")] * 64)]
    rows += [(12_000, 1, [None, *x[1:]]), (12_100, 1, None), (12_200, 1, []), (None, 1, x)]
    keys, labels, vectors = zip(*rows)
    pq.write_table(pa.table({"vec_id": pa.array(keys, pa.int64()), "label": pa.array(labels, pa.int32()), "embedding": pa.array(vectors, pa.list_(pa.float32()))}), folder / "embeddings.parquet")
    return rows


def _walk(rows):
    whole = [(key, np.array(v, float)) for key, _, v in rows if key is not None and v and None not in v]
    found = set()
    for q, y in whole:
        if q % 100:
            continue
        met = []
        for key, x in whole:
            if key == q or len(x) != len(y):
                continue
            bit = lambda v: (v > 0) | np.isnan(v)
            agree, look = round(float((bit(x) == bit(y)).mean()), 9), 0.0
            if np.isfinite(x).all() and np.isfinite(y).all():
                a, b = x - x.mean(), y - y.mean()
                both = (a @ a) * (b @ b)
                look = 1.0 if both <= np.finfo(float).eps else round(float(np.clip((a @ b / np.sqrt(both) + 1) / 2, 0, 1)), 9)
            score = round(0.65 * agree + 0.35 * look, 6)
            if score >= 0.55:
                met.append((-score, -agree, -look, key))
        found |= {(q, key, rank) for rank, (*_, key) in enumerate(sorted(met)[:5], 1)}
    return found


@pytest.mark.parametrize("rows_a_batch", ["10000", "8"])
def test_vectors_of_every_length_are_searched(spark, tmp_path, rows_a_batch):
    rows = _table(tmp_path)
    columns = ["query_id", "vec_id", "label", "score", "hash_score", "histogram_score", "rank"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
    try:
        found = [tuple(r) for r in evidence.queries()["similar_looks"](spark, str(tmp_path)).select(columns).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(q, key, rank) for q, key, *_, rank in found} == _walk(rows)
    asked = {q for q, *_ in found}
    assert {2000, 4000, 10_000, 11_100} <= asked
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = db.sql(evidence.oracle_sql()["similar_looks"]).select(*columns).fetchall()
    rounded = lambda table: sorted([repr(round(float(x), 6)) if x is not None else "" for x in r] for r in table)
    assert rounded(found) == rounded(want)
