"""Box operators against brute force, stores by round trip."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulewright.functions import geometry
from rulewright.operators import overlaps, spatial
from rulewright.sources import stores


def test_least_cost_assignment_equals_all_permutations():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (2, 4), (4, 4), (3, 5), (5, 6)):
        for _ in range(20):
            cost = rng.integers(0, 20, (n, m)).astype(float)
            got = spatial.least_cost_assignment(cost)
            assert len(set(got.tolist())) == n
            assert cost[np.arange(n), got].sum() == min(sum(cost[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(m), n))


def test_overlaps_are_suppressed_within_a_kind(spark):
    rows = [("i", 1, "a", 0.0, 0.0, 10.0, 10.0, 0.9), ("i", 2, "a", 1.0, 0.0, 10.0, 10.0, 0.8), ("i", 3, "b", 1.0, 0.0, 10.0, 10.0, 0.7), ("j", 4, "a", 1.0, 0.0, 10.0, 10.0, 0.1)]
    regions = spark.createDataFrame(rows, "image_id string, region_id long, kind string, x double, y double, w double, h double, confidence double")
    assert {r.region_id for r in spatial.suppress_overlaps(regions).collect()} == {1, 3, 4}
    assert spatial.suppress_overlaps(regions.limit(0)).count() == 0


def iou(a, b):
    w, h = (max(0.0, min(a[k] + a[k + 2], b[k] + b[k + 2]) - max(a[k], b[k])) for k in (0, 1))
    either = a[2] * a[3] + b[2] * b[3] - w * h
    return w * h / either if either > 0 else 0.0


def test_greedy_choice_equals_one_box_after_another(spark):
    rng = np.random.default_rng(3)
    # many small boxes, some across cells, some equal, a few that cover all, and empty ones
    rows = [(int(g), i, *map(float, (rng.integers(0, 60), rng.integers(0, 60), *rng.choice([0, 4, 9, 15, 60], 2, p=[0.04, 0.4, 0.36, 0.18, 0.02]))), float(rng.integers(0, 5)) / 4) for i, g in enumerate(rng.integers(0, 3, 260))]
    rows += [(r[0], 1000 + r[1], *r[2:6], 0.5) for r in rows[:60]]
    boxes = spark.createDataFrame(rows, "image_id int, region_id long, x double, y double, w double, h double, confidence double").withColumn("kind", F.lit("k")).repartition(5)
    for threshold in (0.0, 0.35, 0.5):
        kept = []
        for r in sorted(rows, key=lambda r: (-r[6], r[1])):
            if not any(k[0] == r[0] and iou(k[2:6], r[2:6]) > threshold for k in kept):
                kept.append(r)
        assert {r["region_id"] for r in spatial.suppress_overlaps(boxes, threshold).collect()} == {r[1] for r in kept}


def test_overlapping_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(int(g), i, *map(float, rng.integers(1, 40, 4))) for i, g in enumerate(rng.integers(0, 2, 80))]
    boxes = spark.createDataFrame(rows, "g int, i int, x double, y double, w double, h double")
    want = {(a[1], b[1]): iou(a[2:], b[2:]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and iou(a[2:], b[2:]) > 0}
    for cell in (3.0, 17.0, 1000.0):
        assert {(r["a"], r["b"]): pytest.approx(r["iou"]) for r in overlaps.overlapping(boxes, ["g"], "i", cell).collect()} == want


def test_readings_are_fused(spark):
    box = (0.0, 0.0, 10.0, 10.0)
    rows = [("a", "Net 100 g", *box, 0.9, "p"), ("a", "NET 100 g", *box, 0.8, "q"), ("b", "Net 100 g", *box, 0.9, "p"), ("b", "Net 700 g", *box, 0.8, "q"), ("c", None, *box, 0.5, "p")]
    readings = spark.createDataFrame(rows, "image_id string, text string, x double, y double, w double, h double, confidence double, source string")
    got = {r.image_id: r for r in spatial.fuse_readings(readings).collect()}
    assert got["a"].state == "CORROBORATED" and got["a"].confidence == 1.0 and got["a"].n_sources == 2
    assert got["b"].state == "CONFLICTING" and got["b"].alternatives == ["Net 700 g"] and got["b"].text == "Net 100 g"
    assert got["c"].state == "SINGLE_SOURCE"


def test_duplicate_lines_and_blocks(spark):
    rows = [("i", 1, "Best Before", 0.0, 0.0, 50.0, 10.0, 0.5), ("i", 2, "best-before", 0.0, 1.0, 50.0, 10.0, 0.9), ("i", 3, "--", 0.0, 0.0, 5.0, 5.0, 1.0), ("i", 4, "far", 0.0, 500.0, 50.0, 10.0, 0.9)]
    lines = spark.createDataFrame(rows, "image_id string, line_id long, text string, x double, y double, w double, h double, confidence double")
    assert {r.line_id for r in spatial.dedupe_lines(lines).collect()} == {2, 4}
    blocks = {r.line_id: r.block for r in spatial.cluster_blocks(lines).collect()}
    assert blocks[1] == blocks[2] == 0 and blocks[4] == 1


def test_assignment_abstains(spark):
    rows = [("i", "mrp", 1, 0.9), ("i", "batch", 1, 0.8), ("i", "batch", 2, 0.5), ("i", "expiry", 3, 0.1)]
    got = {r.field: r for r in spatial.assign_one_to_one(spark.createDataFrame(rows, "image_id string, field string, value_id long, score double")).collect()}
    assert (got["mrp"].value_id, got["mrp"].status) == (1, "RESOLVED")
    assert (got["batch"].value_id, got["batch"].status) == (2, "AMBIGUOUS")
    assert (got["expiry"].value_id, got["expiry"].status) == (None, "INSUFFICIENT_EVIDENCE")


def test_homography_round_trip(spark):
    m = geometry.rotation(30, 5, -2)
    there = geometry.transform_point(m, F.lit(3.0), F.lit(4.0))
    back = geometry.transform_point(geometry.inverse(m), there["x"], there["y"])
    r = spark.range(1).select(back.alias("p")).first().p
    assert r.x == pytest.approx(3) and r.y == pytest.approx(4)


def test_json_store_keeps_corrupt_lines(spark, tmp_path):
    path = tmp_path / "cases.json"
    path.write_text(json.dumps({"case_id": "a", "n": 1}) + "\n{broken\n")
    good, bad = stores.read_json(spark, str(path), spark.createDataFrame([], "case_id string, n int").schema)
    assert [r.case_id for r in good.collect()] == ["a"] and bad.count() == 1


def test_children_are_replaced_for_their_parents_only(spark, tmp_path):
    path = str(tmp_path / "facts")
    stores.replace_children(spark.createDataFrame([(1, "a"), (2, "b")], "fact int, parent string"), path, "parent")
    stores.replace_children(spark.createDataFrame([(3, "a")], "fact int, parent string"), path, "parent")
    assert {(r.fact, r.parent) for r in spark.read.parquet(path).collect()} == {(3, "a"), (2, "b")}


def test_sequence_consistency(spark):
    labels = spark.createDataFrame([("i", "a", 0.0), ("i", "b", 100.0), ("i", "c", 200.0), ("i", "unused", 50.0), ("j", "a", 0.0)], "image_id string, field string, y double")
    rows = [("i", 1, "a", 10.0, False), ("i", 2, "a", 190.0, False), ("i", 3, "b", 400.0, False), ("i", 4, "c", 200.0, False), ("i", 5, "b", None, False), ("i", 6, "c", 0.0, True), ("i", 7, "nolabel", 0.0, False), ("j", 8, "a", 0.0, False), ("k", 9, "a", 0.0, False)]
    values = spark.createDataFrame(rows, "image_id string, value_id int, field string, y double, inline boolean")
    got = {r.value_id: r.sequence for r in spatial.sequence_consistency(labels, values).collect()}
    assert got == {1: 1.0, 2: 0.5, 3: 0.5, 4: 1.0, 5: 0.8, 6: 0.8, 7: None, 8: 0.5, 9: 0.5}
