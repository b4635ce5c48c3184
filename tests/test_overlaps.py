"""Greedy choice among overlapping boxes: rows aren't joined again, and odd boxes stay."""

from rulewright.operators import overlaps

SCHEMA = "g int, r long, x double, y double, w double, h double"


def test_rows_are_not_joined_again(spark):
    rows = spark.createDataFrame([(1, i, float(i), 0.0, 5.0, 5.0) for i in range(9)], SCHEMA)
    chosen, _ = overlaps.leaders(rows, ["g"], "r", 0.5, strict=True)
    assert "Join" not in chosen._jdf.queryExecution().optimizedPlan().toString()


def test_copies_go_with_the_first_and_rows_with_nulls_stay(spark):
    rows = [(1, 1, 0.0, 0.0, 9.0, 9.0), (1, 2, 0.0, 0.0, 9.0, 9.0), (1, 3, 1.0, 0.0, 9.0, 9.0), (1, 4, None, 0.0, 9.0, 9.0), (1, 5, None, 0.0, 9.0, 9.0), (None, 6, 0.0, 0.0, 9.0, 9.0), (None, 7, 0.0, 0.0, 9.0, 9.0), (1, 8, 0.0, 0.0, 0.0, 9.0), (1, 9, 0.0, 0.0, 0.0, 9.0)]
    chosen, followers = overlaps.leaders(spark.createDataFrame(rows, SCHEMA), ["g"], "r", 0.5, strict=True)
    assert sorted(r["r"] for r in chosen.collect()) == [1, 4, 5, 6, 7, 8, 9]
    assert sorted((r["r"], r["leader"]) for r in followers.collect()) == [(2, 1), (3, 1)]
