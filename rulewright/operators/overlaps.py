"""Overlapping boxes of the same image by a grid join, and greedy choice among them in rounds.

Every box is put into the grid cells that it covers, and boxes meet in cells only; a pair counts in the one
cell that holds the upper left corner of what they share. So no image is one task's, nor are all pairs
of its boxes made. Boxes that are equal are represented by the best of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulewright.functions import geometry
from rulewright.sources.scratch import written

BOX = ("x", "y", "w", "h")


def _box(prefix: str):
    return F.struct(*(F.col(prefix + c).alias(c) for c in BOX))


def overlapping(boxes: DataFrame, groups: list[str], rank: str, cell: float) -> DataFrame:
    """Pairs of boxes (rank, x, y, w, h) of one group that share an area: group, `a` and `b` (ranks, a before b), iou. Boxes without an area share none."""
    spread = boxes.where((F.col("w") > 0) & (F.col("h") > 0))
    ends = lambda at, size: F.sequence(F.floor(F.col(at) / cell), F.floor((F.col(at) + F.col(size)) / cell))
    spread = spread.withColumn("cx", F.explode(ends("x", "w"))).withColumn("cy", F.explode(ends("y", "h")))
    # the same exchange for both sides
    spread = spread.select(*groups, "cx", "cy", rank, *BOX).repartition(*groups, "cx", "cy")
    left = spread.select(*groups, "cx", "cy", F.col(rank).alias("a"), *(F.col(c).alias(f"a_{c}") for c in BOX))
    right = spread.select(*groups, "cx", "cy", F.col(rank).alias("b"), *(F.col(c).alias(f"b_{c}") for c in BOX))
    owner = (F.floor(F.greatest("a_x", "b_x") / cell) == F.col("cx")) & (F.floor(F.greatest("a_y", "b_y") / cell) == F.col("cy"))
    met = left.join(right, [*groups, "cx", "cy"]).where((F.col("a") < F.col("b")) & owner)
    return met.select(*groups, "a", "b", geometry.iou(_box("a_"), _box("b_")).alias("iou")).where("iou > 0")


def mean_side(boxes: DataFrame) -> float:
    """A cell's size: twice the mean of boxes' sides, 1 at least, so that most boxes are in one or two cells."""
    side = boxes.agg(F.avg(F.col("w") + F.col("h"))).first()[0]
    return max(float(side or 1.0), 1.0)


def leaders(rows: DataFrame, groups: list[str], rank: str, threshold: float, strict: bool, cell: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Greedy choice in each group, by rank: a box is chosen unless one chosen before overlaps it by over `threshold` (or as much, if not strict).

    rank: a struct or value that orders boxes, unlike for any two of a group. Returns the rows chosen, and pairs
    (groups, rank, leader): whom each other row was passed over for, the first chosen box that overlaps it so. In each round the boxes that
    no undecided one before them overlaps are chosen, and those that they overlap go; rounds end when no overlap is left.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    # rows go along, so that they needn't be joined again
    box = {c: c if kinds[c] == "double" else f"_{c}" for c in BOX}
    boxes = rows.select("*", *(F.col(c).cast("double").alias(b) for c, b in box.items() if b != c))
    # equal boxes share their fate with the best of them
    equal = Window.partitionBy(*groups, *box.values()).orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    boxes = written(boxes.withColumn("_first", F.first(rank).over(equal)))
    first = boxes.where(F.col(rank) == F.col("_first")).select(*groups, *(F.col(b).alias(c) for c, b in box.items()), F.col("_first").alias("_rank"))
    close = (F.col("iou") > threshold) if strict else (F.col("iou") >= threshold)
    edges = written(overlapping(first, groups, "_rank", cell or mean_side(first)).where(close).select(*groups, "a", "b"))
    all_edges, lost = edges, None
    while not edges.isEmpty():
        tops = edges.select(*groups, "a").distinct().join(edges.select(*groups, F.col("b").alias("a")).distinct(), [*groups, "a"], "left_anti")
        gone = written(edges.join(tops, [*groups, "a"]).select(*groups, "b").distinct())
        lost = gone if lost is None else lost.unionByName(gone)
        edges = written(edges.join(gone, [*groups, "b"], "left_anti").join(gone.withColumnRenamed("b", "a"), [*groups, "a"], "left_anti"))
    if lost is None:
        lost = all_edges.select(*groups, "b")
    passed = all_edges.join(lost, [*groups, "b"]).join(lost.withColumnRenamed("b", "a"), [*groups, "a"], "left_anti").groupBy(*groups, "b").agg(F.min("a").alias("leader"))
    # every row by its representative: the leader it was passed over for, the representative itself, or none; of a row with a null
    # in its group or box there is none
    known = reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in (*groups, *box.values())))
    repeats = known & (F.col(box["w"]) > 0) & (F.col(box["h"]) > 0) & (F.col(rank) != F.col("_first"))
    whole = boxes.join(passed.withColumnRenamed("b", "_first").withColumnRenamed("leader", "_leader"), [*groups, "_first"], "left")
    whole = written(whole.select(*rows.columns, F.coalesce("_leader", F.when(repeats, F.col("_first"))).alias("_leader")))
    followers = whole.where("_leader is not null").select(*groups, rank, F.col("_leader").alias("leader"))
    return whole.where("_leader is null").select(*rows.columns), followers
