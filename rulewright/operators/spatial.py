"""Operators over the boxes of an image: duplicates, fused readings, blocks, parents and one-to-one assignment.

Boxes that overlap meet by a grid join, and greedy choices among them are made in rounds (operators/overlaps.py). Blocks of
lines and assignments depend on all choices made before, and run in pandas, one group of rows per image; an
image has few boxes, whatever the number of images.
Boxes are columns x, y, w, h.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.functions import geometry
from rulewright.operators import overlaps
from rulewright.sources.scratch import written


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """With `rank`: the most confident first, then by `order`."""
    return rows.withColumn("rank", F.struct((-F.col("confidence").cast("double")).alias("a"), *order))


def suppress_overlaps(regions: DataFrame, threshold: float = 0.5, image: str = "image_id", kind: str = "kind", order: str = "region_id") -> DataFrame:
    """Greedy non-maximum suppression within an image's regions of one kind: most confident first, `order`, unlike for any two regions, breaking ties."""
    return overlaps.leaders(_ranked(regions, [order]), [image, kind], "rank", threshold, strict=True)[0].select(regions.columns)


def dedupe_lines(lines: DataFrame, threshold: float = 0.35, image: str = "image_id", order: str = "line_id") -> DataFrame:
    """Of lines of an image with the same letters and digits and overlapping boxes, the most confident. Lines without any are dropped."""
    plain = lines.withColumn("_plain", F.regexp_replace(F.lower("text"), r"(?U)\W+", "")).where("_plain != ''")
    return overlaps.leaders(_ranked(plain, [order]), [image, "_plain"], "rank", threshold, strict=False)[0].select(lines.columns)


BONUS = 1.12


def fuse_readings(readings: DataFrame, threshold: float = 0.40, agree: float = 0.86, image: str = "image_id") -> DataFrame:
    """One row per place of an image, from readings (text, x, y, w, h, confidence, source).

    Readings whose box overlaps that of the most confident one there form a group. A reading agrees with
    the group's best if their digit runs are the same and their letters and digits similar. Any
    that doesn't makes the place CONFLICTING, with the others as alternatives; else two sources or
    more make it CORROBORATED, its confidence times 1.12, at most 1; else it is SINGLE_SOURCE.
    Null texts count as empty; a reading that repeats another in all columns counts once more.
    """
    read = readings.select(image, F.coalesce("text", F.lit("")).alias("text"), *(F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h", "confidence")), F.col("source").cast("string").alias("source"))
    # a number for a rank, so that texts aren't dealt with every box
    order = [F.col(image), -F.col("confidence"), F.col("source"), F.col("text"), F.col("n")]
    read = read.withColumn("n", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    read = written(read.drop("n").withColumn("rank", F.monotonically_increasing_id()))
    best, followers = overlaps.leaders(read, [image], "rank", threshold, strict=False)
    plain = lambda t: F.regexp_replace(F.lower(t), "[^a-z0-9]", "")
    digits = lambda t: F.regexp_extract_all(t, F.lit(r"\d+"), F.lit(0))
    first = best.select(image, F.col("rank").alias("leader"), F.col("text").alias("best"))
    others = followers.join(read.select(image, "rank", "text", "source"), [image, "rank"]).join(first, [image, "leader"])
    longest = F.greatest(F.length(plain("text")), F.length(plain("best")))
    alike = (longest == 0) | (1 - F.levenshtein(plain("text"), plain("best")) / F.greatest(longest, F.lit(1)) >= agree)
    agrees = (digits("text") == digits("best")) & alike
    rivals = F.array_sort(F.collect_set(F.when(~agrees, F.struct(F.col("rank"), "text"))))
    of = others.groupBy(image, F.col("leader").alias("rank")).agg(rivals.alias("rivals"), F.collect_set(F.when(agrees, F.col("source"))).alias("sources"))
    met = best.join(of, [image, "rank"], "left").withColumn("alternatives", F.array_distinct(F.transform(F.coalesce("rivals", F.array()), lambda r: r["text"])))
    n = F.size(F.array_union(F.array("source"), F.coalesce("sources", F.array().cast("array<string>"))))
    state = F.when(F.size("alternatives") > 0, "CONFLICTING").when(n > 1, "CORROBORATED").otherwise("SINGLE_SOURCE")
    met = met.withColumns({"state": state, "n_sources": n})
    sure = F.when(F.col("state") == "CORROBORATED", F.least(F.lit(1.0), F.col("confidence") * BONUS)).otherwise(F.col("confidence"))
    return met.select(image, "text", "x", "y", "w", "h", sure.alias("confidence"), "state", "n_sources", "alternatives")


def cluster_blocks(lines: DataFrame, image: str = "image_id", order: str = "line_id") -> DataFrame:
    """Lines with `block`: from the top, a line joins the first block that has a line near it, up to 3.2 line heights away and overlapping or near it sideways."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(middle=rows["y"] + rows["h"] / 2).sort_values(["middle", "x", order], kind="stable")
        blocks: list[list] = []
        block = []
        for r in rows.itertuples():

            def near(o, r=r):
                gap = max(r.x, o.x) - min(r.x + r.w, o.x + o.w)
                return abs(r.middle - o.middle) <= 3.2 * max(r.h, o.h) and (gap < 0 or gap < 1.5 * max(r.w, o.w))

            home = next((k for k, members in enumerate(blocks) if any(map(near, members))), len(blocks))
            if home == len(blocks):
                blocks.append([])
            blocks[home].append(r)
            block.append(home)
        return rows.drop(columns="middle").assign(block=np.array(block, np.int32))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema) + ", block int"
    return lines.groupBy(image).applyInPandas(one, schema)


def hulls(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The box around each group's boxes."""
    ends = lines.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("x2"), F.max(F.col("y") + F.col("h")).alias("y2"), F.count("*").alias("n"))
    return ends.select(*keys, "x", "y", (F.col("x2") - F.col("x")).alias("w"), (F.col("y2") - F.col("y")).alias("h"), "n")


def smallest_parent(regions: DataFrame, threshold: float = 0.85, image: str = "image_id", key: str = "region_id") -> DataFrame:
    """Each region with `parent`: the smallest larger region of its image that holds at least `threshold` of it, the lesser key winning ties; null if none."""
    box = lambda prefix: F.struct(*(F.col(prefix + c).alias(c) for c in ("x", "y", "w", "h")))
    outer = regions.select(image, *(F.col(c).alias(f"o_{c}") for c in (key, "x", "y", "w", "h")))
    met = regions.join(outer, image).where((geometry.area(box("o_")) > geometry.area(box(""))) & (geometry.containment(box(""), box("o_")) >= threshold))
    best = met.groupBy(image, key).agg(F.min_by(f"o_{key}", F.struct(geometry.area(box("o_")), F.col(f"o_{key}"))).alias("parent"))
    return regions.join(best, [image, key], "left")


def least_cost_assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a one-to-one assignment of least total cost; `cost` has at least as many columns as rows. Shortest augmenting paths."""
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for start in range(n):
        shortest, through, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, last, col = start, 0.0, -1
        while True:
            reach = last + cost[row] - row_price[row] - col_price
            better = ~done & (reach < shortest)
            shortest[better], through[better] = reach[better], row
            col = int(np.where(done, np.inf, shortest).argmin())
            last, done[col] = shortest[col], True
            if row_of[col] < 0:
                break
            row = int(row_of[col])
        settled = np.nonzero(done)[0]
        for c in settled:
            if row_of[c] >= 0:
                row_price[row_of[c]] += last - shortest[c]
            col_price[c] -= last - shortest[c]
        row_price[start] += last
        while True:
            row = int(through[col])
            at = np.nonzero(row_of == row)[0]
            row_of[col] = row
            if row == start:
                break
            # `at` has the column the row had before and the one it was just given
            col = int(at[at != col][0])
    out = np.full(n, -1)
    out[row_of[row_of >= 0]] = np.nonzero(row_of >= 0)[0]
    return out


def sequence_consistency(labels: DataFrame, candidates: DataFrame, image: str = "image_id", slack: float = 50.0) -> DataFrame:
    """candidates (field, y, inline) with `sequence`: of an image's other labels, the share that a value lies on the same side of as its own label does.

    Labels (field, y; one a field) count if their field has candidates, from the top, equal heights by field. A value above
    a later label, or up to `slack` below it, is in order, and so the other way. Inline values and those without a
    place have 0.8; all have 0.5 where fewer than two labels count, and null where the field's own label is missing.
    """
    used = labels.join(candidates.select(image, "field").distinct(), [image, "field"], "left_semi")
    order = used.groupBy(image).agg(F.array_sort(F.collect_list(F.struct(F.col("y").cast("double").alias("y"), "field"))).alias("_order"))
    met = candidates.join(order, image, "left")
    rank, y, n = F.array_position(F.transform("_order", lambda x: x["field"]), F.col("field")), F.col("y").cast("double"), F.coalesce(F.size("_order"), F.lit(0))
    marked = F.transform("_order", lambda x, i: ((rank < i + 1) & (y <= x["y"] + slack)) | ((rank > i + 1) & (y >= x["y"] - slack)))
    share = F.size(F.filter(marked, lambda hit: hit)) / F.greatest(n - 1, F.lit(1))
    score = F.when(F.col("_order").isNull() | (n < 2), 0.5).when(rank == 0, F.lit(None)).when(F.coalesce("inline", F.lit(False)) | y.isNull(), 0.8).otherwise(share)
    return met.withColumn("sequence", score).drop("_order")


ASSIGNED = "field string, value_id long, score double, margin double, status string"


def assign_one_to_one(candidates: DataFrame, threshold: float = 0.35, margin: float = 0.05, sure: float = 0.70, pad: float = 2.0, image: str = "image_id") -> DataFrame:
    """Give an image's fields distinct values so that the sum of scores is greatest, from candidates (field, value_id, score 0 to 1).

    A field whose value scores below `threshold`, or that gets none, is INSUFFICIENT_EVIDENCE without a
    value; one less than `margin` ahead of its best other candidate and below `sure` is AMBIGUOUS; others are RESOLVED.
    A repeated candidate counts with its best score.
    """
    best = candidates.groupBy(image, "field", "value_id").agg(F.max("score").cast("double").alias("score")).select(image, F.col("field").cast("string").alias("field"), F.col("value_id").cast("long").alias("value_id"), "score")

    def one(key, rows: pd.DataFrame) -> pd.DataFrame:
        table = rows.pivot(index="field", columns="value_id", values="score").sort_index().sort_index(axis=1)
        scores = table.to_numpy()
        wide = max(scores.shape)
        cost = np.full((len(scores), wide), pad)
        cost[:, : scores.shape[1]] = np.where(np.isnan(scores), pad, 1 - scores)
        out = []
        for i, j in enumerate(least_cost_assignment(cost)):
            score = scores[i, j] if j < scores.shape[1] else np.nan
            others = np.delete(scores[i], j) if j < scores.shape[1] else scores[i]
            rest = others[~np.isnan(others)]
            if np.isnan(score) or score < threshold:
                out.append((key[0], table.index[i], None, None, None, "INSUFFICIENT_EVIDENCE"))
                continue
            ahead = score - rest.max() if len(rest) else 1.0
            out.append((key[0], table.index[i], table.columns[j], score, ahead, "AMBIGUOUS" if ahead < margin and score < sure else "RESOLVED"))
        found = pd.DataFrame(out, columns=[image, *(c.split()[0] for c in ASSIGNED.split(", "))])
        return found.assign(value_id=found["value_id"].astype("Int64"))

    return best.groupBy(image).applyInPandas(one, f"{image} {candidates.schema[image].dataType.simpleString()}, {ASSIGNED}")
