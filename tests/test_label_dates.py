"""Date tokens, labels, and the assignment of dates to labels."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulewright.functions.date_tokens import date_tokens
from rulewright.functions.text import spans
from rulewright.operators import label_dates
from rulewright.plans import labels as plans

TOKENS = [
    ("TOLL FREE: 1800-10-22-221", []),
    ("CALL 05/26 PKD 05/26", ["2026-05", "2026-05"]),
    ("2.80/g", []),
    ("= 12.05/kg", []),
    ("MRP 10.00", []),
    ("MFG 10.00 05.26", ["2026-05"]),
    ("PKD: 13/05/26", ["2026-05-13"]),
    ("13-05-2026 and 12.11.99", ["2026-05-13", "1999-11-12"]),
    ("12 OCT 2026", ["2026-10-12"]),
    ("sept 26 x", ["2026-09"]),
    ("MAY2027", ["2027-05"]),
    ("2024/10/22", ["2024-10-22"]),
    ("05/2026", ["2026-05"]),
    ("BEST BEFORE 12 MONTHS FROM PKD 05/26", ["12 months from pkd", "2026-05"]),
    ("45/13/2026", [None]),
    ("09-24/ml", []),
    (None, []),
    ("", []),
    ("05/26 05/26", ["2026-05", "2026-05"]),
]


def test_date_tokens(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TOKENS)], "i int, t string").withColumn("d", date_tokens(F.col("t"))).orderBy("i").collect()
    assert [[x["value"] for x in r["d"]] for r in rows] == [v for _, v in TOKENS]
    assert all(r["t"][x["start"] : x["stop"]].strip() == x["text"] for r in rows for x in r["d"])


def test_date_tokens_keep_compiled_patterns_and_take_a_date_apart_once(spark):
    lines = spark.createDataFrame([("🙂 é 12 days on 3-4-2026\n1/99",)], "t string").select(date_tokens(F.col("t")).alias("d"))
    assert [(x["start"], x["stop"], x["value"], x["is_duration"]) for x in lines.first()["d"]] == [(4, 11, "12 days", True), (15, 23, "2026-04-03", False)]
    plan = spark.range(1).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("t")).select(date_tokens(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all(" in plan and "regexp_extract(" not in plan and plan.count("split(") == plan.count(", /, -1)")


def every_assignment(affinity, labels, dates):
    """All one-to-one assignments with their scores, best first, by the rules in words: pairs under 0.2 are none."""
    m, n = affinity.shape
    out = []
    for choice in itertools.product([*range(n), None], repeat=m):
        used = [d for d in choice if d is not None]
        if not used or len(set(used)) < len(used) or any(d is not None and affinity[k, d] < 0.2 for k, d in enumerate(choice)):
            continue
        score = sum(affinity[k, d] for k, d in enumerate(choice) if d is not None)
        for a, b in itertools.combinations([k for k in range(m) if choice[k] is not None], 2):
            (lax, lay), (lbx, lby), (dax, day), (dbx, dby) = labels[a], labels[b], dates[choice[a]], dates[choice[b]]
            for apart, moved, far, slack, good, bad in ((lby - lay, dby - day, 15, 15, 0.35, 0.85), (lbx - lax, dbx - dax, 30, 20, 0.25, 0.65)):
                if abs(apart) > far:
                    score += good if (moved > -slack if apart > 0 else moved < slack) else -bad
            differ = math.hypot((dax - lax) - (dbx - lbx), (day - lay) - (dby - lby))
            score += 0.2 if differ < 80 else 0.1 if differ < 160 else 0
            score -= 0.45 if (day - lay) * (dby - lby) < -300 else 0
        out.append((score, [-1 if d is None else d for d in choice]))
    return sorted(out, key=lambda x: -x[0])


def test_branch_and_bound_equals_all_assignments():
    r = random.Random(6)
    for _ in range(250):
        m, n = r.randint(1, 5 if r.random() < 0.2 else 3), r.randint(1, 6 if r.random() < 0.2 else 4)
        labels, dates = (np.array([(r.randrange(0, 400), r.randrange(0, 300)) for _ in range(k)], float) for k in (m, n))
        affinity = np.round(np.array([[r.random() for _ in range(n)] for _ in range(m)]), 2)
        choice, score, rival = label_dates.best_assignment(affinity, labels, dates)
        every = every_assignment(affinity, labels, dates)
        if not every:
            assert choice == [-1] * m and score == -np.inf
            continue
        assert math.isclose(score, every[0][0], abs_tol=1e-9)
        assert any(c == choice and math.isclose(s, score, abs_tol=1e-9) for s, c in every)
        assert math.isclose(rival, every[1][0], abs_tol=1e-9) if len(every) > 1 else rival == -np.inf


def lines(spark, rows):
    rows = [(*r[:3], *(None if x is None else float(x) for x in r[3:])) for r in rows]
    return spark.createDataFrame(rows, "image_id int, line_id int, text string, x double, y double, w double, h double, confidence double")


def verdicts(frame):
    return {(r["image_id"], r["field"]): (r["normalized_value"], r["status"], r["reason"]) for r in frame.collect()}


def test_layouts(spark):
    got = verdicts(
        label_dates.associate(
            lines(
                spark,
                [
                    # beside each other
                    (1, 1, "PKD", 10, 10, 40, 20, 0.9), (1, 2, "05/26", 60, 10, 60, 20, 0.9), (1, 3, "USE BY", 10, 60, 60, 20, 0.9), (1, 4, "04/27", 80, 60, 60, 20, 0.9),
                    # in one line
                    (2, 1, "MFG DATE: 13/05/26 EXP 12/05/27", 0, 0, 400, 20, 0.95),
                    # made after expiry: not swapped
                    (3, 1, "PKD 05/27", 0, 0, 100, 20, 0.9), (3, 2, "EXP 05/26", 0, 50, 100, 20, 0.9),
                    # a label without a date, and a maker's line
                    (4, 1, "BEST BEFORE", 0, 0, 100, 20, 0.8), (4, 2, "MFD. BY: ACME LTD", 0, 40, 100, 20, 0.8),
                    # two dates as near to one label
                    (5, 1, "EXP", 100, 100, 40, 20, 0.9), (5, 2, "01/26", 150, 100, 60, 20, 0.9), (5, 3, "02/26", 150, 118, 60, 20, 0.9),
                    (6, 1, None, 0, 0, 1, 1, None), (6, 2, "05/26", 0, 0, 10, 10, 0.9),
                ],
            )
        )
    )
    assert got[1, "mfg_date"] == ("2026-05", "DETECTED", None) and got[1, "expiry_date"] == ("2027-04", "DETECTED", None)
    assert got[2, "mfg_date"][:2] == ("2026-05-13", "DETECTED") and got[2, "expiry_date"][:2] == ("2027-05-12", "DETECTED")
    assert got[3, "mfg_date"] == ("2027-05", "REVIEW_REQUIRED", "made after expiry") and got[3, "expiry_date"][0] == "2026-05"
    assert got[4, "expiry_date"] == (None, "REVIEW_REQUIRED", "no date") and (4, "mfg_date") not in got
    assert got[5, "expiry_date"][1:] == ("REVIEW_REQUIRED", "ambiguous")
    assert not any(i == 6 for i, _ in got)
    assert label_dates.associate(lines(spark, [])).count() == 0


def test_repeated_readings_of_a_date_are_one(spark):
    got = verdicts(label_dates.associate(lines(spark, [(1, 1, "EXP", 0, 0, 40, 20, 0.9), (1, 2, "05/26", 50, 0, 60, 20, 0.9), (1, 3, "05/28", 52, 1, 60, 20, 0.6), (1, 4, "05/26", 50, 15, 60, 20, 0.5)])))
    assert got == {(1, "expiry_date"): ("2026-05", "DETECTED", None)}


@pytest.mark.parametrize("seed", range(3))
def test_affinity_falls_with_a_label_between(spark, seed):
    box = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(40.0).alias("w"), F.lit(10.0).alias("h"), F.lit(1.0).alias("confidence"))
    y = 60 + seed * 10
    none, one = (F.array(*(box(0, k) for k in ks)) for ks in ((500,), (y // 2,)))
    r = spark.range(1).select(label_dates.affinity(box(0, 0), box(0, y), none).alias("a"), label_dates.affinity(box(0, 0), box(0, y), one).alias("b")).first()
    assert r["a"] > 0.5 and abs(r["b"] - r["a"] / 4) < 1e-4


def test_lines_read_once_keep_equal_dates(spark):
    rows = lines(spark, [(1, 1, "EXP", 0, 0, 40, 10, 0.9), (1, 2, "05/26", 60, 30, 60, 10, 0.9), (1, 3, "05/26", 60, 52, 60, 10, 0.8)])
    assert [len(label_dates.candidates(rows, repeated=r).first()["dates"]) for r in (True, False)] == [1, 2]


def test_sums_in_another_order_are_equal():
    # 0.3 and 0.1 + 0.2 differ in their last bit: the first date counts
    assert label_dates.best_assignment(np.array([[0.3, 0.1 + 0.2]]), np.zeros((1, 2)), np.zeros((2, 2))) == ([0], 0.3, 0.3)


@pytest.mark.parametrize(("m", "n"), [(1, 0), (1, 1), (1, 5), (2, 0), (2, 1), (2, 2), (2, 4), (2, 7)])
def test_many_images_at_once_get_the_assignments_that_each_gets(m, n):
    r = np.random.default_rng(m * 10 + n)
    affinity, labels, dates = np.round(r.random((200, m, n)), 2), r.integers(0, 300, (200, m, 2)).astype(float), r.integers(0, 300, (200, n, 2)).astype(float)
    affinity[r.random(affinity.shape) < 0.1] = np.nan
    choice, score, rival = label_dates.best_assignments(affinity, labels, dates)
    each = [label_dates.best_assignment(*one) for one in zip(affinity, labels, dates)]
    assert choice.tolist() == [e[0] for e in each] and score.tolist() == [e[1] for e in each] and rival.tolist() == [e[2] for e in each]


def test_a_column_of_images_of_every_size(spark):
    r = random.Random(9)
    rows = []
    for i in range(300):
        m, n = r.randint(0, 3), r.randint(0, 4)
        rows.append((i, [round(r.random(), 2) if r.random() < 0.9 else None for _ in range(m * n)], *([float(r.randrange(300)) for _ in range(2 * k)] for k in (m, n)), m, n))
    found = spark.createDataFrame(rows, "i int, a array<double>, l array<double>, d array<double>, m int, n int").repartition(3).select("*", label_dates.matched(F.col("a"), F.col("l"), F.col("d")).alias("r")).collect()
    assert len(found) == 300
    for x in found:
        choice, score, rival = label_dates.best_assignment(np.array(x["a"], float).reshape(x["m"], x["n"]), np.array(x["l"]).reshape(-1, 2), np.array(x["d"]).reshape(-1, 2))
        assert (x["r"]["choice"], x["r"]["score"], x["r"]["next"]) == (choice, score if np.isfinite(score) else None, rival if np.isfinite(rival) else None)


def test_assignments_are_made_once_and_lines_read_once(spark):
    plan = label_dates.associate(lines(spark, [(1, 1, "EXP", 0, 0, 40, 10, 0.9)]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Join" not in plan
    assert not any("RLIKE" in x for x in plan.splitlines() if x.lstrip(" :+-").startswith("Filter"))


def test_affinities_make_an_image_s_arrays_once(spark):
    plan = plans.queries()["label_date_affinity"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    # explode() would have filters ask for the size of what it takes apart, and make it for that
    assert not any("lambdafunction" in x for x in plan if x.lstrip(" :+-").startswith("Filter"))


def test_a_match_of_the_whole_text_is_found_by_one_scan(spark):
    texts = ["12", "12 3", " 12", "x", "", None, "🙂1", "4\n5"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(spans(F.col("t"), r"\d+").alias("s")).collect()
    assert [None if r["s"] is None else [tuple(x) for x in r["s"]] for r in got] == [[("12", 0, 2)], [("12", 0, 2), ("3", 3, 4)], [("12", 1, 3)], [], [], None, [("1", 1, 2)], [("4", 0, 1), ("5", 2, 3)]]


def test_a_maker_s_line_leaves_the_next_pattern(spark):
    rows = [(1, 1, "MFD DATE by ACME, PKD 05/26", 0, 0, 300, 10, 0.9), (1, 2, "EXP", 0, 20, 40, 10, 0.9), (2, 1, "mfg at Goa", 0, 0, 99, 10, 0.9), (3, 1, "no label 05/26", 0, 0, 99, 10, 0.9)]
    line = F.struct("line_id", "text", "x", "y", "w", "h", "confidence")
    got = lines(spark, rows).select("image_id", line.alias("line")).select("image_id", F.transform(label_dates.line_labels(F.col("line")), lambda x: F.concat_ws("@", x["kind"], x["text"])).alias("k")).collect()
    assert [(r["image_id"], r["k"]) for r in got] == [(1, ["MFG_DATE@MFD DATE"]), (1, ["EXP@EXP"]), (2, []), (3, [])]
