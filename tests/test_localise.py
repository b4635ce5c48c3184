"""Scores and choices of boxes against a plain walk over all candidates."""

import math
import random
import re

from rulewright.operators import localise

TEXTS = ["MRP Rs. 50", "Rs 50.00", "50", "Net Qty 1,000 g", "1000 g", "Best before", "", None, "net qty", "batch B12"]


def score(e, c):
    (_, _, field, text, *box, w, h), (_, _, shown, *other) = e, c
    x, y = (max(0.0, min(box[k] + box[k + 2], other[k] + other[k + 2]) - max(box[k], other[k])) for k in (0, 1))
    union = box[2] * box[3] + other[2] * other[3] - x * y
    far = min(1.0, math.hypot(box[0] + box[2] / 2 - other[0] - other[2] / 2, box[1] + box[3] / 2 - other[1] - other[3] / 2) / math.hypot(w, h))
    sizes = sorted((max(1.0, box[2] * box[3]), max(1.0, other[2] * other[3])))
    out = 0.4 * (x * y / union if union > 0 else 0) + 0.4 * max(0.0, 1 - 2.5 * far) + 0.2 * sizes[0] / sizes[1]
    a, b = (text or "").strip().lower(), (shown or "").strip().lower()
    if a and b:
        words = [set(re.sub(r"[^\w.,/]", " ", t).split()) for t in (a, b)]
        if both := words[0] & words[1]:
            out = min(1.0, out + 0.25 * len(both) / min(map(len, words)))
        numbers = [{n.replace(",", "") for n in re.findall(r"\d+[.,]?\d*", t)} for t in (a, b)]
        if any(k in field for k in ("mrp", "quantity")) and numbers[0]:
            out = min(1.0, out + 0.3) if numbers[0] & numbers[1] else out * 0.7 if numbers[1] else out
    return round(out, 9)


def test_choices_equal_a_walk(spark):
    r = random.Random(1)
    box = lambda: [float(r.randrange(0, 200)), float(r.randrange(0, 150)), float(r.randrange(0, 60)), float(r.randrange(1, 30))]
    stated = [(i, i % 6, r.choice(["mrp", "net_quantity", "common_name"]), r.choice(TEXTS), *box(), 300.0, 200.0) for i in range(60)]
    shown = [(i % 5, i, r.choice(TEXTS), *box()) for i in range(90)]
    e = spark.createDataFrame(stated + [(99, 0, "mrp", "50", None, 1.0, 1.0, 1.0, 300.0, 200.0)], "evidence_id int, face_id int, field string, text string, x double, y double, w double, h double, width double, height double")
    c = spark.createDataFrame(shown, "face_id int, candidate_id int, text string, x double, y double, w double, h double")
    got = {x["evidence_id"]: x for x in localise.locate(e, c).collect()}
    assert len(got) == 61 and got[99]["status"] == "UNLOCALIZED"
    for row in stated:
        found = sorted((-score(row, x), x[1]) for x in shown if x[0] == row[1])
        g = got[row[0]]
        if not found:
            assert (g["candidate_id"], g["status"]) == (None, "UNLOCALIZED")
            continue
        best, rival = -found[0][0], -found[1][0]
        assert g["candidate_id"] == found[0][1] and abs(g["score"] - best) < 1e-5 and abs(g["runner_up"] - rival) < 1e-5
        close = best - rival < 0.05 and best < 0.85
        assert g["status"] == ("VERIFIED" if best >= 0.7 and not close else "AMBIGUOUS" if best >= 0.3 else "UNLOCALIZED")
