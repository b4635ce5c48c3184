"""Similarity against difflib, and JSON objects in replies."""

import difflib
import json
import random
import re

from pyspark.sql import functions as F

from rulewright.functions import similarity, text
from rulewright.plans import evidence


def naive(a, b):
    def norm(t):
        t = re.sub(similarity.CURRENCY, "", (t or "").strip().lower())
        return " ".join(similarity.ABBREVIATIONS.get(w, w) for w in re.sub(similarity.PUNCTUATION, " ", t).split())

    if (a or "").strip().lower() == (b or "").strip().lower():
        return 1.0, 1.0, "EXACT"
    x, y = norm(a), norm(b)
    if x == y:
        return 0.95, 1.0, "NORMALISED"
    words = set(x.split()), set(y.split())
    overlap = len(words[0] & words[1]) / len(words[0] | words[1]) if words[0] | words[1] else 1.0
    ratio = difflib.SequenceMatcher(None, x, y).ratio()
    same = str.maketrans(similarity.GLYPHS)
    glyph = difflib.SequenceMatcher(None, x.translate(same), y.translate(same)).ratio()
    best = max(ratio, overlap, glyph)
    return ratio, best, "GLYPHS" if glyph >= 0.9 > ratio else "WORDS" if overlap >= 0.85 else "ALIKE" if best >= 0.8 else "DIFFERENT"


def test_similarity_equals_difflib(spark):
    r = random.Random(2)
    words = ["Net", "Qty", "100 g", "Rs.50/-", "ltd", "Ltd.", "pvt", "B0TTLE", "BOTTLE", "l5", "is", "Acme", "mfd:", "", "x" * 30]
    rows = [(" ".join(r.choice(words) for _ in range(r.randint(0, 6))), " ".join(r.choice(words) for _ in range(r.randint(0, 6)))) for _ in range(300)]
    rows += [(None, ""), (None, "a"), ("B0TT1E", "BOTTLE"), ("b a c d", "a b c d"), ("ab " * 120, "ba " * 130)]
    got = similarity.compare_values(spark.createDataFrame(rows * 2, "a string, b string"), "a", "b").collect()
    assert len(got) == 2 * len(rows)
    for x in got:
        raw, best, diagnosis = naive(x["a"], x["b"])
        assert abs(x["raw_similarity"] - raw) <= 0.00051 and abs(x["similarity"] - best) <= 0.00051 and x["diagnosis"] == diagnosis


REPLIES = [
    ('{"a": 1}', {"a": 1}),
    ('```json\n{"a": {"b": [1, {"c": "}"}]}}\n```', {"a": {"b": [1, {"c": "}"}]}}),
    ('Sure: {"a": "x \\" } {"} and {"b": 2}', {"a": 'x " } {'}),
    ('{"a": {"b": 1}', None),
    ('{"a": "unclosed } ', None),
    ("none here", None),
    ("", None),
    (None, None),
    ("{not json} {}", None),
    ('noise } {"a": []} tail }', {"a": []}),
    ('```\n{"a": "```"}\n```', {"a": "```"}),
]


def test_first_balanced_object(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(REPLIES)], "i int, t string").withColumn("j", text.json_object(F.col("t"))).orderBy("i").collect()
    assert [json.loads(r["j"]) if r["j"] is not None else None for r in rows] == [want for _, want in REPLIES]


def test_registered_query_equals_difflib(spark):
    got = evidence.queries()["part_name_similarity"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count() - 1
    for x in got:
        raw, best, diagnosis = naive(x["stated"], x["read"])
        assert abs(x["raw_similarity"] - raw) <= 0.00051 and abs(x["similarity"] - best) <= 0.00051 and x["diagnosis"] == diagnosis
