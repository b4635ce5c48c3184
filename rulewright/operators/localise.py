"""Which detected box on a face shows a stated value: a score of place, size, words and numbers, and the best box of each value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.functions import geometry

# Shares of overlap, nearness and size, what shared words and numbers add, what other numbers leave, and the limits of verdicts.
OVERLAP, NEAR, SIZE, REACH = 0.40, 0.40, 0.20, 2.5
WORDS, NUMBER, OTHER_NUMBER = 0.25, 0.30, 0.70
VERIFIED, AMBIGUOUS, MARGIN, CLEAR = 0.70, 0.30, 0.05, 0.85
# What a field of numbers has in its name.
NUMERIC = "mrp,price,net_quantity,quantity,unit_sale_price,usp,mfg_date,expiry,use_before,batch"
#: Parts that a face's boxes are dealt to.
SALTS = 8


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text), r"(?U)[^\w.,/]", " "), r"\s+"), lambda w: w != ""))


def _numbers(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\d+[.,]?\d*"), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit(""))))


def candidate_score(box: Column, candidate: Column, diagonal: Column, stated: Column, shown: Column, field: Column) -> Column:
    """0 to 1 for boxes (x, y, w, h) of a stated value and a detected text. Null texts count as empty, and empty ones neither add nor take."""
    distance = F.when(diagonal > 0, F.least(F.lit(1.0), geometry.centre_distance(box, candidate) / F.when(diagonal > 0, diagonal))).otherwise(1.0)
    a, b = (F.greatest(F.lit(1.0), geometry.area(c)) for c in (box, candidate))
    place = OVERLAP * geometry.iou(box, candidate) + NEAR * F.greatest(F.lit(0.0), 1 - distance * REACH) + SIZE * F.least(a, b) / F.greatest(a, b)
    stated, shown = (F.lower(F.trim(F.coalesce(t, F.lit("")))) for t in (stated, shown))
    common, least = F.size(F.array_intersect(_words(stated), _words(shown))), F.least(F.size(_words(stated)), F.size(_words(shown)))
    worded = F.when(common > 0, F.least(F.lit(1.0), place + WORDS * common / F.greatest(least, F.lit(1)))).otherwise(place)
    same = F.arrays_overlap(_numbers(stated), _numbers(shown))
    numeric = F.coalesce(F.lower(field).rlike(NUMERIC.replace(",", "|")), F.lit(False)) & (F.size(_numbers(stated)) > 0)
    numbered = F.when(numeric & same, F.least(F.lit(1.0), worded + NUMBER)).when(numeric & (F.size(_numbers(shown)) > 0), worded * OTHER_NUMBER).otherwise(worded)
    return F.when((stated != "") & (shown != ""), numbered).otherwise(place)


def locate(evidence: DataFrame, candidates: DataFrame, salts: int = SALTS) -> DataFrame:
    """Each stated value (evidence_id, face_id, field, text, x, y, w, h, width, height) with its best box among a face's candidates (face_id, candidate_id, text, x, y, w, h): candidate_id, score, runner_up and status.

    VERIFIED from 0.70 on, unless the next is within 0.05 and the best under 0.85; AMBIGUOUS from 0.30 on; else UNLOCALIZED, as are values
    without a box or candidates. Ties go to the lesser candidate_id. A face's boxes are dealt to `salts` parts, each keeps a value's best two.
    """
    box = lambda prefix: F.struct(*(F.col(f"{prefix}{c}").cast("double").alias(c) for c in ("x", "y", "w", "h")))
    stated = evidence.select("evidence_id", "face_id", "field", "text", box("").alias("box"), F.hypot(F.col("width").cast("double"), F.col("height").cast("double")).alias("diagonal"))
    shown = candidates.select("face_id", "candidate_id", F.col("text").alias("shown"), box("").alias("candidate"), F.pmod(F.xxhash64("candidate_id"), F.lit(salts)).cast("int").alias("salt"))
    met = stated.where("box.x is not null and box.y is not null and box.w is not null and box.h is not null").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).join(shown, ["face_id", "salt"])
    score = F.round(candidate_score(F.col("box"), F.col("candidate"), F.col("diagonal"), F.col("text"), F.col("shown"), F.col("field")), 9)
    ranked = met.select("evidence_id", "salt", F.struct((-score).alias("less"), "candidate_id").alias("r"))
    # a part's best two, then the best two of all parts
    best = ranked.groupBy("evidence_id", "salt").agg(F.slice(F.array_sort(F.collect_list("r")), 1, 2).alias("two"))
    two = best.groupBy("evidence_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("two"))), 1, 2).alias("two"))
    first, second = F.get("two", F.lit(0)), F.get("two", F.lit(1))
    found = evidence.join(two, "evidence_id", "left").select("evidence_id", "face_id", "field", first["candidate_id"].alias("candidate_id"), (-first["less"]).alias("score"), (-second["less"]).alias("runner_up"))
    close = F.coalesce((F.col("score") - F.col("runner_up") < MARGIN) & (F.col("score") < CLEAR), F.lit(False))
    status = F.when((F.col("score") >= VERIFIED) & ~close, "VERIFIED").when(F.col("score") >= AMBIGUOUS, "AMBIGUOUS").otherwise("UNLOCALIZED")
    return found.withColumns({"score": F.round("score", 6), "runner_up": F.round("runner_up", 6), "status": status})
