"""Consumer posts and cases: classification, duplicates, clusters, priority, and roll-ups by region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.functions.text import first_keyword
from rulewright.operators.joins import first_place

# Fixed values, as the analytics being rebuilt define them: keyword lists, weights, tiers and places.
RELEVANT = ["mrp", "rupees", "charge", "weight", "net wt", "gram", "kg", "ml", "expiry", "best before", "fssai", "license", "fungus", "expired", "fake", "tampered", "sticker", "underweight", "shortage", "overcharge", "dual mrp", "consumer court", "legal metrology", "jagograhakjago", "cheated", "fraud", "packet", "commodity"]
CATEGORIES = [
    ("Overcharging / Dual MRP", ["dual mrp", "overcharge", "overcharging", "higher price", "sticker over mrp", "extra charge", "above mrp", "mrp se jyada"]),
    ("Underweight / Shortage", ["underweight", "less weight", "shortage", "kam wajan", "kam quantity", "net weight", "digital scale"]),
    ("FSSAI Unlicensed / Quality Hazard", ["fssai", "fungus", "food safety", "adulteration", "spoiled", "poison", "insect", "unhygienic", "smell"]),
    ("Expired / Tampered Date", ["expired", "best before", "date rubbed", "date tampered", "solvent"]),
    ("Counterfeit Packaging / Tampering", ["fake", "counterfeit", "tampered", "duplicate", "duplicate barcode"]),
    ("Missing Unit Sale Price (USP)", ["usp", "unit price", "unit sale price", "per gram", "per ml"]),
]
OTHER, NOISE = "Missing Declarations", "Irrelevant / Non-Regulatory Noise"
DOMAIN = {"FSSAI Unlicensed / Quality Hazard": "FSSAI (Food Safety)", "Expired / Tampered Date": "FSSAI (Food Safety)", "Counterfeit Packaging / Tampering": "COUNTERFEIT / ALTERATION", NOISE: "GENERAL"}
DOMAIN_WEIGHT = {"FSSAI (Food Safety)": 28, "COUNTERFEIT / ALTERATION": 25, "LMPC (Metrology)": 20, "GENERAL": 10}
URGENT = ["Overcharging / Dual MRP", "Underweight / Shortage", "Expired / Tampered Date"]
SCALE_WORDS = ["scale", "weighing", "kitchen scale", "digital scale", "grams"]
BILL_WORDS = ["bill", "invoice", "receipt", "slip", "counter"]
TIERS = [(82, "CRITICAL"), (65, "HIGH"), (45, "MEDIUM")]
CITIES = [(c, c.capitalize()) for c in ("pune", "mumbai", "gurugram", "delhi", "bangalore", "bengaluru", "hyderabad", "ahmedabad", "kolkata", "chennai")]


def _any_of(text: Column, words: list[str]) -> Column:
    return first_keyword(text, [("y", words)], "n") == "y"


def category(text: Column) -> Column:
    """The first complaint category whose keywords occur; NOISE if no consumer keyword does."""
    return F.when(_any_of(text, RELEVANT), first_keyword(text, CATEGORIES, OTHER)).otherwise(NOISE)


def domain(category_: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in DOMAIN.items() for x in pair))
    return F.coalesce(F.try_element_at(table, category_), F.lit("LMPC (Metrology)"))


def evidence_kind(text: Column, has_media: Column) -> Column:
    photo = lambda yes, no: F.when(has_media, yes).otherwise(no)
    return F.when(_any_of(text, SCALE_WORDS), photo("PHOTO_SCALE", "SCALE_CLAIM")).when(_any_of(text, BILL_WORDS), photo("PHOTO_BILL_RECEIPT", "RECEIPT_CLAIM")).otherwise(photo("PHOTO_PRODUCT", "NONE"))


def priority(domain_: Column, category_: Column, has_media: Column, kind: Column, n_authorities: Column, followers: Column, volume: Column) -> Column:
    """Priority from 10 to 99: statutory weight, evidence, authorities tagged, the cluster's volume and reach."""
    weight = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in DOMAIN_WEIGHT.items() for x in pair)), domain_), F.lit(15))
    plus = lambda when, points: F.when(when, points).otherwise(0)
    score = 40 + weight + plus(category_.isin(URGENT), 15) + plus(has_media, 15) + plus(has_media & kind.isin("PHOTO_SCALE", "PHOTO_BILL_RECEIPT"), 8)
    score = score + F.least(n_authorities * 4, F.lit(10)) + plus(volume > 1, F.least(volume * 6, F.lit(18))) + plus(followers > 10_000, 5)
    return F.greatest(F.lit(10), F.least(score, F.lit(99))).cast("int")


def severity(score: Column) -> Column:
    out = F.lit("LOW")
    for least, name in reversed(TIERS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def classified(posts: DataFrame) -> DataFrame:
    """Stateless part, alike for tables and streams: posts (raw_id, text, media array, authorities array, followers, location) with content_hash, city, category, domain and evidence."""
    text = F.coalesce("text", F.lit(""))
    has_media = F.coalesce(F.size("media") > 0, F.lit(False))
    rows = posts.withColumns({"content_hash": F.md5(F.lower(F.trim(text))), "city": first_place(F.concat_ws(" ", text, "location"), CITIES, "Unspecified"), "category": category(text), "has_media": has_media, "evidence": evidence_kind(text, has_media)})
    return rows.withColumn("domain", domain(F.col("category")))


def process(posts: DataFrame) -> DataFrame:
    """classified() with first_id and is_duplicate by content, cluster volume (of city and category, duplicates counted), priority and severity.

    Copies of one text, and rows of one cluster, are counted first and joined back, so none of them is gathered in one task;
    there are at most cities x categories clusters, so those are broadcast.
    """
    rows = classified(posts)
    first = rows.groupBy("content_hash").agg(F.min("raw_id").alias("first_id"))
    volume = rows.groupBy("city", "category").agg(F.count("*").alias("volume"))
    met = rows.join(first, "content_hash").join(F.broadcast(volume), ["city", "category"])
    score = priority(F.col("domain"), F.col("category"), F.col("has_media"), F.col("evidence"), F.coalesce(F.greatest(F.size("authorities"), F.lit(0)), F.lit(0)), F.coalesce("followers", F.lit(0)), F.col("volume"))
    return met.withColumns({"is_duplicate": F.col("raw_id") != F.col("first_id"), "score": score}).withColumn("severity", severity(F.col("score")))


def summary(processed: DataFrame) -> DataFrame:
    """Per city and category: posts, duplicates, critical ones, and the greatest score."""
    return processed.groupBy("city", "category").agg(F.count("*").alias("posts"), F.count_if("is_duplicate").alias("duplicates"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.max("score").alias("top_score"))


def regional(cases: DataFrame) -> DataFrame:
    """Per matched city of cases (location, lmpc_verdict, lmpc_violations_count, fssai_status, integrity_status, reporter_type, priority, retailer_name) the counts of each kind."""
    city = first_place(F.coalesce("location", F.lit("Unspecified")), CITIES, "Other Regions")
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    violation = F.coalesce(F.col("lmpc_verdict") == "VIOLATION", F.lit(False)) | (F.coalesce("lmpc_violations_count", F.lit(0)) > 0)
    retailer = F.when((F.col("retailer_name") != "Not specified") & (F.col("retailer_name") != ""), F.col("retailer_name"))
    return cases.withColumn("city", city).groupBy("city").agg(
        F.count("*").alias("total_cases"),
        yes(violation).alias("violations"),
        yes((F.col("fssai_status") != "") & ~F.contains(F.upper("fssai_status"), F.lit("NOT"))).alias("fssai_issues"),
        yes(F.contains(F.upper("integrity_status"), F.lit("POTENTIAL"))).alias("integrity_alerts"),
        yes(F.col("reporter_type") == "Consumer").alias("consumer_reports"),
        yes(F.col("priority") == "HIGH").alias("high_priority"),
        F.count_distinct(retailer).alias("retailer_count"),
    )
