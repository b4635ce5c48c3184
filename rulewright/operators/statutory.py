"""Statutory checks of packages: scope, required declarations, and the smaller checks of placement, bundles, export and the like.

Readings become one row a package (a struct column a field) by one aggregation with partial results, captures by another.
After these two joins on the package every check is an expression over that row, so more checks add no shuffle, and a
package's status comes from its array of facts without another grouping.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.operators.relational import capped_status

PASS, FAIL, UNCERTAIN, EXEMPT = "PASS", "FAIL", "UNCERTAIN", "EXEMPT"
APPLICABLE, NOT_APPLICABLE, APPLICABILITY_UNKNOWN = "APPLICABLE", "NOT_APPLICABLE", "APPLICABILITY_UNKNOWN"
LEAST_CONFIDENCE, LEAST_COVERAGE = 0.55, 0.70

# The flag that decides each condition
CONDITION_FLAGS = {
    "imported_product": "is_imported",
    "commodity_dimensions_are_relevant": "dimensions_relevant",
    "commodity_may_become_unfit_for_human_consumption": "best_before_applicable",
    "rule_6_subrule_11_applies": "unit_price_rule_applies",
    "pan_masala": "is_pan_masala",
    "tobacco_or_tobacco_product": "is_tobacco",
    "package_is_within_the_partial_relaxation_range": "small_pack_relaxation_applies",
}
# What holds if a package doesn't have the flag; other conditions are then unknown
CONDITION_DEFAULTS = {
    "imported_product": False,
    "commodity_dimensions_are_relevant": False,
    "commodity_may_become_unfit_for_human_consumption": False,
    "rule_6_subrule_11_applies": True,
}
# Words of a complete address
ADDRESS_WORDS = [
    "Maharashtra", "Tamil Nadu", "Karnataka", "Gujarat", "Delhi", "Uttar Pradesh", "Haryana", "Punjab", "West Bengal", "Telangana",
    "Andhra Pradesh", "Kerala", "Rajasthan", "Madhya Pradesh", "Bihar", "Odisha", "Assam", "Goa", "Uttarakhand", "Himachal Pradesh",
    "Jharkhand", "Chhattisgarh", "Mumbai", "Pune", "Bangalore", "Bengaluru", "Chennai", "Hyderabad", "Kolkata", "Ahmedabad",
    "Mandideep", "Raisen", "Gurugram", "Gurgaon", "Noida", "Faridabad", "Thane", "Navi Mumbai", "Baddi", "Haridwar", "SIDCUL",
    "Plot", "Industrial Area", "MIDC", "GIDC", "RIICO", "Estate", "Sector", "Phase", "Road", "Marg", "Street",
]
# States written as two initials, with or without dots
ADDRESS_INITIALS = ["MP", "UP", "TN", "AP", "WB", "HP"]
# Names of units of quantity
GRAM, KILOGRAM = ["g", "gram", "grams", "gms", "gm"], ["kg", "kilogram", "kilograms", "kgs"]
MILLILITRE, LITRE = ["ml", "millilitre", "millilitres", "milliliter", "milliliters"], ["l", "litre", "litres", "liter", "liters"]
# Categories of the heavier limit, and those without relaxation for small packs
HEAVY_CATEGORIES = ["cement", "fertilizer", "agricultural farm produce"]
UNRELAXED_CATEGORIES = ["tobacco", "tobacco product", "tobacco products", "pan masala"]

READING = {"confidence": "double", "value": "string", "number": "double", "normalized": "string", "observed": "boolean", "agreement": "string"}
PACKAGE = {
    "sale_type": "string", "category": "string", "quantity": "double", "quantity_unit": "string", "is_prepackaged": "boolean", "direct_to_industry": "boolean",
    "is_export_only": "boolean", "bundle_count": "int", "packed_by_restaurant": "boolean", "price_controlled": "boolean", "check_registration": "boolean", "flags": "map<string,boolean>",
}


@dataclass(frozen=True)
class Requirement:
    field: str
    condition: str | None = None


def applicability(condition: str | None, flags: Column) -> Column:
    """Whether a conditional requirement applies: by its flag, else its default, else unknown (then absence never fails)."""
    if condition is None:
        return F.lit(APPLICABLE)
    if condition not in CONDITION_FLAGS:
        return F.lit(APPLICABILITY_UNKNOWN)
    flag = CONDITION_FLAGS[condition]
    known = F.coalesce(F.map_contains_key(flags, flag), F.lit(False))
    unset = {True: APPLICABLE, False: NOT_APPLICABLE}.get(CONDITION_DEFAULTS.get(condition), APPLICABILITY_UNKNOWN)
    return F.when(known & F.coalesce(F.try_element_at(flags, F.lit(flag)), F.lit(False)), APPLICABLE).when(known, NOT_APPLICABLE).otherwise(unset)


def readings_by_package(readings: DataFrame, fields: list[str]) -> DataFrame:
    """One row a package with a struct column `r_<field>` of its most confident reading (ties: the greater value); null where there is none.

    `readings` has package_id, field and the columns of READING; rows of other fields or without a field are passed over.
    """
    cell = F.struct(*(F.col(c).cast(t).alias(c) for c, t in READING.items()))
    return readings.where(F.col("field").isin(fields)).groupBy("package_id").agg(*(F.max(F.when(F.col("field") == f, cell)).alias(f"r_{f}") for f in fields))


def coverage(captures: DataFrame) -> DataFrame:
    """A package's greatest coverage over usable or partly usable captures, and whether one shows the display panel.

    `captures` has package_id, quality, evidence_coverage and has_pdp.
    """
    usable = F.col("quality").isin("USABLE", "PARTIAL")
    return captures.groupBy("package_id").agg(F.max(F.when(usable, F.col("evidence_coverage"))).alias("coverage"), F.max(F.coalesce("has_pdp", F.lit(False))).alias("has_pdp"))


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("_"), F.lit(" ")), r"\s+", " "))


def _amount(value: Column, unit: Column, one: list[str], thousand: list[str]) -> Column:
    name = _plain(unit)
    return F.when(value >= 0, F.when(name.isin(one), value).when(name.isin(thousand), value * 1000.0))


def scope(sale_type: Column, category: Column, quantity: Column, unit: Column, is_prepackaged: Column, direct_to_industry: Column, is_export_only: Column, verified: bool = True) -> Column:
    """Ordered decision whether the package checks apply: struct of is_exempt, kind (null: plainly in scope) and review.

    Mass and volume are never mixed. An unknown quantity leaves the question open, for review; wholesale is another
    regime, not an exemption. `verified` is whether the limits of quantity themselves were verified.
    """
    sale = _plain(sale_type)
    sale = F.when(sale.isin("e commerce", "e-commerce"), "ecommerce").otherwise(sale)
    kind_of_goods = F.coalesce(_plain(category), F.lit(""))
    mass, volume = _amount(quantity, unit, GRAM, KILOGRAM), _amount(quantity, unit, MILLILITRE, LITRE)
    limit = F.when(kind_of_goods.isin(HEAVY_CATEGORIES), 50_000.0).otherwise(25_000.0)
    large = F.when(mass.isNotNull(), mass > limit).otherwise(volume > 25_000.0)
    small = ~kind_of_goods.isin(UNRELAXED_CATEGORIES) & (F.coalesce(mass, volume) <= 10.0)
    answer = lambda exempt, kind, review: F.struct(F.lit(exempt).alias("is_exempt"), F.lit(kind).cast("string").alias("kind"), F.lit(review).alias("review"))
    industrial = direct_to_industry | sale.isin("industrial", "institutional")
    established = (quantity > 0) & (F.trim(unit) != "")
    return (
        F.when(~is_prepackaged, answer(True, "not_prepackaged", False))
        .when(F.coalesce(industrial, F.lit(False)), answer(True, "industrial_or_institutional_direct_sale", False))
        .when(is_export_only & (sale == "export"), answer(True, "export_only_transaction", False))
        .when(~F.coalesce(established, F.lit(False)), answer(False, "quantity_not_established", True))
        .when(large, answer(True, "rule_3_quantity_exclusion", not verified))
        .when(small, answer(True, "rule_26_small_pack", not verified))
        .when(sale == "wholesale", answer(False, "different_declaration_regime", False))
        .when(~F.coalesce(sale.isin("retail", "ecommerce", "export"), F.lit(False)), answer(False, "unknown_sale_type", True))
        .otherwise(answer(False, None, False))
    )


def address_complete(text: Column) -> Column:
    """Whether a name and address has a PIN code or a known place, at least 12 characters, and no break at its end or within."""
    t = F.trim(text)
    words = "|".join(w.replace(" ", r"\s*") for w in ADDRESS_WORDS)
    initials = "|".join(rf"{a}\.?{b}\.?" for a, b in ADDRESS_INITIALS)
    placed = t.rlike(r"\b[1-9]\d{5}\b") | t.rlike(rf"(?i)\b(?:{words}|{initials})\b")
    return placed & ~t.rlike(r"[,;:/]$") & ~t.contains(",,") & (F.length(t) >= 12)


def _given(reading: Column) -> Column:
    return F.coalesce(F.trim(reading["value"]) != "", F.lit(False))


def _fact(field: str, status: Column, reading: Column | None = None, confidence: Column | None = None) -> Column:
    """A fact; a pass or fail on a reading whose sources conflict becomes uncertain, and whatever isn't a pass or exempt is for review."""
    if reading is not None:
        status = F.when(reading.isNull(), status).otherwise(capped_status(status, reading["agreement"]))
    sure = confidence if confidence is not None else (F.lit(0.0) if reading is None else reading["confidence"])
    return F.struct(F.lit(field).alias("field"), status.alias("status"), (~status.isin(PASS, EXEMPT)).alias("review_required"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(sure, F.lit(0.0)))).alias("confidence"))


def declaration(requirement: Requirement, reading: Column, flags: Column, sufficient: Column, least: float = LEAST_CONFIDENCE) -> Column:
    """Fact of one required declaration; null where the requirement doesn't apply.

    A given value passes if it is confident enough and, for prices, dates and addresses, well formed. An absent one fails
    only if the captures cover enough of the package, nothing of it was observed and it surely applies; else it is uncertain.
    """
    field = requirement.field
    sound = F.coalesce(reading["confidence"] >= least, F.lit(False))
    if field == "mrp":
        sound &= reading["number"].isNotNull()
    elif field in ("best_before_use_by", "mfg_date"):
        sound &= reading["normalized"].isNotNull()
    elif field == "manufacturer_name_address":
        sound &= address_complete(reading["value"])
    applies = applicability(requirement.condition, flags)
    seen = F.coalesce(reading["observed"], F.lit(False))
    absent = F.when(seen | (applies == APPLICABILITY_UNKNOWN) | ~sufficient, UNCERTAIN).otherwise(FAIL)
    given = _given(reading)
    status = F.when(given, F.when(sound, PASS).otherwise(UNCERTAIN)).otherwise(absent)
    confidence = F.when(~given & (absent == FAIL), 1.0).otherwise(reading["confidence"])
    return F.when(applies != NOT_APPLICABLE, _fact(field, status, reading, confidence))


def _checks(p: dict[str, Column], r: dict[str, Column], has_pdp: Column, retail: list[Requirement], wholesale: list[Requirement], sufficient: Column, least: float) -> list[Column]:
    """Facts of all checks in order, null where one doesn't apply."""
    sale, category = F.coalesce(F.lower(p["sale_type"]), F.lit("")), F.coalesce(F.lower(F.trim(p["category"])), F.lit(""))
    out = [F.when(p["scope"]["kind"] == "quantity_not_established", _fact("__scope__", F.lit(UNCERTAIN)))]
    for regime, wanted in (("retail", retail), ("wholesale", wholesale)):
        out += [F.when(sale == regime, declaration(w, r[w.field], p["flags"], sufficient, least)) for w in wanted if w.field != "unit_sale_price" or regime == "wholesale"]
    confident = F.coalesce(r["batch_no"]["confidence"] >= least, F.lit(False))
    out.append(F.when((sale == "retail") & _given(r["batch_no"]), _fact("batch_no", F.when(confident, PASS).otherwise(UNCERTAIN), r["batch_no"])))
    inner = r["inner_package_labels"]
    out.append(F.when((sale == "retail") & (p["bundle_count"] > 1), _fact("multipack_inner_declarations", F.when(_given(inner), PASS).otherwise(UNCERTAIN), inner)))
    size, odd = r["standard_pack_size"], r["nonstandard_pack_declaration"]
    pack = F.when(_given(size), _fact("standard_pack_size", F.lit(PASS), size)).when(_given(odd), _fact("standard_pack_size", F.lit(PASS), odd)).otherwise(_fact("standard_pack_size", F.lit(UNCERTAIN), r["net_quantity"]))
    out.append(F.when(sale.isin("retail", "wholesale"), pack))
    relabelled = r["repack_or_relabel_evidence"]
    out.append(F.when(p["is_export_only"] & sale.isin("retail", "wholesale", "ecommerce"), _fact("repack_or_relabel_before_india_sale", F.when(_given(relabelled), PASS).otherwise(FAIL), relabelled)))
    for field, goods, flag in (("fast_food_exemption", ("fast_food", "restaurant_pack", "hotel_pack"), "packed_by_restaurant"), ("drug_formulation_exemption", ("drug", "drug_formulation", "pharmaceutical"), "price_controlled")):
        met = F.coalesce(p[flag], F.lit(False))
        out.append(F.when(category.isin(*goods), _fact(field, F.when(met, EXEMPT).otherwise(UNCERTAIN), confidence=F.when(met, 1.0))))
    number = r["registration_number"]
    out.append(F.when(_given(number) | F.coalesce(p["check_registration"], F.lit(False)), _fact("registration_number", F.when(_given(number), PASS).otherwise(UNCERTAIN), number)))
    quantity = r["net_quantity"]
    out.append(F.when(sale.isin("ecommerce", "advertisement") & _given(r["mrp"]), _fact("advertisement_net_quantity", F.when(_given(quantity), PASS).otherwise(FAIL), quantity)))
    out.append(F.when(sale == "retail", _fact("declaration_placement", F.when(has_pdp, PASS).otherwise(UNCERTAIN), confidence=F.when(has_pdp, 0.75))))
    return out


CHECKED = ["batch_no", "inner_package_labels", "standard_pack_size", "nonstandard_pack_declaration", "net_quantity", "repack_or_relabel_evidence", "registration_number", "mrp"]


def overall_status(facts: Column) -> Column:
    """A fail, else an uncertain fact decides; all exempt is exempt; no facts are uncertain."""
    any_of = lambda s: F.exists(facts, lambda f: f["status"] == s)
    return F.when(F.size(facts) == 0, UNCERTAIN).when(any_of(FAIL), FAIL).when(any_of(UNCERTAIN), UNCERTAIN).when(F.forall(facts, lambda f: f["status"] == EXEMPT), EXEMPT).otherwise(PASS)


def inspect(packages: DataFrame, readings: DataFrame, captures: DataFrame, retail: list[Requirement], wholesale: list[Requirement], least: float = LEAST_CONFIDENCE, required_coverage: float = LEAST_COVERAGE) -> DataFrame:
    """Every check on every package: package_id, scope, facts (array), overall_status, counts by status, coverage.

    `packages` has package_id and any of PACKAGE's columns; absent ones count as null. An exempt package has the one fact
    of its scope. Packages without readings or captures stay; rows of a null package_id meet none.
    """
    fields = list(dict.fromkeys([*CHECKED, *(w.field for w in [*retail, *wholesale])]))
    base = packages.select("package_id", *((F.col(c) if c in packages.columns else F.lit(None)).cast(t).alias(c) for c, t in PACKAGE.items()))
    wide = base.join(readings_by_package(readings, fields), "package_id", "left").join(coverage(captures), "package_id", "left")
    p = {c: F.col(c) for c in [*PACKAGE, "scope"]}
    wide = wide.withColumn("scope", scope(*(p[c] for c in ("sale_type", "category", "quantity", "quantity_unit", "is_prepackaged", "direct_to_industry", "is_export_only"))))
    sufficient, has_pdp = F.coalesce(F.col("coverage") >= required_coverage, F.lit(False)), F.coalesce("has_pdp", F.lit(False))
    checks = F.array_compact(F.array(*_checks(p, {f: F.col(f"r_{f}") for f in fields}, has_pdp, retail, wholesale, sufficient, least)))
    facts = F.when(F.col("scope.is_exempt"), F.array(_fact("__scope__", F.lit(EXEMPT), confidence=F.lit(1.0)))).otherwise(checks)
    counted = lambda s: F.size(F.filter("facts", lambda f: f["status"] == s)).cast("bigint").alias(f"n_{s.lower()}")
    return wide.select("package_id", "scope", facts.alias("facts"), F.col("coverage")).select("*", overall_status(F.col("facts")).alias("overall_status"), *map(counted, (PASS, FAIL, UNCERTAIN, EXEMPT)))


def facts_of(inspected: DataFrame) -> DataFrame:
    """One row a fact of inspected packages."""
    return inspected.select("package_id", F.explode("facts").alias("f")).select("package_id", *(F.col(f"f.{c}") for c in ("field", "status", "review_required", "confidence")))


def review_required(facts: Column, stated: Column | None = None) -> Column:
    """A stated answer holds; else whether any fact is for review."""
    found = F.coalesce(F.exists(facts, lambda f: f["review_required"]), F.lit(False))
    return found if stated is None else F.coalesce(stated, found)


def docket_counts(rows: DataFrame, key: str, status: str) -> DataFrame:
    """How many declarations of a key are verified, for review, and violations, by words in their status; all of them too."""
    s = F.upper(F.coalesce(F.col(status), F.lit("")))
    holds = lambda *words: reduce(lambda a, b: a | b, (s.contains(w) for w in words))
    return rows.groupBy(key).agg(F.count_if(s.isin("VERIFIED", PASS)).alias("verified"), F.count_if(holds("REVIEW", UNCERTAIN)).alias("for_review"), F.count_if(holds("NON_COMPLIANT", "NOT_DETECTED")).alias("violations"), F.count("*").alias("total"))
