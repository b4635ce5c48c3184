"""Statutory checks and lifecycles on small literals, nulls and empty tables included."""

import pytest
from pyspark.sql import functions as F

from rulewright.operators import lifecycle, statutory, units
from rulewright.operators.statutory import Requirement

READING = "package_id int, field string, confidence double, value string, number double, normalized string, observed boolean, agreement string"
CAPTURE = "package_id int, quality string, evidence_coverage double, has_pdp boolean"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, complete",
    [("Acme Foods Pvt Ltd, Pune, India", True), ("Acme Foods, 411001", True), ("Acme Foods, Bhopal, M.P.", True), ("Acme Foods Pvt Ltd", False), ("Acme Foods, Pune,", False), ("Acme,, Pune Road", False), ("Pune", False), ("", False)],
)
def test_address(spark, text, complete):
    assert one(spark, statutory.address_complete(F.lit(text))) == complete


@pytest.mark.parametrize(
    "condition, flags, answer",
    [(None, {}, "APPLICABLE"), ("imported_product", {}, "NOT_APPLICABLE"), ("imported_product", {"is_imported": True}, "APPLICABLE"), ("pan_masala", {}, "APPLICABILITY_UNKNOWN"), ("pan_masala", {"is_pan_masala": False}, "NOT_APPLICABLE"), ("pan_masala", {"is_pan_masala": None}, "NOT_APPLICABLE"), ("something", {}, "APPLICABILITY_UNKNOWN"), ("rule_6_subrule_11_applies", None, "APPLICABLE")],
)
def test_applicability(spark, condition, flags, answer):
    row = spark.createDataFrame([(flags,)], "flags map<string,boolean>")
    assert row.select(statutory.applicability(condition, F.col("flags"))).first()[0] == answer


@pytest.mark.parametrize(
    "package, exempt, kind",
    [
        (("retail", "food", 1.0, "kg", None, None, False), False, None),
        (("retail", "food", 1.0, "kg", False, None, False), True, "not_prepackaged"),
        (("Institutional", "food", 1.0, "kg", None, None, False), True, "industrial_or_institutional_direct_sale"),
        (("export", "food", 1.0, "kg", None, None, True), True, "export_only_transaction"),
        (("retail", "food", None, "kg", None, None, False), False, "quantity_not_established"),
        (("retail", "food", 0.0, "kg", None, None, False), False, "quantity_not_established"),
        (("retail", "food", 5.0, " ", None, None, False), False, "quantity_not_established"),
        (("retail", "food", 25.0, "kg", None, None, False), False, None),
        (("retail", "food", 25001.0, "Grams", None, None, False), True, "rule_3_quantity_exclusion"),
        (("retail", "Cement", 50.0, "kgs", None, None, False), False, None),
        (("retail", "food", 10.0, "ml", None, None, False), True, "rule_26_small_pack"),
        (("retail", "pan_masala", 10.0, "g", None, None, False), False, None),
        (("retail", "food", 5.0, "pieces", None, None, False), False, None),
        (("wholesale", "food", 1.0, "kg", None, None, False), False, "different_declaration_regime"),
        (("barter", "food", 1.0, "kg", None, None, False), False, "unknown_sale_type"),
        ((None, None, 1.0, "kg", None, None, None), False, "unknown_sale_type"),
    ],
)
def test_scope(spark, package, exempt, kind):
    row = spark.createDataFrame([package], "a string, b string, c double, d string, e boolean, f boolean, g boolean")
    got = row.select(statutory.scope(*(F.col(c) for c in "abcdefg")).alias("s")).first().s
    assert (got.is_exempt, got.kind) == (exempt, kind)


def test_inspection(spark, tmp_path):
    packages = spark.createDataFrame([(1, "retail", 1.0, "kg", "x"), (2, "retail", 1.0, "kg", "x"), (3, "retail", 5.0, "g", "x"), (None, None, None, None, None)], "package_id int, sale_type string, quantity double, quantity_unit string, facts string")
    readings = spark.createDataFrame(
        [
            (1, "mrp", 0.9, "Rs 10", 10.0, None, True, "CORROBORATED"), (1, "mrp", 0.6, "Rs 70", None, None, True, "CORROBORATED"), (1, "common_name", 0.9, "Oil", None, None, True, "CONFLICTING"), (1, "net_quantity", 0.5, "1 kg", None, None, True, "CORROBORATED"),
            (1, "standard_pack_size", 0.9, "1 kg", None, None, True, "CORROBORATED"), (2, "mrp", 0.9, " ", None, None, False, "CORROBORATED"), (2, "common_name", None, None, None, None, True, None), (2, None, None, None, None, None, None, None),
        ],
        READING,
    )
    captures = spark.createDataFrame([(1, "USABLE", 0.5, True), (2, "PARTIAL", 0.7, None), (2, "BLURRED", 1.0, False), (None, None, None, None)], CAPTURE)
    wanted = [Requirement("mrp"), Requirement("common_name"), Requirement("net_quantity"), Requirement("country_of_origin", "imported_product"), Requirement("warning", "pan_masala"), Requirement("mfg_date")]
    got = statutory.inspect(packages, readings, captures, wanted, [])
    facts = {(r.package_id, r.field): r.status for r in statutory.facts_of(got).collect()}
    assert facts == {
        (1, "mrp"): "PASS", (1, "common_name"): "UNCERTAIN", (1, "net_quantity"): "UNCERTAIN", (1, "warning"): "UNCERTAIN", (1, "mfg_date"): "UNCERTAIN", (1, "standard_pack_size"): "PASS", (1, "declaration_placement"): "PASS",
        (2, "mrp"): "FAIL", (2, "common_name"): "UNCERTAIN", (2, "net_quantity"): "FAIL", (2, "warning"): "UNCERTAIN", (2, "mfg_date"): "FAIL", (2, "standard_pack_size"): "UNCERTAIN", (2, "declaration_placement"): "UNCERTAIN",
        (3, "__scope__"): "EXEMPT", (None, "__scope__"): "UNCERTAIN",
    }
    assert {r.package_id: r.overall_status for r in got.collect()} == {1: "UNCERTAIN", 2: "FAIL", 3: "EXEMPT", None: "UNCERTAIN"}
    statutory.facts_of(got).write.parquet(str(tmp_path / "facts"))
    assert spark.read.parquet(str(tmp_path / "facts")).count() == len(facts)
    assert statutory.inspect(packages.limit(0), readings.limit(0), captures.limit(0), wanted, []).count() == 0


def test_transitions(spark):
    move = lambda a, b, who=None: tuple(one(spark, lifecycle.transition(F.lit(a), F.lit(b), F.lit(who).cast("string"))))
    assert move("DRAFT", "EXTRACTED") == ("APPLIED", "EXTRACTED")
    assert move("DRAFT", "APPROVED") == ("ILLEGAL", "DRAFT")
    assert move("SCHEDULED", "ACTIVE", " ") == ("AUTHORITY_MISSING", "SCHEDULED")
    assert move("SCHEDULED", "ACTIVE", "officer") == ("APPLIED", "ACTIVE")
    assert move("APPROVED", "ACTIVE", "officer") == ("ILLEGAL", "APPROVED")


def test_units_of_time_and_mass(spark):
    assert one(spark, units.convert(F.lit(2.0), F.lit("days"), F.lit("hours"))) == 48.0
    assert one(spark, units.convert(F.lit(1.0), F.lit("lb"), F.lit("g"))) == 453.59237
    assert one(spark, units.convert(F.lit(1.0), F.lit("fl_oz"), F.lit("kg"))) is None
