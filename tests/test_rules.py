"""The rule engine: Kleene logic, stages of a rule, validation, and text and date functions."""

import itertools

import pytest
from pyspark.sql import functions as F

from rulewright.functions import dates, text
from rulewright.operators import relational, rules, units
from rulewright.operators.conditions import Evidence, RuleConfigurationError, compile_calculation, compile_condition

CELL = "struct<value:string,unit:string,confidence:double,present:boolean,usable:boolean>"


def one(spark, node, cell=None, context=None):
    frame = spark.createDataFrame([(cell, context)], f"f {CELL}, c string")
    c = compile_condition(node, Evidence({"f": F.col("f")}, {"c": F.col("c")}))
    return tuple(frame.select(c.value, c.error).first())


def seen(value, unit=None, confidence=0.9, present=None, usable=None):
    return (value, unit, confidence, present, usable)


def test_kleene(spark):
    leaf = {True: {"op": "always"}, False: {"op": "never"}, None: {"op": "eq", "field": "f", "value": "x"}}
    for a, b in itertools.product((True, False, None), repeat=2):
        want_and = False if False in (a, b) else None if None in (a, b) else True
        want_or = True if True in (a, b) else None if None in (a, b) else False
        assert one(spark, {"op": "and", "args": [leaf[a], leaf[b]]})[0] is want_and
        assert one(spark, {"op": "or", "args": [leaf[a], leaf[b]]})[0] is want_or
    assert one(spark, {"op": "and", "args": []})[0] is True and one(spark, {"op": "or", "args": []})[0] is False
    assert one(spark, None)[0] is True


@pytest.mark.parametrize(
    "node, cell, value, error",
    [
        ({"op": "gt", "field": "f", "value": 5}, seen("6"), True, False),
        ({"op": "gt", "field": "f", "value": 5}, seen("6", confidence=0.1), None, False),
        ({"op": "gt", "field": "f", "value": 5}, seen("six"), None, True),
        ({"op": "lte", "field": "f", "value": 1, "unit": "kg"}, seen("900", "g"), True, False),
        ({"op": "lte", "field": "f", "value": 1, "unit": "l"}, seen("900", "g"), None, True),
        ({"op": "between", "field": "f", "min": 1, "max": 2, "max_inclusive": False}, seen("2"), False, False),
        ({"op": "eq", "field": "f", "value": "ABC"}, seen(" abc "), True, False),
        ({"op": "eq", "field": "f", "value": 1.0}, seen("1"), True, False),
        ({"op": "in", "field": "f", "values": ["1.0"]}, seen("1"), False, False),
        ({"op": "exists", "field": "f"}, seen("1", usable=False), None, False),
        ({"op": "exists", "field": "f"}, seen(None), False, False),
        ({"op": "exists", "field": "f"}, seen("1", confidence=0.0), True, False),
        ({"op": "missing", "field": "f"}, seen(None), True, False),
        ({"op": "null", "field": "nowhere"}, seen("1"), True, False),
        ({"op": "boolean", "field": "f"}, seen("false"), True, False),
        ({"op": "regex", "field": "f", "pattern": "^a.c$"}, seen("abc"), True, False),
        ({"op": "date_before", "field": "f", "value": "2026-04"}, seen("31/03/2026"), True, False),
        ({"op": "date_after", "field": "f", "value": "2026-04"}, seen("soon"), None, True),
    ],
)
def test_leaves(spark, node, cell, value, error):
    assert one(spark, node, cell) == (value, error)


def test_rule_stages(spark):
    cells = [("a", seen("180"), "retail", "no"), ("b", seen(None, confidence=None), "retail", "no"), ("c", seen("5"), "export", "no"), ("d", seen("5"), None, "no"), ("e", seen("5"), "retail", "yes"), ("f", seen("x"), "retail", "no"), ("g", seen("5"), "retail", "no")]
    frame = spark.createDataFrame(cells, f"id string, f {CELL}, sale string, small string")
    rule = rules.Rule("R", applies_to={"sale": ["Retail"]}, exemptions=[{"condition": {"op": "eq", "field": "small", "value": "yes"}}], requirements=[{"condition": {"op": "gte", "field": "f", "value": 100}}], effective_from="2026-01-01")
    later = rules.Rule("L", depends_on=["R"], condition={"op": "eq", "field": "rule_results.R.status", "value": "PASS"})
    e = Evidence({"f": F.col("f")}, {"sale": F.col("sale"), "small": F.col("small")})
    found = rules.evaluate(frame, "id", [later, rule], e)
    assert {r["id"]: r["status"] for r in found.where("rule_id = 'R'").collect()} == {"a": "PASS", "b": "UNCERTAIN", "c": "NOT_APPLICABLE", "d": "UNCERTAIN", "e": "EXEMPTED", "f": "ENGINE_ERROR", "g": "FAIL"}
    assert {r["id"]: r["overall_status"] for r in rules.overall(found.where("rule_id = 'R'"), "id").collect()}["f"] == "ENGINE_ERROR"
    assert {r["id"]: r["status"] for r in found.where("rule_id = 'L'").collect()}["a"] == "PASS"
    early = rules.evaluate(frame, "id", [rule], e, F.lit("2025-12-31").cast("date"))
    assert {r["status"] for r in early.collect()} == {"NOT_CONSIDERED"}


def test_validation_and_order():
    bad = [rules.Rule("A", depends_on=["B"], condition={"op": "nope"}), rules.Rule("B", depends_on=["A"], condition={"op": "between", "field": "x"}), rules.Rule("B", effective_from="2026-02-01", effective_to="2026-01-01", condition={"op": "regex", "field": "x", "pattern": "("})]
    assert len(rules.validate(bad)) == 6
    assert [r.rule_id for r in rules.dependency_order([rules.Rule("X", depends_on=["Y"]), rules.Rule("Y")])] == ["Y", "X"]
    with pytest.raises(RuleConfigurationError):
        compile_condition({"op": "in", "field": "x", "values": "abc"}, Evidence({}))


def test_calculations_and_units(spark):
    e = Evidence({}, {"a": F.lit("10"), "z": F.lit("0")})
    row = spark.range(1)
    value = lambda n: row.select(compile_calculation(n, e)[0]).first()[0]
    f, const = lambda k: {"op": "field", "field": k}, lambda v, u=None: {"op": "const", "value": v, "unit": u}
    assert value({"op": "div", "args": [f("a"), f("z")]}) is None and value({"op": "add", "args": [f("a"), f("missing")]}) is None
    assert value({"op": "add", "args": [const(1, "kg"), const(500, "g")]}) == 1.5
    assert value({"op": "percent_diff", "args": [f("a"), const(8)]}) == 25.0
    assert row.select(units.convert(F.lit(1.0), F.lit("kg"), F.lit("l"))).first()[0] is None


def test_text_and_dates(spark):
    row = spark.range(1)
    got = lambda c: row.select(c.alias("x")).first()[0]
    assert got(dates.derived_endpoint(F.lit("2026-03"), F.lit(24), F.lit("months"))) == "2028-03"
    assert got(dates.derived_endpoint(F.lit("2025-01"), F.lit(2), F.lit("years"))) == "2027-01"
    assert got(dates.derived_endpoint(F.lit("2026-05-15"), F.lit(180), F.lit("days"))).startswith("2026-11")
    assert got(dates.derived_endpoint(F.lit("2023-08-29"), F.lit(6), F.lit("months"), True)) == "2024-02-28"
    assert got(dates.consistency(F.lit("2026-03"), F.lit("2028-03"), F.lit(2), F.lit("years"))) == "NONE"
    assert got(dates.consistency(F.lit("2026-03-05"), F.lit("2026-03"), F.lit(1), F.lit("months"))) == "NONE"
    assert got(dates.normalize(F.lit("5/3/26"))) == "2026-03-05" and got(dates.normalize(F.lit("Mar 2026"))) == "2026-03" and got(dates.normalize(F.lit("soon"))) is None
    assert got(text.gtin_valid(F.lit("4006381333931"))) and not got(text.gtin_valid(F.lit("4006381333932")))
    assert not got(text.readings_agree(F.lit("NET QUANTITY 100 g"), F.lit("NET QUANTITY 700 g")))
    assert float(got(text.money(F.lit("MRP ₹1,234.50 incl")))["amount"]) == 1234.5 and got(text.money(F.lit("₹26.67/ml")))["per"] == "ml"
    assert got(text.quantity(F.lit("Net 1,5 kg")))["value"] == 1.5 and got(text.licence_number(F.lit("Lic 12345678901234."))) == "12345678901234"
    assert got(text.json_object(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}' and got(text.json_object(F.lit('{"a": '))) is None


def test_versions_and_store(spark):
    v = spark.createDataFrame([("r", "2024", "2024-01-01", "2026-01-01"), ("r", "2026", "2026-01-01", None)], "rule string, version string, a string, b string").select("rule", "version", F.col("a").cast("date").alias("effective_from"), F.col("b").cast("date").alias("effective_to"))
    rows = spark.createDataFrame([("r", "2025-12-31"), ("r", "2026-01-01")], "rule string, d string").select("rule", F.col("d").cast("date").alias("d"))
    assert sorted(r["version"] for r in relational.as_of_version(rows, v, ["rule"], "d", ["version"]).collect()) == ["2024", "2026"]
    assert relational.interval_overlaps(v, ["rule"]).count() == 0
    assert relational.interval_overlaps(v.withColumn("effective_to", F.lit(None).cast("date")), ["rule"]).count() == 1
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, p string, q string")
    new = spark.createDataFrame([(2, None, "z"), (3, "c", None)], "k int, p string, q string")
    assert sorted(map(tuple, relational.upsert(old, new, ["k"]).collect())) == [(1, "a", "x"), (2, "b", "z"), (3, "c", None)]
    assert [r["k"] for r in relational.insert_absent(old, old.unionByName(new.where("k = 3")), ["k"], ["p"]).collect()] == [3]
    with pytest.raises(Exception, match="immutable"):
        relational.insert_absent(old, new, ["k"], ["p"]).collect()
