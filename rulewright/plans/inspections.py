"""Registered queries of the statutory checks, lifecycles and filters, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.operators import lifecycle, statutory
from rulewright.operators.statutory import Requirement

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RETAIL = [
    Requirement("mrp"), Requirement("net_quantity"), Requirement("common_name"), Requirement("mfg_date"), Requirement("country_of_origin", "imported_product"),
    Requirement("best_before_use_by", "pan_masala"), Requirement("dimensions", "commodity_dimensions_are_relevant"),
]
WHOLESALE = [Requirement("common_name"), Requirement("net_quantity")]
_LINE_FIELDS = ["mrp", "net_quantity", "common_name", "mfg_date", "batch_no", "standard_pack_size", "country_of_origin"]


def packages(spark: SparkSession, d: str) -> DataFrame:
    """Orders as packages."""
    goods = F.element_at(F.array(*map(F.lit, ("food", "Cement", "pan_masala", "fast_food"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    sale = F.element_at(F.array(*map(F.lit, ("retail", "wholesale", "e-commerce", "Retail", "industrial", "export", "ecommerce"))), (F.col("o_orderkey") % 7 + 1).cast("int"))
    unit = F.element_at(F.array(*map(F.lit, ("kg", "Grams", "L"))), (F.col("o_custkey") % 3 + 1).cast("int"))
    return _t(spark, d, "orders").select(
        F.col("o_orderkey").alias("package_id"), sale.alias("sale_type"), goods.alias("category"), F.nullif(F.col("o_custkey") % 50, F.lit(0)).cast("double").alias("quantity"), unit.alias("quantity_unit"),
        (F.col("o_orderstatus") == "P").alias("is_export_only"), F.when(F.col("o_orderstatus") == "O", 2).otherwise(1).alias("bundle_count"), (F.col("o_orderstatus") == "F").alias("packed_by_restaurant"),
        (F.col("o_orderkey") % 5 == 0).alias("check_registration"), F.create_map(F.lit("is_imported"), F.col("o_orderstatus") == "F").alias("flags"),
    )


def readings(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as readings of the field of their number."""
    return _t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("package_id"), F.try_element_at(F.array(*map(F.lit, _LINE_FIELDS)), F.col("l_linenumber")).alias("field"),
        F.round(1 - F.col("l_tax") * 8, 6).alias("confidence"), F.when(F.col("l_returnflag") == "R", " ").otherwise(F.col("l_returnflag")).alias("value"),
        F.when(F.col("l_returnflag") != "A", F.col("l_extendedprice")).alias("number"), F.when(F.col("l_linestatus") == "O", "2026-01").alias("normalized"),
        (F.col("l_linestatus") == "F").alias("observed"), F.when(F.col("l_discount") > 0.08, "CONFLICTING").otherwise("CORROBORATED").alias("agreement"),
    )


def captures(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as captures of the package."""
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("package_id"), F.when(F.col("l_linestatus") == "O", "USABLE").otherwise("BLURRED").alias("quality"), F.round(F.col("l_discount") * 10, 6).alias("evidence_coverage"), (F.col("l_tax") < 0.02).alias("has_pdp"))


def _inspected(spark: SparkSession, d: str) -> DataFrame:
    return statutory.inspect(packages(spark, d), readings(spark, d), captures(spark, d), RETAIL, WHOLESALE)


_SCOPE = """p AS (SELECT o_orderkey AS package_id, ['retail','wholesale','ecommerce','retail','industrial','export','ecommerce'][o_orderkey % 7 + 1] AS sale, ['retail','wholesale','e-commerce','retail','industrial','export','ecommerce'][o_orderkey % 7 + 1] AS raw_sale,
 ['food','cement','pan masala','fast food'][o_orderkey % 4 + 1] AS goods, nullif(o_custkey % 50, 0) AS q, ['kg','g','l'][o_custkey % 3 + 1] AS unit, o_orderstatus AS st FROM orders),
k AS (SELECT *, CASE WHEN sale='industrial' THEN 'industrial_or_institutional_direct_sale' WHEN st='P' AND sale='export' THEN 'export_only_transaction' WHEN q IS NULL THEN 'quantity_not_established'
 WHEN unit='kg' AND q > CASE goods WHEN 'cement' THEN 50 ELSE 25 END OR unit='l' AND q > 25 THEN 'rule_3_quantity_exclusion' WHEN unit='g' AND q <= 10 AND goods <> 'pan masala' THEN 'rule_26_small_pack'
 WHEN sale='wholesale' THEN 'different_declaration_regime' END AS kind FROM p),
s AS (SELECT *, coalesce(kind IN ('industrial_or_institutional_direct_sale','export_only_transaction','rule_3_quantity_exclusion','rule_26_small_pack'), false) AS is_exempt FROM k)"""
_FACTS = f"""{_SCOPE},
l AS (SELECT l_orderkey AS package_id, ['mrp','net_quantity','common_name','mfg_date','batch_no','standard_pack_size','country_of_origin'][l_linenumber] AS field, round(1 - l_tax * 8, 6) AS conf, nullif(l_returnflag, 'R') AS v,
 CASE WHEN l_returnflag <> 'A' THEN l_extendedprice END AS num, l_linestatus = 'O' AS dated, l_linestatus = 'F' AS seen, l_discount > 0.08 AS conflict FROM lineitem),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY package_id, field ORDER BY conf DESC, coalesce(v, ' ') DESC, num DESC NULLS LAST, dated DESC, seen DESC, conflict ASC) AS n FROM l WHERE field IS NOT NULL) WHERE n = 1),
c AS (SELECT l_orderkey AS package_id, coalesce(max(round(l_discount * 10, 6)) FILTER (l_linestatus = 'O') >= 0.7, false) AS enough, bool_or(l_tax < 0.02) AS pdp FROM lineitem GROUP BY 1),
b AS (SELECT s.*, coalesce(enough, false) AS enough, coalesce(pdp, false) AS pdp FROM s LEFT JOIN c USING (package_id)),
w AS (SELECT b.*, x.field, x.unknown FROM b JOIN (VALUES ('retail','mrp',false),('retail','net_quantity',false),('retail','common_name',false),('retail','mfg_date',false),('retail','country_of_origin',false),('retail','best_before_use_by',true),('wholesale','common_name',false),('wholesale','net_quantity',false)) x(regime, field, unknown)
 ON raw_sale = regime AND NOT is_exempt AND (x.field <> 'country_of_origin' OR st = 'F')),
f AS (SELECT package_id, '__scope__' AS field, CASE WHEN is_exempt THEN 'EXEMPT' ELSE 'UNCERTAIN' END AS status, false AS conflict FROM s WHERE is_exempt OR kind = 'quantity_not_established'
 UNION ALL SELECT w.package_id, w.field, CASE WHEN v IS NOT NULL THEN CASE WHEN conf >= 0.55 AND (w.field <> 'mrp' OR num IS NOT NULL) AND (w.field <> 'mfg_date' OR dated) THEN 'PASS' ELSE 'UNCERTAIN' END
  WHEN coalesce(seen, false) OR unknown OR NOT enough THEN 'UNCERTAIN' ELSE 'FAIL' END, coalesce(conflict, false) FROM w LEFT JOIN r ON r.package_id = w.package_id AND r.field = w.field
 UNION ALL SELECT package_id, 'batch_no', CASE WHEN conf >= 0.55 THEN 'PASS' ELSE 'UNCERTAIN' END, conflict FROM b JOIN r USING (package_id) WHERE NOT is_exempt AND sale = 'retail' AND r.field = 'batch_no' AND v IS NOT NULL
 UNION ALL SELECT package_id, 'multipack_inner_declarations', 'UNCERTAIN', false FROM b WHERE NOT is_exempt AND sale = 'retail' AND st = 'O'
 UNION ALL SELECT b.package_id, 'standard_pack_size', CASE WHEN v IS NOT NULL THEN 'PASS' ELSE 'UNCERTAIN' END, coalesce(conflict, false) FROM b LEFT JOIN r ON r.package_id = b.package_id AND r.field = 'standard_pack_size' WHERE NOT is_exempt AND sale IN ('retail', 'wholesale')
 UNION ALL SELECT package_id, 'repack_or_relabel_before_india_sale', 'FAIL', false FROM b WHERE NOT is_exempt AND st = 'P' AND raw_sale IN ('retail', 'wholesale', 'ecommerce')
 UNION ALL SELECT package_id, 'fast_food_exemption', CASE WHEN st = 'F' THEN 'EXEMPT' ELSE 'UNCERTAIN' END, false FROM b WHERE NOT is_exempt AND goods = 'fast food'
 UNION ALL SELECT package_id, 'registration_number', 'UNCERTAIN', false FROM b WHERE NOT is_exempt AND package_id % 5 = 0
 UNION ALL SELECT b.package_id, 'advertisement_net_quantity', CASE WHEN n.v IS NOT NULL THEN 'PASS' ELSE 'FAIL' END, coalesce(n.conflict, false) FROM b JOIN r m ON m.package_id = b.package_id AND m.field = 'mrp' AND m.v IS NOT NULL LEFT JOIN r n ON n.package_id = b.package_id AND n.field = 'net_quantity' WHERE NOT is_exempt AND raw_sale = 'ecommerce'
 UNION ALL SELECT package_id, 'declaration_placement', CASE WHEN pdp THEN 'PASS' ELSE 'UNCERTAIN' END, false FROM b WHERE NOT is_exempt AND sale = 'retail'),
g AS (SELECT package_id, field, CASE WHEN conflict AND status IN ('PASS', 'FAIL') THEN 'UNCERTAIN' ELSE status END AS status FROM f)"""


@query(f"WITH {_SCOPE} SELECT package_id, is_exempt, kind, coalesce(kind = 'quantity_not_established', false) AS review FROM s")
def statutory_scope(spark, d):
    p = packages(spark, d)
    found = statutory.scope(F.col("sale_type"), F.col("category"), F.col("quantity"), F.col("quantity_unit"), F.lit(None).cast("boolean"), F.lit(None).cast("boolean"), F.col("is_export_only"))
    return p.select("package_id", found.alias("s")).select("package_id", "s.is_exempt", "s.kind", "s.review")


@query(f"WITH {_FACTS} SELECT package_id, field, status, status NOT IN ('PASS', 'EXEMPT') AS review_required FROM g")
def statutory_facts(spark, d):
    return statutory.facts_of(_inspected(spark, d)).select("package_id", "field", "status", "review_required")


@query(f"""WITH {_FACTS}, n AS (SELECT package_id, count(*) FILTER (status = 'PASS') AS n_pass, count(*) FILTER (status = 'FAIL') AS n_fail, count(*) FILTER (status = 'UNCERTAIN') AS n_uncertain, count(*) FILTER (status = 'EXEMPT') AS n_exempt FROM g GROUP BY package_id),
z AS (SELECT s.package_id, coalesce(n_pass, 0) AS n_pass, coalesce(n_fail, 0) AS n_fail, coalesce(n_uncertain, 0) AS n_uncertain, coalesce(n_exempt, 0) AS n_exempt FROM s LEFT JOIN n USING (package_id))
SELECT *, CASE WHEN n_fail > 0 THEN 'FAIL' WHEN n_uncertain > 0 THEN 'UNCERTAIN' WHEN n_pass > 0 THEN 'PASS' WHEN n_exempt > 0 THEN 'EXEMPT' ELSE 'UNCERTAIN' END AS overall_status, n_uncertain + n_fail > 0 AS for_review FROM z""")
def statutory_inspection(spark, d):
    return _inspected(spark, d).select("package_id", "n_pass", "n_fail", "n_uncertain", "n_exempt", "overall_status", statutory.review_required(F.col("facts")).alias("for_review"))


@query(f"WITH {_FACTS} SELECT package_id, count(*) FILTER (status = 'PASS') AS verified, count(*) FILTER (status = 'UNCERTAIN') AS for_review, 0::BIGINT AS violations, count(*) AS total FROM g GROUP BY package_id")
def public_docket(spark, d):
    return statutory.docket_counts(statutory.facts_of(_inspected(spark, d)), "package_id", "status")


_STATES = "['DRAFT','EXTRACTED','AI_PARSED','PENDING_REVIEW','APPROVED','SCHEDULED','ACTIVE','SUPERSEDED','REJECTED']"
_ALLOWED = "(VALUES ('DRAFT','EXTRACTED'),('EXTRACTED','AI_PARSED'),('EXTRACTED','PENDING_REVIEW'),('AI_PARSED','PENDING_REVIEW'),('PENDING_REVIEW','APPROVED'),('APPROVED','SCHEDULED'),('ACTIVE','SUPERSEDED'),('DRAFT','REJECTED'),('EXTRACTED','REJECTED'),('AI_PARSED','REJECTED'),('PENDING_REVIEW','REJECTED'),('APPROVED','REJECTED'),('SCHEDULED','REJECTED')) t(a, b)"


def _state(number):
    return F.element_at(F.array(*map(F.lit, lifecycle.TRANSITIONS)), (number % 9 + 1).cast("int"))


@query(f"""SELECT o_orderkey, outcome, CASE WHEN outcome = 'APPLIED' THEN b ELSE a END AS state FROM (SELECT o_orderkey, m.a, m.b, CASE WHEN m.b = 'ACTIVE' AND who IS NULL THEN 'AUTHORITY_MISSING' WHEN m.b = 'ACTIVE' AND m.a = 'SCHEDULED' OR t.a IS NOT NULL THEN 'APPLIED' ELSE 'ILLEGAL' END AS outcome
 FROM (SELECT o_orderkey, {_STATES}[o_orderkey % 9 + 1] AS a, {_STATES}[o_custkey % 9 + 1] AS b, CASE WHEN o_orderstatus = 'F' THEN 'officer' END AS who FROM orders) m LEFT JOIN {_ALLOWED} ON t.a = m.a AND t.b = m.b)""")
def amendment_transitions(spark, d):
    moved = lifecycle.transition(_state(F.col("o_orderkey")), _state(F.col("o_custkey")), F.when(F.col("o_orderstatus") == "F", "officer").otherwise(" "))
    return _t(spark, d, "orders").select("o_orderkey", moved.alias("m")).select("o_orderkey", "m.outcome", "m.state")


@query(f"SELECT o_orderkey, o_orderdate AS effective_from FROM orders WHERE {_STATES}[o_orderkey % 9 + 1] = 'SCHEDULED' AND o_orderdate <= TIMESTAMP '1996-01-01'")
def activation_eligibility(spark, d):
    versions = _t(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("effective_from"), _state(F.col("o_orderkey")).alias("approval_state"))
    return lifecycle.eligible_for_activation(versions, F.expr("TIMESTAMP_NTZ '1996-01-01'")).select("o_orderkey", "effective_from")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderdate <= TIMESTAMP '1996-01-01' AND (o_custkey % 2 = 0 OR TIMESTAMP '1996-01-01' < o_orderdate + INTERVAL 400 DAY) AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'F' AND o_custkey % 5 IN (0, 1)")
def eligible_law_texts(spark, d):
    texts = _t(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("module"), F.col("o_orderstatus").alias("department"), F.lit("India").alias("jurisdiction"), F.col("o_orderdate").alias("effective_from"),
        F.when(F.col("o_custkey") % 2 != 0, F.expr("o_orderdate + INTERVAL '400' DAY")).alias("effective_to"), F.when(F.col("o_orderkey") % 3 == 0, "scheduled").when(F.col("o_orderkey") % 3 == 1, "Active").alias("publication_state"),
        F.when(F.col("o_custkey") % 5 == 0, "Food").when(F.col("o_custkey") % 5 != 1, "cosmetic").alias("commodity"),
    )
    return lifecycle.eligible_texts(texts, F.expr("TIMESTAMP_NTZ '1996-01-01'"), ["1-URGENT", "2-HIGH"], "f", "INDIA", "food").select("o_orderkey")


@query("SELECT c_custkey AS query_id, CASE WHEN count(event_id) > 0 THEN 'GROUNDED' ELSE 'NOT_FOUND' END AS grounding, count(event_id) AS n_hits, coalesce(string_agg(DISTINCT event_type, ',' ORDER BY event_type), '') AS citations, greatest(0, least(1, coalesce(max(value / 100), 0)))::DOUBLE AS confidence FROM customer LEFT JOIN events ON user_id = c_custkey AND value > 50 GROUP BY c_custkey")
def grounded_answers(spark, d):
    hits = _t(spark, d, "events").where("value > 50").select(F.col("user_id").alias("query_id"), (F.col("value") / 100).alias("score"), F.col("event_type").alias("source_reference"))
    return lifecycle.grounded(_t(spark, d, "customer").select(F.col("c_custkey").alias("query_id")), hits).withColumn("citations", F.array_join("citations", ","))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND contains(lower(o_orderpriority), 'high') AND o_custkey % 2 <> 0")
def case_filters(spark, d):
    return lifecycle.optional_filter(_t(spark, d, "orders"), {"o_orderstatus": "f", "o_orderpriority": "ALL"}, {"o_orderpriority": "HIGH"}, F.col("o_custkey") % 2 == 0).select("o_orderkey")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
