"""Registered queries of the rule engine and its analytics, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulewright.functions import dates, geometry, text
from rulewright.operators import relational, retrieval, rules, units
from rulewright.operators.conditions import Evidence, compile_calculation, compile_condition, parse_date

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cell(value, confidence=None, unit=None):
    return F.struct(value.cast("string").alias("value"), F.lit(unit).cast("string").alias("unit"), (F.lit(None).cast("double") if confidence is None else confidence).alias("confidence"), F.lit(None).cast("boolean").alias("present"), F.lit(None).cast("boolean").alias("usable"))


LINE_RULES = [
    rules.Rule("QTY-RANGE", severity="major", requirements=[{"condition": {"op": "between", "field": "qty", "min": 1, "max": 40}}], exemptions=[{"condition": {"op": "eq", "field": "flag", "value": "R"}}]),
    rules.Rule("DISCOUNT", severity="minor", applicability={"op": "eq", "field": "linestatus", "value": "O"}, condition={"op": "lte", "field": "discount", "value": 0.08}),
    rules.Rule("UNIT-PRICE", severity="major", derived=[{"name": "unit", "calc": {"op": "div", "args": [{"op": "field", "field": "price"}, {"op": "field", "field": "quantity"}]}}], condition={"op": "between", "field": "computed.unit", "min": 950, "max": 2000}),
]
_LINE_SQL = """SELECT l_orderkey, u.r AS rule_id, u.s AS status, u.sev FROM (SELECT l_orderkey, unnest([
 {'r':'QTY-RANGE','sev':'major','s':CASE WHEN l_returnflag='R' THEN 'EXEMPTED' WHEN 1 - l_tax*6 < 0.55 THEN 'UNCERTAIN' WHEN l_quantity BETWEEN 1 AND 40 THEN 'PASS' ELSE 'FAIL' END},
 {'r':'DISCOUNT','sev':'minor','s':CASE WHEN l_linestatus<>'O' THEN 'NOT_APPLICABLE' WHEN l_discount<=0.08 THEN 'PASS' ELSE 'FAIL' END},
 {'r':'UNIT-PRICE','sev':'major','s':CASE WHEN l_extendedprice/l_quantity BETWEEN 950 AND 2000 THEN 'PASS' ELSE 'FAIL' END}]) u FROM lineitem)"""


def _lines(spark, d):
    quantity = F.struct(F.col("l_quantity").alias("value"), F.lit(None).cast("string").alias("unit"), (1 - F.col("l_tax") * 6).alias("confidence"), F.lit(None).cast("boolean").alias("present"), F.lit(None).cast("boolean").alias("usable"))
    e = Evidence({"qty": quantity}, {"flag": F.col("l_returnflag"), "linestatus": F.col("l_linestatus"), "discount": F.col("l_discount"), "price": F.col("l_extendedprice"), "quantity": F.col("l_quantity")})
    return _t(spark, d, "lineitem"), "l_orderkey", LINE_RULES, e


@query(f"""SELECT l_orderkey, count(*) FILTER (status='PASS') AS n_pass, count(*) FILTER (status='FAIL') AS n_fail, count(*) FILTER (status='UNCERTAIN') AS n_uncertain,
 count(*) FILTER (status='EXEMPTED') AS n_exempted, count(*) FILTER (status='NOT_APPLICABLE') AS n_not_applicable, CASE WHEN count(*) FILTER (status='FAIL' AND sev='major')>0 OR count(*) FILTER (status='FAIL')>0 THEN 'FAIL'
 WHEN count(*) FILTER (status='UNCERTAIN')>0 THEN 'UNCERTAIN' WHEN count(*) FILTER (status='PASS')>0 THEN 'PASS' ELSE 'NOT_APPLICABLE' END AS overall_status FROM ({_LINE_SQL}) GROUP BY l_orderkey""")
def rule_status_by_order(spark, d):
    return rules.overall_of_subjects(*_lines(spark, d)).select("l_orderkey", "n_pass", "n_fail", "n_uncertain", "n_exempted", "n_not_applicable", "overall_status")


@query(f"SELECT rule_id, status, count(*) AS n FROM ({_LINE_SQL}) GROUP BY ALL")
def rule_status_counts(spark, d):
    return rules.evaluate(*_lines(spark, d)).groupBy("rule_id", "status").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, a, b, CASE WHEN a=0 OR b=0 THEN 0 WHEN a=2 OR b=2 THEN 2 ELSE 1 END AS k_and, CASE WHEN a=1 OR b=1 THEN 1 WHEN a=2 OR b=2 THEN 2 ELSE 0 END AS k_or, CASE a WHEN 2 THEN 2 ELSE 1-a END AS k_not
 FROM (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 2 ELSE (c_custkey % 2)::INT END AS a, CASE WHEN c_nationkey < 8 THEN 2 ELSE c_nationkey % 2 END AS b FROM customer)""")
def k3_truth_table(spark, d):
    flag = lambda unknown, c: F.when(unknown, 2).otherwise(c.cast("int"))
    x = _t(spark, d, "customer").select("c_custkey", flag(F.col("c_acctbal") < 0, F.col("c_custkey") % 2).alias("a"), flag(F.col("c_nationkey") < 8, F.col("c_nationkey") % 2).alias("b"))
    e = Evidence({}, {k: F.when(F.col(k) < 2, F.col(k)) for k in "ab"})
    leaf = [{"op": "boolean", "field": k} for k in "ab"]
    code = lambda c: F.when(c.isNull(), 2).otherwise(c.cast("int"))
    return x.select("c_custkey", "a", "b", *(code(compile_condition(n, e).value).alias(k) for k, n in (("k_and", {"op": "and", "args": leaf}), ("k_or", {"op": "or", "args": leaf}), ("k_not", {"op": "not", "args": leaf[:1]}))))


def _flags(frame, keys, e, **nodes):
    return frame.select(*keys, *(compile_condition(n, e).value.alias(k) for k, n in nodes.items()))


@query("SELECT l_orderkey, l_linenumber, l_quantity BETWEEN 10 AND 20 AS closed, l_quantity > 10 AND l_quantity < 20 AS opened, l_quantity >= 30 AS least FROM lineitem")
def between_bounds(spark, d):
    e = Evidence({}, {"q": F.col("l_quantity")})
    return _flags(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], e, closed={"op": "between", "field": "q", "min": 10, "max": 20}, opened={"op": "between", "field": "q", "min": 10, "max": 20, "min_inclusive": False, "max_inclusive": False}, least={"op": "between", "field": "q", "min": 30})


@query("SELECT p_partkey, p_size > 25 AS gt, p_size >= 25 AS gte, p_size < 25 AS lt, p_size <= 25 AS lte, p_size = 25 AS eq, p_size <> 25 AS neq, abs(p_retailprice - 1000) <= 50 AS near FROM part")
def numeric_predicates(spark, d):
    e = Evidence({}, {"s": F.col("p_size"), "p": F.col("p_retailprice")})
    return _flags(_t(spark, d, "part"), ["p_partkey"], e, **{k: {"op": k, "field": "s", "value": 25} for k in ("gt", "gte", "lt", "lte", "eq", "neq")}, near={"op": "eq", "field": "p", "value": 1000, "tolerance": 50})


@query("SELECT o_orderkey, lower(o_orderpriority) IN ('1-urgent','2-high') AS is_in, lower(o_orderpriority) NOT IN ('1-urgent','2-high') AS is_out FROM orders")
def in_list(spark, d):
    e = Evidence({}, {"p": F.col("o_orderpriority")})
    values = ["1-URGENT", "2-HIGH"]
    return _flags(_t(spark, d, "orders"), ["o_orderkey"], e, is_in={"op": "in", "field": "p", "values": values}, is_out={"op": "not_in", "field": "p", "values": values})


@query("SELECT p_partkey, contains(lower(p_type),'brass') AS has, NOT contains(lower(p_type),'brass') AS lacks, starts_with(lower(p_brand),'brand#1') AS starts, ends_with(lower(p_type),'steel') AS ends, regexp_matches(p_brand,'#[1-3][0-9]') AS matches FROM part")
def text_predicates(spark, d):
    e = Evidence({}, {"t": F.col("p_type"), "b": F.col("p_brand")})
    return _flags(_t(spark, d, "part"), ["p_partkey"], e, has={"op": "contains", "field": "t", "value": "Brass"}, lacks={"op": "not_contains", "field": "t", "value": "BRASS"}, starts={"op": "starts_with", "field": "b", "value": "Brand#1"}, ends={"op": "ends_with", "field": "t", "value": "steel"}, matches={"op": "regex", "field": "b", "value": "#[1-3][0-9]"})


@query("SELECT o_orderkey, o_orderdate::DATE < DATE '1995-03-01' AS is_before, o_orderdate::DATE > DATE '1995-03-01' AS is_after, o_orderdate::DATE <= DATE '1996-01-01' AS until, o_orderdate::DATE >= DATE '1996-01-01' AS since FROM orders")
def date_predicates(spark, d):
    e = Evidence({}, {"d": F.date_format("o_orderdate", "dd/MM/yyyy")})
    node = lambda op, v: {"op": op, "field": "d", "value": v}
    return _flags(_t(spark, d, "orders"), ["o_orderkey"], e, is_before=node("date_before", "1995-03"), is_after=node("date_after", "03/1995"), until=node("date_on_or_before", "1996-01-01"), since=node("date_on_or_after", "01/01/1996"))


@query("SELECT c_custkey, c_acctbal >= 0 AS e_exists, c_acctbal < 0 AS e_missing, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal > 5000 END AS over_5000 FROM customer")
def presence_and_unknown(spark, d):
    e = Evidence({"bal": _cell(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))})
    return _flags(_t(spark, d, "customer"), ["c_custkey"], e, e_exists={"op": "exists", "field": "bal"}, e_missing={"op": "missing", "field": "bal"}, over_5000={"op": "gt", "field": "bal", "value": 5000})


def _calc(frame, keys, e, **nodes):
    return frame.select(*keys, *(F.round(compile_calculation(n, e)[0], 6).alias(k) for k, n in nodes.items()))


@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice + l_quantity, 6) AS added, round(l_extendedprice - l_quantity, 6) AS taken, round(l_extendedprice * l_discount, 6) AS times,
 round(CASE WHEN l_discount=0 THEN NULL ELSE l_extendedprice / l_discount END, 6) AS divided, round((l_extendedprice - 30000) / 30000 * 100, 6) AS diff, round(abs((l_extendedprice - 30000) / 30000 * 100), 6) AS size FROM lineitem""")
def calc_ops(spark, d):
    e = Evidence({}, {"p": F.col("l_extendedprice"), "q": F.col("l_quantity"), "x": F.col("l_discount")})
    f = lambda k: {"op": "field", "field": k}
    diff = {"op": "percent_diff", "args": [f("p"), {"op": "const", "value": 30000}]}
    return _calc(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], e, added={"op": "add", "args": [f("p"), f("q")]}, taken={"op": "sub", "args": [f("p"), f("q")]}, times={"op": "mul", "args": [f("p"), f("x")]}, divided={"op": "div", "args": [f("p"), f("x")]}, diff=diff, size={"op": "abs", "args": [diff]})


@query("SELECT p_partkey, round(p_size * 1000.0 / 1.0, 6) AS kg_to_g, round(p_size * 10.0 / 1000.0, 6) AS cm_to_m, CAST(NULL AS DOUBLE) AS kg_to_l FROM part")
def unit_convert(spark, d):
    size = F.col("p_size").cast("double")
    to = lambda a, b: F.round(units.convert(size, F.lit(a), F.lit(b)), 6)
    return _t(spark, d, "part").select("p_partkey", to("kg", "g").alias("kg_to_g"), to("cm", "m").alias("cm_to_m"), to("kg", "l").alias("kg_to_l"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag='R')")
def review_queue_semi(spark, d):
    flagged = _t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return _t(spark, d, "orders").join(flagged, "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, count(l_orderkey) AS n_lines, coalesce(string_agg(l_returnflag, ',' ORDER BY l_linenumber, l_returnflag), '') AS flags FROM orders LEFT JOIN lineitem ON l_orderkey=o_orderkey GROUP BY o_orderkey")
def detail_nest(spark, d):
    lines = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("lines"))
    return _t(spark, d, "orders").join(lines, "o_orderkey", "left").select("o_orderkey", F.coalesce(F.size("lines"), F.lit(0)).cast("bigint").alias("n_lines"), F.coalesce(F.array_join("lines.l_returnflag", ","), F.lit("")).alias("flags"))


@query("SELECT n_nationkey, count(c.seg) AS satisfied, round(count(c.seg)/5.0, 6) AS coverage FROM nation CROSS JOIN (VALUES ('AUTOMOBILE'),('BUILDING'),('FURNITURE'),('HOUSEHOLD'),('MACHINERY')) s(seg) LEFT JOIN (SELECT DISTINCT c_nationkey, c_mktsegment AS seg FROM customer WHERE c_acctbal > 9000) c ON c.c_nationkey=n_nationkey AND c.seg=s.seg GROUP BY n_nationkey")
def required_missing_left(spark, d):
    wanted = F.array(*map(F.lit, ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")))
    need = _t(spark, d, "nation").select("n_nationkey", F.explode(wanted).alias("seg"))
    have = _t(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("seg"), F.lit(1).alias("met")).distinct()
    return need.join(have, ["n_nationkey", "seg"], "left").groupBy("n_nationkey").agg(F.count("met").alias("satisfied"), F.round(F.count("met") / 5.0, 6).alias("coverage"))


@query("SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders WHERE o_orderstatus='F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def filter_newest_limit(spark, d):
    return _t(spark, d, "orders").where("o_orderstatus = 'F'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "o_orderdate", "o_orderpriority")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (1,2,3)")
def row_security(spark, d):
    return _t(spark, d, "customer").where(F.col("c_nationkey").isin(1, 2, 3)).select("c_custkey", "c_name")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus='F')::INT, o_orderdate DESC, o_orderkey) rn FROM orders) WHERE rn=1")
def latest_per_key_demoted(spark, d):
    return relational.latest_per_key(_t(spark, d, "orders"), ["o_custkey"], F.col("o_orderstatus") == "F", [F.desc("o_orderdate"), "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT n_name, count(*) AS cases, count(*) FILTER (o_orderstatus='F') AS violations, count(*) FILTER (o_orderpriority='1-URGENT') AS high_priority, count(DISTINCT o_custkey) AS retailers FROM orders JOIN customer ON c_custkey=o_custkey JOIN nation ON n_nationkey=c_nationkey GROUP BY n_name")
def regional_rollup(spark, d):
    cases = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return cases.groupBy("n_name").agg(F.count("*").alias("cases"), F.count_if(F.col("o_orderstatus") == "F").alias("violations"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("high_priority"), F.count_distinct("o_custkey").alias("retailers"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 5")
def top5_retailers(spark, d):
    return _t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").limit(5)


@query("SELECT domain, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN l_quantity>25 THEN 'quantity' END, CASE WHEN l_discount>0.05 THEN 'price' END, CASE WHEN l_returnflag='R' THEN 'returns' END], lambda x: x IS NOT NULL)) AS domain FROM lineitem) GROUP BY domain")
def overlapping_domain_counts(spark, d):
    tags = F.array_compact(F.array(F.when(F.col("l_quantity") > 25, "quantity"), F.when(F.col("l_discount") > 0.05, "price"), F.when(F.col("l_returnflag") == "R", "returns")))
    return _t(spark, d, "lineitem").select(F.explode(tags).alias("domain")).groupBy("domain").agg(F.count("*").alias("n"))


@query("""SELECT event_id, least(99, greatest(10, 40 + CASE event_type WHEN 'purchase' THEN 20 WHEN 'click' THEN 5 ELSE 0 END + CASE WHEN value > 50 THEN 15 ELSE 0 END + least(18, 3 * count(*) OVER (PARTITION BY user_id, event_type)))) AS score FROM events""")
def priority_score(spark, d):
    cluster = F.count("*").over(Window.partitionBy("user_id", "event_type"))
    kind = F.when(F.col("event_type") == "purchase", 20).when(F.col("event_type") == "click", 5).otherwise(0)
    return _t(spark, d, "events").select("event_id", F.least(F.lit(99), F.greatest(F.lit(10), 40 + kind + F.when(F.col("value") > 50, 15).otherwise(0) + F.least(F.lit(18), 3 * cluster))).alias("score"))


@query("SELECT l_shipdate::DATE AS day, CASE WHEN count(*)=0 THEN 100 ELSE floor(100.0 * count(*) FILTER (l_returnflag<>'R') / count(*) + 0.5)::BIGINT END AS pct FROM lineitem GROUP BY day")
def score_percentages(spark, d):
    return _t(spark, d, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(F.floor(100.0 * F.count_if(F.col("l_returnflag") != "R") / F.count("*") + 0.5).alias("pct"))


_VERSIONS = "(VALUES ('F','v1',TIMESTAMP '1990-01-01',TIMESTAMP '1995-06-01'),('F','v2',TIMESTAMP '1995-06-01',NULL),('O','v1',TIMESTAMP '1990-01-01',NULL),('O','v3',TIMESTAMP '1996-01-01',NULL))"


def _versions(spark):
    return spark.sql(f"SELECT k AS o_orderstatus, v AS version, a::timestamp_ntz AS effective_from, b::timestamp_ntz AS effective_to FROM {_VERSIONS} AS t(k, v, a, b)")


@query(f"SELECT o_orderkey, version FROM (SELECT o_orderkey, v AS version, row_number() OVER (PARTITION BY o_orderkey ORDER BY a DESC) rn FROM orders JOIN {_VERSIONS} t(k,v,a,b) ON k=o_orderstatus AND o_orderdate>=a AND (b IS NULL OR o_orderdate<b)) WHERE rn=1")
def asof_rule_version(spark, d):
    return relational.as_of_version(_t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate"), F.broadcast(_versions(spark)), ["o_orderstatus"], "o_orderdate", ["version"]).select("o_orderkey", "version")


@query("""SELECT o_custkey, version, pv AS prev_version FROM (SELECT *, lag(version) OVER w AS pv, lag(b) OVER w AS pb, row_number() OVER w AS n FROM (SELECT o_custkey, o_orderkey AS version, o_orderdate::DATE AS a, CASE WHEN o_orderkey % 7 > 0 THEN o_orderdate::DATE + (o_orderkey % 400)::INT END AS b FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY a, version)) WHERE n > 1 AND (pb IS NULL OR a < pb)""")
def interval_overlap_check(spark, d):
    day = F.to_date("o_orderdate")
    versions = _t(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("version"), day.alias("effective_from"), F.when(F.col("o_orderkey") % 7 > 0, F.date_add(day, (F.col("o_orderkey") % 400).cast("int"))).alias("effective_to"))
    return relational.interval_overlaps(versions, ["o_custkey"]).select("o_custkey", "version", "prev_version")


@query("SELECT p_partkey, CASE WHEN p_size<=10 THEN 1.0 WHEN p_size<=25 THEN 2.0 WHEN p_size<=40 THEN 4.0 ELSE 6.0 END::DOUBLE AS min_height FROM part")
def banded_threshold(spark, d):
    return _t(spark, d, "part").select("p_partkey", relational.banded(F.col("p_size"), [(10, 1), (25, 2), (40, 4), (None, 6)]).alias("min_height"))


@query("SELECT l_orderkey, l_linenumber, (((CAST(round(l_extendedprice*100) AS HUGEINT) * 200 + CAST(round(l_quantity*100) AS HUGEINT)) // (2 * CAST(round(l_quantity*100) AS HUGEINT)))::DOUBLE / 100) AS unit_price FROM lineitem")
def unit_price_decimal(spark, d):
    exact = relational.unit_price(F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_quantity").cast("decimal(18,2)"))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", exact.cast("double").alias("unit_price"))


@query("SELECT p_partkey, CASE WHEN p_type LIKE 'PROMO%' THEN 'INDUSTRIAL' WHEN p_size > 45 THEN 'EXEMPT_LARGE' WHEN p_size <= 2 THEN 'EXEMPT_SMALL' WHEN p_brand LIKE 'Brand#5%' THEN 'WHOLESALE' ELSE 'RETAIL' END AS regime FROM part")
def exemption_decision_list(spark, d):
    return _t(spark, d, "part").select("p_partkey", F.when(F.col("p_type").startswith("PROMO"), "INDUSTRIAL").when(F.col("p_size") > 45, "EXEMPT_LARGE").when(F.col("p_size") <= 2, "EXEMPT_SMALL").when(F.col("p_brand").startswith("Brand#5"), "WHOLESALE").otherwise("RETAIL").alias("regime"))


@query("""SELECT l_orderkey, arg_max(l_returnflag, (l_quantity, -l_linenumber, l_returnflag)) AS best_value, max(l_quantity) AS best_confidence, count(DISTINCT l_returnflag) AS n_values, count(*) AS n_readings,
 CASE WHEN count(*)=1 THEN 'SINGLE_SOURCE' WHEN count(DISTINCT l_returnflag)=1 THEN 'CORROBORATED' ELSE 'CONFLICTING' END AS agreement FROM lineitem GROUP BY l_orderkey""")
def best_reading_wins(spark, d):
    return relational.best_reading(_t(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag", "l_quantity", "l_linenumber")


@query("SELECT doc_id, md5(text) AS content_hash, first_value(doc_id) OVER w AS first_id, first_value(doc_id) OVER w <> doc_id AS is_duplicate FROM documents WINDOW w AS (PARTITION BY md5(text) ORDER BY doc_id)")
def first_seen_dedupe(spark, d):
    return relational.first_seen(_t(spark, d, "documents").select("doc_id", "text"), F.col("text"), "doc_id").select("doc_id", "content_hash", "first_id", "is_duplicate")


@query("SELECT p_partkey, round(1 - levenshtein(regexp_replace(lower(p_name),'[^a-z0-9]','','g'), regexp_replace(lower(p_type),'[^a-z0-9]','','g'))::DOUBLE / greatest(length(regexp_replace(lower(p_name),'[^a-z0-9]','','g')), length(regexp_replace(lower(p_type),'[^a-z0-9]','','g'))), 6) AS similarity FROM part")
def levenshtein_agree(spark, d):
    return _t(spark, d, "part").select("p_partkey", F.round(text.text_similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity"))


@query("SELECT doc_id, CASE WHEN contains(lower(text),'license') THEN 'legal' WHEN contains(lower(text),'@') THEN 'contact' WHEN contains(lower(text),'token') THEN 'secret' ELSE 'other' END AS category FROM documents")
def keyword_cascade(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.first_keyword(F.col("text"), [("legal", ["license"]), ("contact", ["@"]), ("secret", ["token"])], "other").alias("category"))


@query(rf"SELECT doc_id, len(regexp_extract_all(text, '{text.EMAIL}')) AS n_emails FROM documents")
def email_extract(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.size(text.emails(F.col("text"))).cast("bigint").alias("n_emails"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_path(spark, d):
    return _t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT doc_id, unnest(range(1, len(parts)+1)) AS chunk, unnest(list_transform(parts, lambda x: length(x))) AS n_chars FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x)<>'') AS parts FROM documents)")
def chunk_paragraphs(spark, d):
    parts = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return _t(spark, d, "documents").select("doc_id", F.posexplode(parts).alias("p", "c")).select("doc_id", (F.col("p") + 1).cast("bigint").alias("chunk"), F.length("c").cast("bigint").alias("n_chars"))


_TOK = r"regexp_extract_all(lower({c}), '[\pL\pN\pM_()/-]+')"
_INDEX = f"""idx AS (SELECT doc_id, term, count(*) tf, any_value(length) length FROM (SELECT doc_id, len(t) length, unnest(t) term FROM (SELECT doc_id, {_TOK.format(c='text')} t FROM documents)) GROUP BY doc_id, term),
st AS (SELECT count(*) n, avg(length) avgdl FROM (SELECT doc_id, any_value(length) length FROM idx GROUP BY doc_id)), df AS (SELECT term, count(*) df FROM idx GROUP BY term),
tm AS (SELECT term, ln(1+(n-df+0.5)/(df+0.5)) bidf, ln((1.0+n)/(1.0+df))+1 idf, avgdl FROM df, st),
q AS (SELECT query_id, term, count(*) qtf FROM (SELECT item_id query_id, unnest({_TOK.format(c='text')}) term FROM benchmark WHERE item_id % 100 = 0) GROUP BY ALL),
nm AS (SELECT doc_id, sqrt(sum((tf*idf)**2)) norm FROM idx JOIN tm USING(term) GROUP BY doc_id), qn AS (SELECT query_id, sqrt(sum((qtf*idf)**2)) qnorm FROM q JOIN tm USING(term) GROUP BY query_id),
sc AS (SELECT query_id, doc_id, sum(qtf*bidf*tf*2.5/(tf+1.5*(0.25+0.75*length/avgdl))) bm25, sum(tf*idf*qtf*idf) dot FROM idx JOIN tm USING(term) JOIN q USING(term) GROUP BY ALL),
f AS (SELECT query_id, doc_id, bm25, dot/(norm*qnorm) tfidf FROM sc JOIN nm USING(doc_id) JOIN qn USING(query_id)),
g AS (SELECT *, round(0.55*bm25/max(bm25) OVER (PARTITION BY query_id)+0.45*tfidf/max(tfidf) OVER (PARTITION BY query_id),6) score FROM f)
SELECT query_id, doc_id, round(bm25,6) bm25, round(tfidf,6) tfidf, score, rank::INT rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) rank FROM g) WHERE rank<=10"""


@query("WITH " + _INDEX)
def hybrid_topk_whole(spark, d):
    asked = _t(spark, d, "benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieval.search(_t(spark, d, "documents"), "doc_id", F.col("text"), asked, 10)


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"


@query(f"SELECT query_id, vec_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rank FROM (SELECT q.vec_id query_id, e.vec_id, round({_DOT.format(a='e.embedding', b='q.embedding')} / sqrt({_DOT.format(a='e.embedding', b='e.embedding')} * {_DOT.format(a='q.embedding', b='q.embedding')}), 6) score FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id)) WHERE rank <= 5")
def knn_cosine_topk(spark, d):
    vectors = _t(spark, d, "embeddings")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return relational.top_similar(vectors, asked, 5).select("query_id", "vec_id", "score", "rank")


@query("""SELECT o_orderkey, ((10 - (list_sum(list_transform(range(1,13), lambda i: CASE WHEN (12-i) % 2 = 0 THEN 3 ELSE 1 END * code[i]::INT)) % 10)) % 10)::INT AS check_digit FROM (SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 12, '0') AS code FROM orders)""")
def gtin_check_digit(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", text.gtin_check_digit(F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("check_digit"))


@query("WITH p AS (SELECT quality=1 AS truth, n_chars>=400 AS guess FROM documents JOIN labels USING(doc_id)) SELECT count(*) FILTER (truth AND guess) AS tp, count(*) FILTER (NOT truth AND guess) AS fp, count(*) FILTER (truth AND NOT guess) AS fn, round(count(*) FILTER (truth AND guess)/count(*) FILTER (guess),6) AS prec, round(count(*) FILTER (truth AND guess)/count(*) FILTER (truth),6) AS recall FROM p")
def precision_recall(spark, d):
    p = _t(spark, d, "documents").select("doc_id", (F.col("n_chars") >= 400).alias("g")).join(_t(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("t")), "doc_id")
    n = p.agg(F.count_if(F.col("t") & F.col("g")).alias("tp"), F.count_if(~F.col("t") & F.col("g")).alias("fp"), F.count_if(F.col("t") & ~F.col("g")).alias("fn"))
    return n.select("tp", "fp", "fn", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6).alias("prec"), F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6).alias("recall"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND p_size > 10 THEN p_retailprice * 2 ELSE p_retailprice END AS price FROM part")
def upsert_coalesce(spark, d):
    old = _t(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("price"))
    new = _t(spark, d, "part").where("p_partkey % 3 = 0").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_retailprice") * 2).alias("price"))
    return relational.upsert(old, new, ["p_partkey"])


@query("SELECT p_partkey FROM part WHERE p_partkey % 4 = 0")
def immutable_append(spark, d):
    part = _t(spark, d, "part").select("p_partkey", "p_brand")
    return relational.insert_absent(part.where("p_partkey % 4 != 0"), part, ["p_partkey"], ["p_brand"]).select("p_partkey")


@query("SELECT s_suppkey AS k, 'extra' AS side FROM supplier WHERE s_suppkey % 5 = 0 AND s_suppkey % 2 <> 0 UNION ALL SELECT s_suppkey, 'missing' FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 5 <> 0")
def set_diff_versions(spark, d):
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    return relational.set_difference(s.where("k % 5 = 0"), s.where("k % 2 = 0"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'REF_NOT_OBSERVED' WHEN p_size > 40 THEN 'INSP_NOT_OBSERVED' WHEN p_size % 7 = 0 THEN 'DIFFERENT' ELSE 'MATCH' END AS outcome FROM part")
def integrity_full_outer(spark, d):
    part = _t(spark, d, "part")
    ref = part.where("p_size >= 10").select("p_partkey", F.col("p_brand").alias("v"))
    seen = part.where("p_size <= 40").select("p_partkey", F.when(F.col("p_size") % 7 == 0, "other").otherwise(F.col("p_brand")).alias("v"))
    return relational.outer_compare(ref, seen, ["p_partkey"], "v").select("p_partkey", "outcome")


@query("SELECT o_orderkey, strftime(o_orderdate::DATE + INTERVAL 24 MONTH, '%Y-%m') AS ends, 24.0::DOUBLE AS months FROM orders")
def derived_endpoint(spark, d):
    start = F.date_format("o_orderdate", "yyyy-MM")
    end = dates.derived_endpoint(start, F.lit(2), F.lit("years"))
    return _t(spark, d, "orders").select("o_orderkey", end.alias("ends"), dates.implied_months(start, end).alias("months"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS normal, o_orderdate::DATE AS parsed FROM orders")
def normalize_dates(spark, d):
    form = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return _t(spark, d, "orders").select("o_orderkey", dates.normalize(form).alias("normal"), parse_date(form).alias("parsed"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0.05 AND l_linestatus='O' THEN 'UNCERTAIN' WHEN l_discount <= 0.05 THEN 'PASS' ELSE 'FAIL' END AS status FROM lineitem")
def agreement_cap(spark, d):
    status = F.when(F.col("l_discount") <= 0.05, "PASS").otherwise("FAIL")
    state = F.when((F.col("l_tax") > 0.05) & (F.col("l_linestatus") == "O"), "CONFLICTING").otherwise("CORROBORATED")
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", relational.capped_status(status, state).alias("status"))


@query("SELECT l_orderkey, l_linenumber, round(coalesce(greatest(0, least(l_quantity+10, 35)-greatest(l_quantity,20)) * 10 / nullif(100 + 150 - greatest(0, least(l_quantity+10, 35)-greatest(l_quantity,20)) * 10, 0), 0), 6)::DOUBLE AS iou FROM lineitem")
def iou_pairs(spark, d):
    box = lambda x, w: F.struct(x.cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(float(w)).alias("w"), F.lit(10.0).alias("h"))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(geometry.iou(box(F.col("l_quantity"), 10), box(F.lit(20), 15)), 6).alias("iou"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
