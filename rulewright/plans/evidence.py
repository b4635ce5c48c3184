"""Registered queries over boxes, registries, posts and stores, with SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.functions import similarity, text
from rulewright.operators import cases, joins, localise, spatial, visual
from rulewright.sources import stores

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
    return stores.read_table(spark, f"{sf_dir}/{name}.parquet")


def _boxes(spark, d):
    """An order's lines as boxes of one image."""
    n = F.col("l_linenumber")
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), n.cast("long").alias("region_id"), F.col("l_returnflag").alias("kind"), (n * 10).cast("double").alias("x"), F.lit(0.0).alias("y"), (F.col("l_quantity") * 4).alias("w"), (F.col("l_quantity") + 5).alias("h"), (1 - F.col("l_discount")).alias("confidence"))


def _crowded(spark, d):
    """A supplier's lines as boxes of one image, so that there are few, larger groups."""
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("image_id"), key.alias("region_id"), F.col("l_returnflag").alias("kind"), (F.pmod(key, F.lit(97)) * 10).cast("double").alias("x"), (F.pmod(key, F.lit(89)) * 10).cast("double").alias("y"), (F.col("l_quantity") * 4).alias("w"), (F.col("l_quantity") + 5).alias("h"), (1 - F.col("l_discount")).alias("confidence"))


_BOX_SQL = "SELECT l_orderkey AS image_id, l_linenumber::BIGINT AS region_id, l_linenumber*10.0 AS x, 0.0 AS y, l_quantity*4 AS w, l_quantity+5 AS h FROM lineitem"


@query(f"""WITH b AS ({_BOX_SQL}), m AS (SELECT a.image_id, a.region_id, arg_min(o.region_id, (o.w*o.h, o.region_id)) AS parent FROM b a JOIN b o ON a.image_id=o.image_id AND o.w*o.h > a.w*a.h
 AND greatest(0, least(a.x+a.w, o.x+o.w)-greatest(a.x, o.x)) * greatest(0, least(a.h, o.h)) / (a.w*a.h) >= 0.85 GROUP BY ALL) SELECT b.image_id, b.region_id, m.parent FROM b LEFT JOIN m USING (image_id, region_id)""")
def region_parents(spark, d):
    return spatial.smallest_parent(_boxes(spark, d)).select("image_id", "region_id", "parent")


@query(f"SELECT image_id, min(x)::DOUBLE AS x, min(y)::DOUBLE AS y, (max(x+w)-min(x))::DOUBLE AS w, (max(y+h)-min(y))::DOUBLE AS h, count(*) AS n FROM ({_BOX_SQL}) GROUP BY image_id")
def block_hulls(spark, d):
    return spatial.hulls(_boxes(spark, d), ["image_id"])


@query()
def suppressed_regions(spark, d):
    return spatial.suppress_overlaps(_crowded(spark, d)).select("image_id", "region_id")


@query()
def fused_readings(spark, d):
    text = F.concat(F.lit("Lot "), (F.col("region_id") % 2).cast("string"))
    return spatial.fuse_readings(_crowded(spark, d).select("image_id", text.alias("text"), "x", "y", "w", "h", "confidence", F.col("kind").alias("source")))


@query()
def assigned_fields(spark, d):
    score = F.pmod(F.xxhash64("value_id", "field"), F.lit(1000)) / 1000
    fields = F.explode(F.array(*map(F.lit, ("mrp", "batch", "expiry")))).alias("field")
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("value_id")
    rows = _t(spark, d, "lineitem").select("l_suppkey", key, fields)
    return spatial.assign_one_to_one(rows.select(F.col("l_suppkey").alias("image_id"), "field", "value_id", score.alias("score")))


_RANGES = "(VALUES (0, 99, 'A'), (100, 449, 'B'), (500, 999, 'C'))"


@query(f"SELECT o_orderkey, label FROM orders LEFT JOIN {_RANGES} t(low, high, label) ON o_orderkey % 1000 BETWEEN low AND high")
def prefix_ranges(spark, d):
    ranges = spark.sql(f"SELECT * FROM {_RANGES} AS t(low, high, label)")
    rows = _t(spark, d, "orders").select("o_orderkey")
    code = F.concat(F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"), F.lit("0000000000"))
    return joins.prefix_range_join(rows, code, ranges)


@query("SELECT p_partkey, CASE WHEN contains(lower(p_type),'brass') THEN 'Brass' WHEN contains(lower(p_type),'s') THEN 'Other S' ELSE 'none' END AS place FROM part")
def first_place_match(spark, d):
    return _t(spark, d, "part").select("p_partkey", joins.first_place(F.col("p_type"), [("brass", "Brass"), ("s", "Other S")], "none").alias("place"))


@query("""SELECT s_suppkey, CASE WHEN c_custkey IS NULL THEN 'NOT_FOUND' WHEN list_has_any(string_split(regexp_replace(lower(s_name),'[^a-z0-9]+',' ','g'),' ').list_filter(lambda w: length(w)>2),
 string_split(regexp_replace(lower(c_name),'[^a-z0-9]+',' ','g'),' ').list_filter(lambda w: length(w)>2)) THEN 'MATCH' ELSE 'NAME_DIFFERS' END AS outcome FROM supplier LEFT JOIN customer ON c_custkey = CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey + 1000000 WHEN s_suppkey % 3 = 1 THEN s_suppkey ELSE s_suppkey + 1 END""")
def registry_outcomes(spark, d):
    key = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey") + 1_000_000).when(F.col("s_suppkey") % 3 == 1, F.col("s_suppkey")).otherwise(F.col("s_suppkey") + 1)
    claims = _t(spark, d, "supplier").select("s_suppkey", "s_name", key.alias("c_custkey"))
    return joins.registry_match(claims, _t(spark, d, "customer"), "c_custkey", "s_name", "c_name").select("s_suppkey", "outcome")


@query("SELECT o_orderkey, line, round(confidence, 6) AS confidence FROM orders LEFT JOIN (SELECT l_orderkey, any_value(l_linenumber) line, any_value(1-l_discount)*0.6 confidence FROM lineitem WHERE l_returnflag='R' GROUP BY 1 HAVING count(*)=1) ON l_orderkey=o_orderkey")
def only_candidates(spark, d):
    found = _t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("line"), (1 - F.col("l_discount")).alias("confidence"))
    return joins.only_candidate(_t(spark, d, "orders").select("o_orderkey"), found, ["o_orderkey"], "line", "confidence").select("o_orderkey", "line", F.round("confidence", 6).alias("confidence"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, round(l_discount*10, 6) AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(l_discount*10, 6) DESC, l_linenumber) n FROM (SELECT l_orderkey, l_linenumber, max(l_discount) AS l_discount FROM lineitem GROUP BY ALL))
 SELECT l_orderkey, max(l_linenumber) FILTER (n=1) AS l_linenumber, max(score) FILTER (n=1) AS score, round(max(score) FILTER (n=1) - coalesce(max(score) FILTER (n=2), 0), 6) AS lead, CASE WHEN max(score) FILTER (n=1) >= 0.7 THEN 'VERIFIED' WHEN max(score) FILTER (n=1) >= 0.3 THEN 'AMBIGUOUS' ELSE 'NONE' END AS status FROM r GROUP BY 1""")
def best_pairs(spark, d):
    scored = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_discount") * 10, 6).alias("score"))
    return joins.best_pair(scored, ["l_orderkey"], "score", "l_linenumber").withColumn("lead", F.round("lead", 6))


@query("SELECT o_orderpriority, array_to_string(list_sort(list(DISTINCT version)), ',') AS versions FROM orders JOIN (VALUES ('F','v1',NULL,TIMESTAMP '1995-06-01'),('F','v2',TIMESTAMP '1995-06-01',NULL),('O','v3',TIMESTAMP '1996-01-01',NULL)) t(k,version,a,b) ON k=o_orderstatus AND (a IS NULL OR a<=o_orderdate) AND (b IS NULL OR o_orderdate<b) GROUP BY 1")
def amendment_impact(spark, d):
    chunks = spark.sql("SELECT k AS o_orderstatus, version, a::timestamp_ntz AS effective_from, b::timestamp_ntz AS effective_to FROM (VALUES ('F','v1',NULL,TIMESTAMP '1995-06-01'),('F','v2',TIMESTAMP '1995-06-01',NULL),('O','v3',TIMESTAMP '1996-01-01',NULL)) AS t(k,version,a,b)")
    changes = _t(spark, d, "orders").select("o_orderstatus", "o_orderpriority", F.col("o_orderdate").alias("change_date"))
    return joins.impact(joins.changes_in_force(changes, F.broadcast(chunks), ["o_orderstatus"]), ["o_orderpriority"], ["version"]).select("o_orderpriority", F.array_join("version", ",").alias("versions"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 AND p_brand='Brand#11' THEN 'CLOSED' ELSE p_brand END AS state FROM part")
def compare_and_set(spark, d):
    rows = _t(spark, d, "part").select("p_partkey", "p_size", F.col("p_brand").alias("state"))
    return stores.compare_and_set(rows, F.col("p_size") > 25, "state", "Brand#11", "CLOSED").select("p_partkey", "state")


@query("SELECT c_custkey, CASE WHEN c_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey % 50 = 0) THEN c_custkey % 50 = 0 ELSE c_acctbal > 0 END AS flag FROM customer")
def exclusive_flag(spark, d):
    rows = _t(spark, d, "customer").select("c_custkey", "c_nationkey", (F.col("c_acctbal") > 0).alias("flag"))
    return stores.exclusive_flag(rows, "c_nationkey", "flag", F.col("c_custkey") % 50 == 0).select("c_custkey", "flag")


def _has(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


_CATEGORY = f"CASE WHEN NOT {_has(cases.RELEVANT)} THEN '{cases.NOISE}' " + " ".join(f"WHEN {_has(w)} THEN '{c}'" for c, w in cases.CATEGORIES) + f" ELSE '{cases.OTHER}' END"
_CITY = "CASE " + " ".join(f"WHEN contains(lower(text || ' ' || coalesce(source, '')), '{k}') THEN '{n}'" for k, n in cases.CITIES) + " ELSE 'Unspecified' END"


def _posts(spark, d):
    media = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("photo"))).otherwise(F.array().cast("array<string>"))
    return _t(spark, d, "documents").select(F.col("doc_id").alias("raw_id"), "text", media.alias("media"), F.array().cast("array<string>").alias("authorities"), F.col("n_chars").alias("followers"), F.col("source").alias("location"))


@query(f"""WITH c AS (SELECT doc_id AS raw_id, md5(lower(trim(text))) AS h, n_chars, doc_id % 3 = 0 AS has, {_CITY} AS city, {_CATEGORY} AS category, {_has(cases.SCALE_WORDS)} OR {_has(cases.BILL_WORDS)} AS strong FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM documents)),
 v AS (SELECT *, count(*) OVER (PARTITION BY city, category) AS volume, min(raw_id) OVER (PARTITION BY h) AS first_id FROM c),
 s AS (SELECT *, greatest(10, least(99, 40 + CASE WHEN category IN ('FSSAI Unlicensed / Quality Hazard', 'Expired / Tampered Date') THEN 28 WHEN category = 'Counterfeit Packaging / Tampering' THEN 25 WHEN category = '{cases.NOISE}' THEN 10 ELSE 20 END
 + CASE WHEN category IN ('Overcharging / Dual MRP', 'Underweight / Shortage', 'Expired / Tampered Date') THEN 15 ELSE 0 END + CASE WHEN has THEN 15 ELSE 0 END + CASE WHEN has AND strong THEN 8 ELSE 0 END + CASE WHEN volume > 1 THEN least(volume * 6, 18) ELSE 0 END + CASE WHEN n_chars > 10000 THEN 5 ELSE 0 END)) AS score FROM v)
 SELECT raw_id, city, category, first_id, raw_id <> first_id AS is_duplicate, score::INT AS score, CASE WHEN score >= 82 THEN 'CRITICAL' WHEN score >= 65 THEN 'HIGH' WHEN score >= 45 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM s""")
def post_triage(spark, d):
    return cases.process(_posts(spark, d)).select("raw_id", "city", "category", "first_id", "is_duplicate", "score", "severity")


@query(f"SELECT city, category, count(*) AS posts FROM (SELECT {_CITY} AS city, {_CATEGORY} AS category FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM documents)) GROUP BY ALL")
def post_summary(spark, d):
    return cases.summary(cases.process(_posts(spark, d))).select("city", "category", "posts")


@query("SELECT event_id, props AS object FROM events")
def reply_objects(spark, d):
    reply = F.concat(F.lit("Here it is: "), "props", F.lit(' or {"b": 2} }'))
    return _t(spark, d, "events").select("event_id", text.json_object(reply).alias("object"))


@query()
def part_name_similarity(spark, d):
    part = _t(spark, d, "part")
    following = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.upper("p_name").alias("read"))
    return similarity.compare_values(part.select("p_partkey", F.col("p_name").alias("stated")).join(following, "p_partkey"), "stated", "read")


_SIZED_LOOKS = """h AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c AS (SELECT vec_id, label, x, list_transform(x, lambda v: v - list_sum(x) / 64) AS d FROM h),
p AS (SELECT q.vec_id AS query_id, q.label AS q_label, c.vec_id, c.label, round(1 - len(list_filter(range(1, 65), lambda i: (c.x[i] > 0) <> (q.x[i] > 0))) / 64, 9) AS hash_score, round(least(greatest((list_sum(list_transform(range(1, 65), lambda i: c.d[i] * q.d[i])) / sqrt(list_sum(list_transform(c.d, lambda v: v * v)) * list_sum(list_transform(q.d, lambda v: v * v))) + 1) / 2, 0), 1), 9) AS histogram_score FROM c JOIN c q ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
"""
_RANKED = """s AS (SELECT *, round(0.65::DOUBLE * hash_score + (1 - 0.65::DOUBLE) * histogram_score, 6) AS score FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hash_score DESC, histogram_score DESC, vec_id) AS rank FROM s WHERE score >= {least})"""
_LOOKS = """h AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x, len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AS finite FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL)) = 0),
c AS (SELECT *, list_transform(x, lambda v: v - list_sum(x) / len(x)) AS d FROM h),
p AS (SELECT q.vec_id AS query_id, c.vec_id, c.label, round(1 - len(list_filter(range(1, len(c.x) + 1), lambda i: (c.x[i] > 0) <> (q.x[i] > 0))) / len(c.x), 9) AS hash_score, CASE WHEN c.finite AND q.finite THEN round(least(greatest((list_sum(list_transform(range(1, len(c.x) + 1), lambda i: c.d[i] * q.d[i])) / sqrt(list_sum(list_transform(c.d, lambda v: v * v)) * list_sum(list_transform(q.d, lambda v: v * v))) + 1) / 2, 0), 1), 9) ELSE 0 END AS histogram_score FROM c JOIN c q ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.x) = len(q.x)),
"""


def _looks(rows):
    items = visual.prepared(rows, "vec_id", visual.bits(F.col("embedding")), F.col("embedding"), "label")
    return items, items.where("vec_id % 100 = 0")


@query(f"WITH {_LOOKS}{_RANKED.format(least=0.55)} SELECT query_id, vec_id, label, score, hash_score, round(histogram_score, 6) AS histogram_score, rank::INT AS rank FROM r WHERE rank <= 5")
def similar_looks(spark, d):
    return visual.similar(*_looks(_t(spark, d, "embeddings")), "vec_id", None).withColumn("histogram_score", F.round("histogram_score", 6))


@query(f"WITH {_SIZED_LOOKS}{_RANKED.format(least=0.6)} SELECT query_id, q_label AS label, vec_id, label AS other_price, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM r WHERE rank <= 5 AND label IS NOT NULL) WHERE n = 1 AND abs(q_label - label) > 0.01")
def price_changes(spark, d):
    # its SQL takes vectors of 64 finite components
    finite = F.forall("embedding", lambda x: F.abs(x) < float("inf"))
    return visual.price_changes(*_looks(_t(spark, d, "embeddings").where("size(embedding) = 64").where(finite)), "vec_id", 64, "label", least=0.6)


@query("""WITH e AS (SELECT o_orderkey AS face, o_custkey % 50 + 1 AS n, (o_orderkey%5*40)::DOUBLE AS x, (o_custkey%5*40)::DOUBLE AS y FROM orders),
c AS (SELECT l_orderkey AS face, min(l_orderkey*10+l_linenumber) AS id, l_quantity::INT AS n, (l_partkey%9*30)::DOUBLE AS x, (l_suppkey%7*30)::DOUBLE AS y, (40+l_partkey%3*20)::DOUBLE AS w FROM lineitem GROUP BY ALL),
g AS (SELECT e.face, c.id, e.n AS en, c.n AS cn, greatest(0, least(e.x+60, c.x+c.w)-greatest(e.x, c.x))*greatest(0, least(e.y, c.y)+20-greatest(e.y, c.y)) AS both_, 1200+c.w*20 AS sum_, least(1200, c.w*20)/greatest(1200, c.w*20) AS size, sqrt((e.x+30-c.x-c.w/2)**2+(e.y-c.y)**2)/500 AS far FROM e JOIN c USING (face)),
p AS (SELECT *, 0.4::DOUBLE*(both_/(sum_-both_)) + 0.4::DOUBLE*greatest(0, 1-least(1, far)*2.5::DOUBLE) + 0.2::DOUBLE*size AS place FROM g),
s AS (SELECT face, id, round(CASE WHEN en=cn THEN least(1, least(1, place+0.25::DOUBLE)+0.3::DOUBLE) ELSE least(1, place+0.125::DOUBLE)*0.7::DOUBLE END, 9) AS score FROM p),
r AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS next FROM s WINDOW w AS (PARTITION BY face ORDER BY score DESC, id))
SELECT o_orderkey AS face_id, id AS candidate_id, round(score, 6) AS score, round(next, 6) AS runner_up, CASE WHEN score >= 0.7 AND NOT coalesce(score-next < 0.05 AND score < 0.85, false) THEN 'VERIFIED' WHEN score >= 0.3 THEN 'AMBIGUOUS' ELSE 'UNLOCALIZED' END AS status FROM orders LEFT JOIN r ON face=o_orderkey AND k=1""")
def located_values(spark, d):
    k, size = F.col("o_orderkey"), [F.lit(60).alias("w"), F.lit(20).alias("h"), F.lit(400).alias("width"), F.lit(300).alias("height")]
    stated = _t(spark, d, "orders").select(k.alias("evidence_id"), k.alias("face_id"), F.lit("net_quantity").alias("field"), F.concat(F.lit("Qty "), (F.col("o_custkey") % 50 + 1).cast("string")).alias("text"), (k % 5 * 40).alias("x"), (F.col("o_custkey") % 5 * 40).alias("y"), *size)
    shown = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("face_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat(F.lit("qty: "), F.col("l_quantity").cast("int").cast("string")).alias("text"), (F.col("l_partkey") % 9 * 30).alias("x"), (F.col("l_suppkey") % 7 * 30).alias("y"), (40 + F.col("l_partkey") % 3 * 20).alias("w"), F.lit(20).alias("h"))
    shown = shown.groupBy("face_id", "text", "x", "y", "w", "h").agg(F.min("id").alias("candidate_id"))
    return localise.locate(stated, shown).drop("evidence_id", "field")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
