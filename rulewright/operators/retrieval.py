"""Hybrid keyword retrieval over a stored inverted index: BM25, TF-IDF cosine and their fusion.

The index is made once and written: postings in files sorted by term, a table of terms with their weights, and
one of chunks with their lengths and norms. A search reads the postings between its least and its greatest
term: row groups outside are skipped.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulewright.functions.text import TOKEN, tokens
from rulewright.sources.scratch import scratch, written

#: TOKEN without its flag, which is Python's default.
PLAIN_TOKEN = TOKEN.removeprefix("(?U)")
#: Postings that a worker gathers at a time.
POSTINGS = 50_000
K1, B = 1.5, 0.75
BM25_SHARE, TFIDF_SHARE = 0.55, 0.45
#: What a chunk of the very rule that a query names gets on top.
NAMED_RULE = 0.5
#: Parts that a term's postings are dealt to where the queries' terms are too many to broadcast.
SALTS = 16


def _counted(batches, key: str):
    """Of each text its distinct terms, how often it has each, and its length; batches of POSTINGS or a text's at most."""
    find = re.compile(PLAIN_TOKEN).findall
    for batch in batches:
        ids, rows, sizes, terms, times, lengths = batch.column(key), [], [], [], [], []

        def made(ids=ids):
            each = lambda of_text, kind: pa.array(np.repeat(np.array(of_text, kind), np.array(sizes, np.int64)))
            return pa.RecordBatch.from_arrays([ids.take(each(rows, np.int64)), pa.array(terms, pa.string()), pa.array(np.array(times, np.int64)), each(lengths, np.int32)], names=[key, "term", "tf", "length"])

        for row, text in enumerate(batch.column("text")):
            if found := find((text.as_py() or "").lower()):
                counts = Counter(found)
                terms += counts.keys()
                times += counts.values()
                rows.append(row)
                sizes.append(len(counts))
                lengths.append(len(found))
            if len(terms) >= POSTINGS:
                yield made()
                rows, sizes, terms, times, lengths = [], [], [], [], []
        yield made()


def postings(chunks: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, term, tf, length): term counts of every chunk, without a shuffle. Counting in the worker takes less time than sorting a chunk's terms in array functions does."""
    kind = chunks.select(key).schema[0].dataType.simpleString()
    return chunks.select(key, text.cast("string").alias("text")).mapInArrow(lambda b: _counted(b, key), f"`{key}` {kind}, term string, tf long, length int")


@dataclass
class Index:
    """Postings (key, term, tf, length) sorted by term, terms (term, df, idf, bm_idf) and norms (key, length, norm), as written tables; chunks with a token, and their mean length."""

    key: str
    postings: DataFrame
    terms: DataFrame
    norms: DataFrame
    n: int
    mean_length: float


def build(chunks: DataFrame, key: str, text: Column, path: str, most: int = 2_000_000) -> Index:
    """Write the index of all chunks under `path`. Null and empty texts have no postings.

    Postings are shuffled once, into files sorted by term. Norms are summed from the chunks again, where a chunk's terms lie
    together; weights of terms of several chunks are broadcast for it if they are `most` at most, else joined.
    """
    spark = chunks.sparkSession
    rows = postings(chunks, key, text)
    # a term's postings go to SALTS files at most, however frequent it is
    rows.repartition("term", F.pmod(F.xxhash64(key), F.lit(SALTS))).sortWithinPartitions("term").write.parquet(f"{path}/postings")
    n = chunks.where(text.rlike(TOKEN)).count()
    df = spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.count("*").alias("df"))
    weights = df.select("term", "df", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1).alias("idf"), F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("bm_idf"))
    weights.write.parquet(f"{path}/terms")
    # terms of one chunk only have one weight, and needn't be looked up
    often = spark.read.parquet(f"{path}/terms").where("df > 1").select("term", "idf")
    met = rows.join(F.broadcast(often) if often.count() <= most else often, "term", "left")
    idf = F.coalesce("idf", F.log(F.lit((1.0 + n) / 2.0)) + 1)
    met.groupBy(key).agg(F.max("length").alias("length"), F.sqrt(F.sum((F.col("tf") * idf) ** 2)).alias("norm")).write.parquet(f"{path}/norms")
    return load(spark, path, key)


def load(spark: SparkSession, path: str, key: str) -> Index:
    """An index that build() wrote."""
    stored, terms, norms = (spark.read.parquet(f"{path}/{t}") for t in ("postings", "terms", "norms"))
    n, mean = norms.agg(F.count("*"), F.avg("length")).first()
    return Index(key, stored, terms, norms, n, float(mean or 0.0))


def requested_rule(query: Column) -> Column:
    """The rule that a query names, as R6 or R6(1); null if it names none."""
    named = r"(?i)\brule\s+(\d+[a-z]?)(?:\s*\((\d+[a-z]?)\))?"
    rule, part = (F.nullif(F.regexp_extract(query, named, i), F.lit("")) for i in (1, 2))
    return F.lower(F.when(rule.isNotNull(), F.concat(F.lit("R"), rule, F.coalesce(F.concat(F.lit("("), part, F.lit(")")), F.lit("")))))


def search_index(index: Index, queries: DataFrame, k: int = 10, most: int = 1_000_000, eligible: DataFrame | None = None) -> DataFrame:
    """Top k chunks of each query (query_id, query): bm25, tfidf and the fused score, rounded to 6 places, ties by key.

    `eligible` (query_id, key, and optionally rule_id) names the chunks that a query may find; frequencies are those of
    all chunks. If a query names a rule that one of its eligible chunks has, only those of that rule are found, half a
    point up. The queries' terms are counted, and broadcast with their weights if they are `most` at most, so that postings are
    read once, filtered by term; else they are joined by term and salt, so that a frequent term isn't one task's.
    """
    key = index.key
    asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf")).join(index.terms, "term")
    asked = written(asked, "asked")
    small = asked.count() <= most
    each = F.broadcast if small else lambda x: x
    if small:
        ends = asked.agg(F.min("term"), F.max("term")).first()
        hits = index.postings.where(F.col("term").between(*map(F.lit, ends))).join(F.broadcast(asked), "term")
    else:
        salted = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = index.postings.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(salted, ["term", "salt"])
    bm = F.col("qtf") * F.col("bm_idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(index.mean_length)))
    scores = hits.groupBy("query_id", key).agg(F.sum(bm).alias("bm25"), F.sum(F.col("tf") * F.col("idf") * F.col("qtf") * F.col("idf")).alias("dot"))
    q_norm = asked.groupBy("query_id").agg(F.sqrt(F.sum((F.col("qtf") * F.col("idf")) ** 2)).alias("q_norm"))
    scored = scores.join(index.norms.select(key, "norm"), key).join(each(q_norm), "query_id").withColumn("tfidf", F.col("dot") / (F.col("norm") * F.col("q_norm")))
    named = F.lit(False)
    if eligible is not None:
        rules = [c for c in ("rule_id",) if c in eligible.columns]
        scored = scored.join(eligible.select("query_id", key, *rules), ["query_id", key])
        if rules:
            named = F.coalesce(F.lower("rule_id") == F.col("wanted"), F.lit(False))
            scored = scored.join(queries.select("query_id", requested_rule(F.col("query")).alias("wanted")), "query_id")
    # written once: a hit is far smaller than its postings, and is read for the greatest scores and for the ranks
    scored = written(scored.withColumn("named", named).select("query_id", key, "bm25", "tfidf", "named"), "scored")
    tops = scored.groupBy("query_id").agg(F.max("bm25").alias("top_bm25"), F.max("tfidf").alias("top_tfidf"), F.max("named").alias("any_named"))
    best = lambda c: F.coalesce(F.try_divide(F.col(c), F.col(f"top_{c}")), F.lit(0.0))
    fused = scored.join(each(tops), "query_id").where(F.col("named") | ~F.col("any_named"))
    fused = fused.withColumn("score", F.round(BM25_SHARE * best("bm25") + TFIDF_SHARE * best("tfidf") + F.when(F.col("named"), NAMED_RULE).otherwise(0.0), 6))
    # the best k of each part of a query's hits first, so that no query's hits are all one task's
    part = Window.partitionBy("query_id", F.pmod(F.xxhash64(key), F.lit(SALTS))).orderBy(F.col("score").desc(), key)
    fused = fused.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k)
    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), key)))
    return ranked.where(F.col("rank") <= k).select("query_id", key, F.round("bm25", 6).alias("bm25"), F.round("tfidf", 6).alias("tfidf"), "score", "rank")


def search(chunks: DataFrame, key: str, text: Column, queries: DataFrame, k: int = 10, most: int = 1_000_000) -> DataFrame:
    """search_index() over an index of `chunks` that is made for it, in the shared folder."""
    return search_index(build(chunks, key, text, scratch(chunks.sparkSession, "index")), queries, k, most)
