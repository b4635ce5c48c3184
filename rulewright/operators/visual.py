"""Images that look alike: the bits of a perceptual hash, and the correlation of histograms; and price differences among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulewright.operators import nearest

HASH_SHARE, LEAST, VERY = 0.65, 0.55, 0.88
#: Queries that are compared at a time, and parts that a query's matches are ranked in first.
BLOCK, PARTS = 20_000, 16


def bits(values: Column) -> Column:
    """A hash of 64 bits a long: of each value whether it is over 0."""
    words = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / 64).cast("int"))
    one = lambda k: F.aggregate(F.slice(values, k * 64 + 1, 64), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(0).cast("long")))
    return F.transform(words, one)


def differing(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)


def centred(histogram: Column) -> Column:
    """Differences from the mean."""
    return F.transform(histogram, lambda x: x - F.aggregate(histogram, F.lit(0.0), lambda s, v: s + v) / F.size(histogram))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def prepared(items: DataFrame, key: str, hash_: Column, histogram: Column, *keep: str) -> DataFrame:
    """(key, hash, centred, spread, keep): what comparisons need of each image, computed once.

    Images without a key, hash or histogram, or with a null value, are left out. A histogram with a non-finite value correlates
    with none (centred and spread are NaN); its image is compared by the hash.
    """
    h = histogram.cast("array<double>")
    rows = items.select(key, hash_.alias("hash"), h.alias("h"), *keep).where(F.col(key).isNotNull()).where("hash is not null and h is not null and size(h) > 0").where(F.forall("h", lambda x: x.isNotNull()))
    finite = F.forall("h", lambda x: F.abs(x) < float("inf"))
    rows = rows.select(key, "hash", F.when(finite, centred(F.col("h"))).otherwise(F.transform("h", lambda x: F.lit(float("nan")))).alias("centred"), *keep)
    return rows.withColumn("spread", _dot(F.col("centred"), F.col("centred")))


def similar(items: DataFrame, queries: DataFrame, key: str, n_bits: int | None, k: int = 5, least: float = LEAST, share: float = HASH_SHARE, block: int = BLOCK) -> DataFrame:
    """The k images most like each query (both prepared(), the query itself aside): query_id, key, score, hash_score, histogram_score, rank, and the images' other columns.

    score: `share` of the bits that agree, and the rest of (correlation + 1) / 2, or of 0 without a correlation; below `least` is
    no match; a flat histogram correlates wholly. Hashes and histograms of another size agree with none. Without `n_bits` a hash has
    as many bits as its histogram has values. Ties go by hash score, histogram score and key. All images are compared with each query by matrix
    products (operators/nearest.py); a query's candidates are ranked in parts first.
    """
    rest = [c for c in items.columns if c not in ("hash", "centred", "spread", key)]
    named = lambda df, *keep: df.select(key, *keep, F.col("centred").alias("x"), F.col("spread").alias("square"), F.col("hash").alias("words"))
    sized = items.withColumn("n_bits", F.lit(n_bits) if n_bits else F.size("centred"))
    met = nearest.candidates(named(sized, *rest, "n_bits"), named(queries), key, k, *rest, "n_bits", share=share, n_bits=n_bits, block=block)
    agree = 1 - F.col("differ") / F.col("n_bits")
    flat = F.col("square") * F.col("q_square") <= 2.220446049250313e-16
    correlation = F.when(flat, 1.0).otherwise(F.col("dot") / F.sqrt(F.when(flat, 1.0).otherwise(F.col("square") * F.col("q_square"))))
    look = F.when(F.abs(correlation) < float("inf"), F.least(F.greatest((correlation + 1) / 2, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    met = met.withColumns({"hash_score": F.round(agree, 9), "histogram_score": F.round(look, 9)})
    scored = met.withColumn("score", F.round(share * F.col("hash_score") + (1 - share) * F.col("histogram_score"), 6)).where(F.col("score") >= least)
    scored = scored.select(key, *rest, "query_id", "hash_score", "histogram_score", "score")
    order = [F.col("score").desc(), F.col("hash_score").desc(), F.col("histogram_score").desc(), F.col(key)]
    for by in (["query_id", F.pmod(F.xxhash64(key), F.lit(PARTS))], ["query_id"]):
        scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    return scored


def price_changes(items: DataFrame, queries: DataFrame, key: str, n_bits: int | None, price: str, least: float = VERY, k: int = 5) -> DataFrame:
    """Queries whose most similar image with a price, of the k most similar, has another price: query_id, price, key, other_price, score. A flag of history, not a verdict."""
    met = similar(items, queries, key, n_bits, k, least).where(F.col(price).isNotNull())
    best = met.groupBy("query_id").agg(F.min_by(F.struct(F.col(key), F.col(price).alias("other_price"), F.col("score")), "rank").alias("m")).select("query_id", "m.*")
    own = queries.select(F.col(key).alias("query_id"), F.col(price)).where(F.col(price).isNotNull())
    return best.join(own, "query_id").where(F.abs(F.col(price) - F.col("other_price")) > 0.01).select("query_id", price, key, "other_price", "score")
