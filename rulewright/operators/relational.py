"""Joins, windows and roll-ups over evidence, versions, cases and readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulewright.operators import nearest


def as_of_version(rows: DataFrame, versions: DataFrame, keys: list[str], on: str, columns: list[str]) -> DataFrame:
    """Each row's version in force on a date: effective_from <= date < effective_to, the latest start winning.

    A hash join on the keys with the range as residual; versions per key are few.
    """
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    met = numbered.join(versions, keys).where((F.col(on) >= F.col("effective_from")) & (F.col("effective_to").isNull() | (F.col(on) < F.col("effective_to"))))
    latest = Window.partitionBy("_row").orderBy(F.col("effective_from").desc())
    return met.withColumn("_n", F.row_number().over(latest)).where("_n = 1").select(*rows.columns, *columns)


def interval_overlaps(versions: DataFrame, keys: list[str]) -> DataFrame:
    """Versions that begin before the one before them ends."""
    w = Window.partitionBy(*keys).orderBy("effective_from", "version")
    marked = versions.withColumn("prev_version", F.lag("version").over(w)).withColumn("prev_to", F.lag("effective_to").over(w))
    return marked.where(F.col("prev_version").isNotNull() & (F.col("prev_to").isNull() | (F.col("effective_from") < F.col("prev_to"))))


def latest_per_key(rows: DataFrame, keys: list[str], demoted: Column, newest: list) -> DataFrame:
    """One row per key: undemoted first, then the newest."""
    w = Window.partitionBy(*keys).orderBy(demoted.cast("int"), *newest)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def best_reading(rows: DataFrame, keys: list[str], value: str, confidence: str, sequence: str) -> DataFrame:
    """Best reading per key (most confident, the earlier keeping ties, then the greater value), how many distinct values there were, and whether they conflict."""
    best = F.max_by(value, F.struct(F.col(confidence), -F.col(sequence), F.col(value)))
    return rows.groupBy(*keys).agg(best.alias("best_value"), F.max(confidence).alias("best_confidence"), F.count_distinct(value).alias("n_values"), F.count("*").alias("n_readings")).withColumn(
        "agreement", F.when(F.col("n_readings") == 1, "SINGLE_SOURCE").when(F.col("n_values") == 1, "CORROBORATED").otherwise("CONFLICTING")
    )


def capped_status(status: Column, agreement: Column) -> Column:
    """A pass or fail on conflicting or unknown evidence is uncertain; nothing is ever raised."""
    return F.when(status.isin("PASS", "FAIL") & F.coalesce(agreement.isin("CONFLICTING", "UNKNOWN"), F.lit(True)), "UNCERTAIN").otherwise(status)


def first_seen(rows: DataFrame, content: Column, order: str) -> DataFrame:
    """Mark later rows of the same content as duplicates of the first."""
    w = Window.partitionBy("content_hash").orderBy(order)
    return rows.withColumn("content_hash", F.md5(content)).withColumn("first_id", F.first(order).over(w)).withColumn("is_duplicate", F.col("first_id") != F.col(order))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old_if_null: bool = True) -> DataFrame:
    """Rows of both; where both have a key the new values win, or, if null, the old ones stay."""
    rest = [c for c in old.columns if c not in keys]
    a, b = old.select(*keys, *(F.col(c).alias(f"o_{c}") for c in rest), F.lit(True).alias("_old")), new.select(*keys, *(F.col(c).alias(f"n_{c}") for c in rest), F.lit(True).alias("_new"))
    merged = a.join(b, keys, "full_outer")
    pick = lambda c: F.coalesce(F.col(f"n_{c}"), F.col(f"o_{c}")) if keep_old_if_null else F.when(F.col("_new"), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}"))
    return merged.select(*keys, *(pick(c).alias(c) for c in rest))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str], immutable: list[str]) -> DataFrame:
    """New keys only; raises at run time if an existing key's immutable columns differ."""
    known = old.select(*keys, *(F.col(c).alias(f"_o_{c}") for c in immutable), F.lit(True).alias("_known"))
    met = new.join(known, keys, "left")
    same = F.lit(True)
    for c in immutable:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    # the check is part of the filter, and runs first there for rows whose key is known
    absent = F.when(F.col("_known") & ~same, F.raise_error(F.lit("immutable columns differ")).cast("boolean")).otherwise(F.col("_known").isNull())
    return met.where(absent).select(*new.columns)


def outer_compare(reference: DataFrame, inspected: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Field by field outcome of two sources: MATCH, DIFFERENT, REF_NOT_OBSERVED or INSP_NOT_OBSERVED."""
    a, b = (d.select(*keys, F.col(value).alias(n)) for d, n in ((reference, "ref_value"), (inspected, "insp_value")))
    both = a.join(b, keys, "full_outer")
    outcome = F.when(F.col("ref_value").isNull(), "REF_NOT_OBSERVED").when(F.col("insp_value").isNull(), "INSP_NOT_OBSERVED").when(F.col("ref_value") == F.col("insp_value"), "MATCH").otherwise("DIFFERENT")
    return both.withColumn("outcome", outcome)


def set_difference(proposed: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of one side only, marked missing (in current only) or extra (in proposed only)."""
    return current.exceptAll(proposed).withColumn("side", F.lit("missing")).unionByName(proposed.exceptAll(current).withColumn("side", F.lit("extra")))


def banded(value: Column, bands: list[tuple[float | None, float]]) -> Column:
    """The result of the first band whose upper bound is null or not below the value."""
    out = F.lit(None).cast("double")
    for upper, result in reversed(bands):
        out = F.when(F.lit(True) if upper is None else value <= F.lit(upper), F.lit(float(result))).otherwise(out)
    return F.when(value.isNotNull(), out)


def unit_price(price: Column, quantity: Column) -> Column:
    """Price per unit in exact decimals, half up to two places; null for no quantity."""
    exact = F.try_divide(price.cast("decimal(18,4)"), F.nullif(quantity.cast("decimal(18,4)"), F.lit(0).cast("decimal(18,4)")))
    return F.round(exact, 2).cast("decimal(18,2)")


def top_similar(vectors: DataFrame, queries: DataFrame, k: int, least: float | None = None) -> DataFrame:
    """The k nearest vectors by cosine of each query row (query_id, q); itself left out. Vectors are compared by matrix products (operators/nearest.py).

    Vectors of another length than most, or with a null or non-finite component, are few, and are compared one by one; without a score they come last.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    size = vectors.agg(F.mode(F.size("embedding"))).first()[0] or 0
    whole = lambda x: F.coalesce((F.size(x) == size) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    shape = lambda df, key, x, *keep: df.where(whole(x)).select(F.col(key).alias("vec_id"), *keep, F.col(x).cast("array<double>").alias("x"), dot(F.col(x), F.col(x)).alias("square"), F.array().cast("array<long>").alias("words"))
    met = nearest.candidates(shape(vectors, "vec_id", "embedding"), shape(queries, "query_id", "q"), "vec_id", k)
    near = met.select("query_id", "vec_id", F.try_divide("dot", F.sqrt(F.col("square") * F.col("q_square"))).alias("score"))
    cosine = F.try_divide(dot(F.col("embedding"), F.col("q")), F.sqrt(dot(F.col("embedding"), F.col("embedding")) * dot(F.col("q"), F.col("q"))))
    odd = vectors.where(~whole("embedding")).join(F.broadcast(queries), F.col("vec_id") != F.col("query_id")).unionByName(vectors.where(whole("embedding")).join(F.broadcast(queries.where(~whole("q"))), F.col("vec_id") != F.col("query_id")))
    scored = near.unionByName(odd.select("query_id", "vec_id", cosine.alias("score")))
    scored = scored.withColumn("score", F.round("score", 6))
    if least is not None:
        scored = scored.where(F.col("score") >= least)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
