"""Range, interval, containment and lookup joins between evidence and registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prefix_range_join(rows: DataFrame, code: Column, ranges: DataFrame, digits: int = 3) -> DataFrame:
    """Rows with the columns of the range (low, high, ...) that holds the code's first digits; null columns if none does.

    Ranges are opened into their prefixes, of which there are 10 ** digits at most, so that this is a hash join on equal prefixes.
    Of overlapping ranges the one with the greatest low wins.
    """
    rest = [c for c in ranges.columns if c not in ("low", "high")]
    opened = ranges.select(F.explode(F.sequence(F.col("low").cast("int"), F.col("high").cast("int"))).alias("_prefix"), F.struct("low", *rest).alias("_range"))
    opened = opened.groupBy("_prefix").agg(F.max_by("_range", "_range.low").alias("_range"))
    keyed = rows.withColumn("_prefix", F.substring(code, 1, digits).try_cast("int"))
    return keyed.join(F.broadcast(opened), "_prefix", "left").select(*rows.columns, *(F.col(f"_range.{c}").alias(c) for c in rest))


def first_place(text: Column, places: list[tuple[str, str]], otherwise: str) -> Column:
    """The name of the first (key, name) of `places` whose key the text contains, case ignored."""
    listed = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(n).alias("name")) for k, n in places))
    return F.coalesce(F.get(F.filter(listed, lambda p: F.contains(F.lower(text), p["key"])), F.lit(0))["name"], F.lit(otherwise))


def changes_in_force(changes: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Changes (keys, change_date, ...) with the chunks (keys, effective_from, effective_to, ...) in force then; a change without a date meets all."""
    on = F.col("change_date")
    during = (F.col("effective_from").isNull() | (F.col("effective_from") <= on)) & (F.col("effective_to").isNull() | (on < F.col("effective_to")))
    return changes.join(chunks, keys).where(on.isNull() | during)


def impact(met: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Per key the sorted distinct values of each column."""
    return met.groupBy(*keys).agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in columns))


def name_tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "), " "), lambda w: F.length(w) > 2))


def registry_match(claims: DataFrame, registry: DataFrame, key: str, claimed: str, registered: str) -> DataFrame:
    """Claims with `outcome` by their registry entry: NOT_FOUND, MATCH if the names share a word of three letters or more, else NAME_DIFFERS."""
    met = claims.join(registry.select(key, F.col(registered).alias("_registered"), F.lit(True).alias("_found")), key, "left")
    shared = F.arrays_overlap(name_tokens(F.coalesce(claimed, F.lit(""))), name_tokens(F.coalesce("_registered", F.lit(""))))
    outcome = F.when(F.col("_found").isNull(), "NOT_FOUND").when(shared, "MATCH").otherwise("NAME_DIFFERS")
    return met.withColumn("outcome", outcome).drop("_registered", "_found")


def only_candidate(needs: DataFrame, candidates: DataFrame, keys: list[str], value: str, confidence: str, factor: float = 0.6) -> DataFrame:
    """Needs joined to their candidate's value if there is exactly one, with its confidence times `factor`; others keep null. Counted before joining."""
    single = candidates.groupBy(*keys).agg(F.count("*").alias("_n"), F.any_value(value).alias(value), (F.any_value(confidence) * factor).alias(confidence)).where("_n = 1").drop("_n")
    return needs.join(single, keys, "left")


def best_pair(pairs: DataFrame, keys: list[str], score: str, choice: str, sure: float = 0.70, least: float = 0.30) -> DataFrame:
    """Per key the best scored choice (the lesser winning ties), its lead over the runner-up, and whether it is VERIFIED, AMBIGUOUS or NONE.

    The runner-up is the best of the other choices: a repeated choice doesn't compete with itself. The best two
    are folded, not sorted: a key's candidates are never gathered.
    """
    ranked = pairs.withColumn("_r", F.struct(F.col(score).alias("s"), (-F.col(choice)).alias("c")))
    best = ranked.groupBy(*keys).agg(F.max("_r").alias("_best"))
    rest = ranked.join(best, keys).where(F.col(choice) != -F.col("_best.c")).groupBy(*keys).agg(F.max("_r.s").alias("_second"))
    found = best.join(rest, keys, "left")
    top = F.col("_best.s")
    return found.select(*keys, (-F.col("_best.c")).alias(choice), top.alias(score), (top - F.coalesce("_second", F.lit(0.0))).alias("lead"), F.when(top >= sure, "VERIFIED").when(top >= least, "AMBIGUOUS").otherwise("NONE").alias("status"))
