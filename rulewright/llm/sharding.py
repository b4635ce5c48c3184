"""Operator 12: shards that each match the mixture of sources, by proportional stratified interleaving.

Rows of a source are put in a seeded random order and ranked. Row r (from 0) of a source with n rows gets the
fractional rank (r + u) / n, u being a number from 0 to 1 that the seed gives each source, so that sources of
a row or two don't all fall in the middle. All rows sorted by fractional rank are an even mixture at every
place, and cut into shards of equal row counts they give each shard its share of each source.

Neither order is made in one task. A random order is dealt into ranges of its hash, and the sort into ranges
of the fractional rank, both even whatever the sources' sizes: a row's rank is its rank in its range and the
sum of the ranges before, of which only counts are summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulewright.llm.common import written

#: Ranges of an order: this many at least, and so many that one holds about `RANGE_ROWS` rows.
MIN_RANGES, RANGE_ROWS = 512, 20_000
_UNIT = 1 << 52


def _unit(*columns: Column | str) -> Column:
    """A number from 0 to under 1 by hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(_UNIT)) / F.lit(float(_UNIT))


def _places(rows: DataFrame, group: list[str], part: str, order: list[str], place: str, total: str) -> DataFrame:
    """rows with their place (from 0) in the order of `part`, then `order`, within `group`, and the group's total; windows over single ranges only, and over ranges' counts."""
    counts = rows.groupBy(*group, part).agg(F.count("*").alias("_n"))
    # one constant group if there is none: counts of ranges only, of which there are rows / RANGE_ROWS or MIN_RANGES
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = whole.orderBy(part).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.select(*(F.col(c).alias(f"_{c}") for c in [*group, part]), (F.sum("_n").over(before) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias(total))
    own = F.row_number().over(Window.partitionBy(*group, part).orderBy(*order)) - 1
    met = rows.withColumn("_own", own).join(counts, [F.col(c) == F.col(f"_{c}") for c in [*group, part]])
    return met.withColumn(place, F.col("_own") + F.col("_before")).drop("_own", "_before", *(f"_{c}" for c in [*group, part]))


def assign(rows: DataFrame, key: list[Column], stratum: Column, shards: int = 8, seed: int = 0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """`rows`, all columns kept, with shard (int, from 0) and slot (long, gapless from 0 in each shard), counts at most one apart.

    key: columns that tell rows apart, by whose hash rows are shuffled; rows that are alike in it keep the order in
    which they are read. stratum: what is mixed evenly; null is a stratum of its own. An empty table gives an empty
    result; shards beyond the number of rows stay empty. Columns shard and slot of `rows` itself are replaced; no other
    name clashes, as own columns are kept apart in one struct.
    """
    whole = F.struct(*(rows[f"`{c}`"] for c in rows.columns if c not in ("shard", "slot")))
    base = written(rows.select(whole.alias("row"), F.coalesce(stratum.cast("string"), F.lit("")).alias("stratum"), stratum.isNull().alias("no_stratum"), F.xxhash64(F.lit(seed), *key).alias("hash"), F.monotonically_increasing_id().alias("read")))
    ranges = max(MIN_RANGES, -(-base.count() // range_rows))
    shuffled = base.withColumn("part", F.floor(F.shiftrightunsigned("hash", 12) / F.lit(float(_UNIT)) * ranges))
    ranked = _places(shuffled, ["stratum", "no_stratum"], "part", ["hash", "read"], "rank", "n").drop("part")
    fraction = (F.col("rank") + _unit(F.lit(seed), "stratum", "no_stratum")) / F.col("n")
    ranked = written(ranked.withColumn("fraction", fraction).withColumn("part", F.least(F.floor(F.col("fraction") * ranges), F.lit(ranges - 1))))
    placed = _places(ranked, [], "part", ["fraction", "hash", "stratum", "no_stratum", "read"], "place", "total")
    # the first shards of `total` rows take one more where they don't divide evenly
    size, more = F.floor(F.col("total") / shards), F.col("total") % shards
    large = more * (size + 1)
    shard = F.when(F.col("place") < large, F.floor(F.col("place") / (size + 1))).otherwise(more + F.floor((F.col("place") - large) / F.greatest(size, F.lit(1))))
    slot = F.when(F.col("place") < large, F.col("place") % (size + 1)).otherwise((F.col("place") - large) % F.greatest(size, F.lit(1)))
    return placed.select("row.*", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def shard_documents(documents: DataFrame, shards: int = 8, seed: int = 0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per row of documents (doc_id, text, source): doc_id, source, size (bytes of the text in UTF-8, and 1), text_crc32, shard and slot.

    Sources are mixed evenly. Null texts count as empty, a null source as a source, and rows without doc_id as rows;
    repeated rows each have a place. Texts themselves aren't shuffled: only their sizes and checksums.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    thin = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return assign(thin, [thin["doc_id"], thin["text_crc32"], thin["size"]], thin["source"], shards, seed, range_rows)


def write_shards(documents: DataFrame, path: str, shards: int = 8, seed: int = 0, range_rows: int = RANGE_ROWS) -> None:
    """Write whole documents (all columns) as Parquet in folders shard=0, 1, ... under `path`, with their slots; files hold ranges of slots, sorted."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    placed = assign(documents, [F.col("doc_id"), F.crc32(text.cast("binary")), F.octet_length(text)], F.col("source"), shards, seed, range_rows)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)
