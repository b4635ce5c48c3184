"""Reading and writing the stores: tables, tolerant JSON, append-only logs, child rows, flags and copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

CORRUPT = "_corrupt_record"


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """A Parquet table; columns and filter reach the scan."""
    rows = spark.read.parquet(path)
    rows = rows if where is None else rows.where(where)
    return rows.select(*columns) if columns else rows


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int = 64, **options: str) -> DataFrame:
    """A database table read in `parts` ranges of an integer key."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, **options).load()


def read_json(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, corrupt lines) of a JSON-lines store; nothing is dropped silently."""
    shape = StructType([*schema.fields]).add(CORRUPT, StringType())
    parsed = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r")).select("r.*")
    return parsed.where(F.col(CORRUPT).isNull()).drop(CORRUPT), parsed.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def append_log(rows: DataFrame, path: str) -> None:
    """Add rows to a log that is never rewritten, with the time they were added."""
    rows.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


def replace_children(rows: DataFrame, path: str, parent: str) -> None:
    """Replace the child rows of the parents that `rows` has, and of no others; the store is partitioned by parent."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(parent).parquet(path)


def compare_and_set(rows: DataFrame, chosen: Column, column: str, expected: str, new: str) -> DataFrame:
    """Chosen rows whose column has the expected value get the new one."""
    return rows.withColumn(column, F.when(F.coalesce(chosen, F.lit(False)) & (F.col(column) == expected), new).otherwise(F.col(column)))


def exclusive_flag(rows: DataFrame, group: str, flag: str, chosen: Column) -> DataFrame:
    """In groups with a chosen row the flag is set there and cleared elsewhere; other groups keep theirs."""
    touched = rows.where(chosen).select(group).distinct().withColumn("_touched", F.lit(True))
    return rows.join(touched, group, "left").withColumn(flag, F.when(F.col("_touched"), F.coalesce(chosen, F.lit(False))).otherwise(F.col(flag))).drop("_touched")


def copy_referenced(rows: DataFrame, parents: DataFrame, foreign: str, key: str) -> DataFrame:
    """Rows whose parent exists, or that have none, as a copy between stores may take."""
    known = rows.join(parents.select(F.col(key).alias(foreign)), foreign, "left_semi")
    return known.unionByName(rows.where(F.col(foreign).isNull()))


def decode_json(text: Column, schema: str) -> Column:
    """A JSON column as a struct; null for what isn't JSON or isn't of that shape."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})
