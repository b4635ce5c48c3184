"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared checkpoint folder of the cluster's setting. Where none is set, only a local session gets a temporary one: on a cluster that would lose data."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder, so that it is computed once and survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like cut_lineage(), as a table that is smaller on disk: written in the shared checkpoint folder and read again."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_remainder(column: Column, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo `modulus`; a null id counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % modulus


def row_key(documents: DataFrame) -> Column:
    """A long for each row's doc_id and text: rows that only share a doc_id, or have none, stay apart. Null texts count as empty."""
    return F.xxhash64(documents["doc_id"].cast("long"), F.coalesce(documents["text"].cast("string"), F.lit("")))


def lower_words(text: str | None) -> list[bytes]:
    """UTF-8 words between ASCII white space, with only A-Z lower-cased; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def without_rows(rows: DataFrame, drop: DataFrame, key: Column, most: int = 1_000_000) -> DataFrame:
    """`rows` whose `key` is none of drop's single column, nulls matching nulls; broadcast only if counted to be `most` keys at most."""
    drop = cut_lineage(drop.distinct())
    name = drop.columns[0]
    small = drop.count() <= most
    return rows.join(F.broadcast(drop) if small else drop, key.eqNullSafe(drop[name]), "left_anti")
