"""Operator 1: harmonic packing of token sequences.

Class k holds the pieces of which k, but not k + 1, fit a sequence; its sequences take k pieces
each. Documents may be cut: a piece of exactly capacity // k tokens is taken off the rest with the
least k that allows it, until the rest is at most capacity // cut_classes long. So all pieces of one
length form one class, a full sequence of a class wastes less than k tokens, and few pieces are cut.

Each (length, salt) group numbers its pieces on its own; the groups' counts, which are few, give
every piece its place among all of its length. Only the last, not quite full, sequence of each
length remains (under capacity // length pieces, so a number fixed by `capacity`, whatever the
input); those pieces are packed together by best fit.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulewright.llm import tokens
from rulewright.llm.common import cut_lineage

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_lengths(n: int, capacity: int, cut_classes: int = 32) -> list[int]:
    """Lengths of the pieces of a document of n tokens, in order; they add up to n."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest > capacity // cut_classes:
        k = -(-capacity // rest)
        out.append(capacity // k)
        rest -= capacity // k
    return out + [rest] * (rest > 0)


def pieces(documents: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, cut_classes: int = 32) -> DataFrame:
    """A row per piece of each document's ids (end_id appended): its place, length and CRC-32 of its little-endian 32-bit ids.

    Null and empty texts have end_id alone.
    """

    def run(batches):
        tokenizer = tokens.load(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for at, found in enumerate(tokenizer.batch_ids(batch.column("text"))):
                ids = memoryview(found.tobytes() + end)
                n, start = len(ids) // 4, 0
                for length in cut_lengths(n, capacity, cut_classes):
                    rows.append((at, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n))
                    start += length
            at, *rest = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), *map(pa.array, rest)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kept = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(run, PIECES)


def _best_fit(leftover: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Pack a bounded number of pieces, longest first, each where it leaves the least room."""
    leftover = leftover.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    bins, offsets, made = [], [], 0
    for length in leftover["length"].tolist():
        room = next((r for r in range(length, capacity) if open_bins[r]), capacity)
        if room == capacity:
            number, made = made, made + 1
        else:
            number = open_bins[room].pop()
        bins.append(number)
        offsets.append(capacity - room)
        open_bins[room - length].append(number)
    return leftover.assign(sequence_id=np.array(bins, np.int64), offset=np.array(offsets, np.int64))


def pack(cut: DataFrame, capacity: int = 2048, salts: int | None = None) -> DataFrame:
    """Give every piece of `cut` (as from pieces()) a sequence_id and its offset there.

    Sequences have no gaps and at most `capacity` tokens. Repeated rows are packed as often as they
    occur; an empty input gives an empty result. Pieces of one length, however many, are numbered in
    `salts` independent groups (the session's shuffle partitions by default).
    """
    salts = salts or int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    by_length = Window.partitionBy("length")
    places = counts.select("length", "salt", (F.sum("n").over(by_length.orderBy("salt")) - F.col("n")).alias("before"), F.sum("n").over(by_length).alias("total"))
    # at most (lengths that cutting can give) x salts rows, a bound that does not depend on the documents
    ranked = salted.withColumn("nth", F.row_number().over(group) - 1).join(F.broadcast(places), ["length", "salt"])
    per = F.floor(F.lit(capacity) / F.col("length"))
    ranked = ranked.withColumn("rank", F.col("before") + F.col("nth")).withColumn("per", per).withColumn("full", F.floor(F.col("total") / F.col("per")) * F.col("per"))
    columns = [c.split()[0] for c in PIECES.split(", ")]
    settled = ranked.where("rank < full").select(
        *columns,
        (F.col("length") * F.lit(1 << 44) + F.floor(F.col("rank") / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("rank") % F.col("per") * F.col("length")).cast("long").alias("offset"),
    )
    leftover = ranked.where("rank >= full").select(*columns, F.lit(0).alias("all"))
    rest = leftover.groupBy("all").applyInPandas(lambda p: _best_fit(p.drop(columns="all"), capacity), PIECES + ", sequence_id long, offset long")
    return settled.unionByName(rest)


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Tokenise, cut and pack all documents; see pieces() and pack(). A null text is its end alone; repeated rows and rows without doc_id are packed each; extra columns are ignored; an empty table gives an empty result."""
    return pack(cut_lineage(pieces(documents, tokenizer_path, capacity, end_id)), capacity)


def materialise(documents: DataFrame, plan: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids array<int>, doc_ids array<long>.

    `plan` is pack_documents()'s result for the same documents, whose doc_ids must differ and not be null: repeated ids multiply
    rows, and null ones are left out. Null texts are end_id alone; empty tables give none; extra columns are ignored.
    """

    def run(batches):
        tokenizer = tokens.load(tokenizer_path)
        for batch in batches:
            ids = [[*x.tolist(), end_id] for x in tokenizer.batch_ids(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    whole = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")
    cut = plan.join(whole, "doc_id").select("sequence_id", "offset", "doc_id", F.slice("ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("ids"))
    sorted_pieces = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return cut.groupBy("sequence_id").agg(sorted_pieces.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
