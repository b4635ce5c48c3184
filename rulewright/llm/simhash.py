"""Operator 2: SimHash near-duplicates, found by tiled exact comparison.

A document's fingerprint is the bitwise majority over the XXH64 hashes (seed 42) of its word
shingles. Two fingerprints link when at most `radius` bits differ. If they do, then of `blocks`
bit blocks at least `blocks - radius` agree, so comparing inside groups that share such a set of
blocks finds every link exactly. Within a group fingerprints are sorted by population count and
compared tile against tile with numpy's exclusive-or and bit counts; tile pairs whose population
counts differ by more than the radius are skipped. Groups of more than `tile_rows` fingerprints
are split into tiles whose pairs become tasks of their own.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.llm.common import cut_lineage, lower_words, row_key, without_rows
from rulewright.llm.components import connected_components

SEED = 42


def fingerprint(text: str | None, shingle_words: int = 4) -> int:
    """64-bit fingerprint, unsigned. No words (null, empty, blank): zero. Fewer words than a shingle: one shingle of all."""
    words = lower_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - shingle_words].tolist(), ends[shingle_words - 1 :].tolist())], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        # 255 rows at most add up in a byte
        for lo in range(0, len(part), 255 * 64):
            bits = np.unpackbits(part[lo : lo + 255 * 64].view(np.uint8), bitorder="little").reshape(-1, 64)
            whole = len(bits) // 255 * 255
            if whole:
                counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
            if whole < len(bits):
                counts += bits[whole:].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _keyed_fingerprints(documents: DataFrame, shingle_words: int) -> DataFrame:
    """Every document's (doc_id, row_key, fp)."""

    def run(batches):
        for batch in batches:
            found = np.fromiter((fingerprint(x, shingle_words) for x in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(found.view(np.int64))], names=["doc_id", "row_key", "fp"])

    kept = documents.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(documents).alias("row_key"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, row_key long, fp long")


def fingerprints(documents: DataFrame, shingle_words: int = 4) -> DataFrame:
    """Every document's (doc_id, fp), fp being the 64 bits as a signed long."""
    return _keyed_fingerprints(documents, shingle_words).select("doc_id", "fp")


def _labels(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least member of each of n nodes' components under the links left[i]-right[i]."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def tiled_links(values: np.ndarray, radius: int, tile: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest over all pairs of `values` (uint64) at most `radius` bits apart."""
    pops = np.bitwise_count(values)
    order = np.argsort(pops, kind="stable")
    values, pops = values[order], pops[order].astype(np.int64)
    lefts, rights = [], []
    for a in range(0, len(values), tile):
        x = values[a : a + tile]
        for b in range(a, len(values), tile):
            if pops[b] - pops[min(a + tile, len(values)) - 1] > radius:
                break
            i, j = np.nonzero(np.bitwise_count(x[:, None] ^ values[None, b : b + tile]) <= radius)
            keep = i + a < j + b
            if keep.any():
                lefts.append(i[keep] + a)
                rights.append(j[keep] + b)
    if not lefts:
        return values[:0], values[:0]
    label = _labels(len(values), np.concatenate(lefts), np.concatenate(rights))
    linked = np.nonzero(label != np.arange(len(values)))[0]
    return values[linked], values[label[linked]]


def _compare_groups(batches, radius: int):
    """Rows (g, fp) sorted by g arrive in batches; emits link edges of each group."""

    def out(found):
        pairs = [x for x in found if len(x[0])]
        if pairs:
            u, v = (np.concatenate([p[k] for p in pairs]).view(np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    rest_g, rest_v = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        g = np.concatenate([rest_g, batch.column("g").to_numpy()])
        v = np.concatenate([rest_v, batch.column("fp").to_numpy().view(np.uint64)])
        if not len(g):
            continue
        cuts = np.concatenate(([0], np.nonzero(np.diff(g))[0] + 1))
        yield from out([tiled_links(v[a:b], radius) for a, b in zip(cuts[:-1], cuts[1:]) if b - a > 1])
        rest_g, rest_v = g[cuts[-1] :], v[cuts[-1] :]
    yield from out([tiled_links(rest_v, radius)])


def block_count(n_fingerprints: int, radius: int) -> int:
    """Blocks such that evenly spread fingerprints give groups of about a thousand at most."""
    blocks = radius + 1
    while blocks < 2 * radius + 2 and n_fingerprints >> (64 * (blocks - radius) // blocks) > 1024:
        blocks += 1
    return blocks


def link_edges(prints: DataFrame, radius: int = 4, tile_rows: int = 4096) -> DataFrame:
    """Edges (u, v) that connect exactly the distinct fingerprints `fp` within `radius` bits (a spanning forest of each compared group)."""
    n = prints.count()
    blocks = block_count(n, radius)
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    parts = [F.shiftrightunsigned("fp", bounds[i]).bitwiseAND(F.lit((1 << (bounds[i + 1] - bounds[i])) - 1)) for i in range(blocks)]
    keys = [F.xxhash64(F.lit(k), *(parts[i] for i in chosen)) for k, chosen in enumerate(combinations(range(blocks), blocks - radius))]
    rows = prints.select("fp", F.bit_count("fp").alias("pop"), F.explode(F.array(*keys)).alias("g"))
    crowded = rows.groupBy("g").count().where(F.col("count") > tile_rows).select("g")
    even = rows.join(crowded, "g", "left_anti").select("g", "fp")
    # crowded groups: tiles by population count, and one group for each pair of tiles within the radius
    hot = rows.join(crowded, "g", "left_semi")
    sizes = hot.groupBy("g", "pop").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("tiles"))
    dealt = hot.join(sizes, ["g", "pop"]).select("g", "pop", F.pmod(F.xxhash64("fp"), "tiles").cast("int").alias("tile"), "fp")
    tiles = sizes.select("g", "pop", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    other = tiles.select("g", F.col("pop").alias("pop2"), F.col("tile").alias("tile2"))
    pairs = tiles.join(other, "g").where((F.col("pop2") - F.col("pop") <= radius) & (F.struct("pop", "tile") <= F.struct(F.col("pop2").alias("pop"), F.col("tile2").alias("tile"))))
    pairs = pairs.withColumn("pair", F.xxhash64("g", "pop", "tile", "pop2", "tile2"))
    sides = pairs.select("g", "pop", "tile", "pair").union(pairs.where("pop != pop2 or tile != tile2").select("g", "pop2", "tile2", "pair"))
    split = dealt.join(sides, ["g", "pop", "tile"]).select(F.col("pair").alias("g"), "fp")
    return even.union(split).repartition("g").sortWithinPartitions("g", "fp").mapInArrow(lambda b: _compare_groups(b, radius), "u long, v long")


def near_duplicates(documents: DataFrame, shingle_words: int = 4, radius: int = 4, tile_rows: int = 4096) -> DataFrame:
    """One row per document: doc_id, fp (signed long) and component_id, the least doc_id reachable over links.

    Texts that are null, empty or blank have fingerprint zero and link like any other. Rows of the
    same text share a fingerprint and so a component; repeated doc_ids each keep their row. Null
    doc_ids are kept, and never chosen as component_id unless a component has no other. Extra
    columns are ignored; an empty table gives an empty result.
    """
    prints = cut_lineage(fingerprints(documents, shingle_words))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    edges = link_edges(distinct.select("fp"), radius, tile_rows)
    roots = connected_components(edges).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    return prints.join(rooted.select("fp", "root").join(least, "root"), "fp").select("doc_id", "fp", "component_id")


def keep_first(documents: DataFrame, shingle_words: int = 4, radius: int = 4) -> DataFrame:
    """The documents, all columns kept, with one of each group of near duplicates: the one with the least doc_id.

    Groups are of rows, told apart by doc_id and text, so unlike texts with the same doc_id, or with
    none, each stay. A row without doc_id is chosen only if nothing else in its group has one.
    """
    prints = cut_lineage(_keyed_fingerprints(documents, shingle_words))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))
    distinct = prints.groupBy("fp").agg(least.alias("first"))
    roots = connected_components(link_edges(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    chosen = rooted.groupBy("root").agg(F.min("first")["row_key"].alias("chosen"))
    groups = cut_lineage(prints.join(rooted.select("fp", "root").join(chosen, "root"), "fp").select("row_key", "chosen"))
    later = groups.where("row_key != chosen").select(F.col("row_key").alias("_later"))
    kept = without_rows(documents, later, row_key(documents))
    repeated = cut_lineage(groups.where("row_key = chosen").groupBy("row_key").count().where("count > 1").select(F.col("row_key").alias("_later")))
    if repeated.isEmpty():
        return kept
    once = without_rows(kept, repeated, row_key(kept))
    copies = kept.withColumn("_row_key", row_key(kept)).join(repeated, F.col("_row_key") == F.col("_later"), "left_semi")
    return once.unionByName(copies.dropDuplicates(["_row_key"]).drop("_row_key"))
