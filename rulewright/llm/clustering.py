"""Operator 13: k-means over integer vectors by kd-tree filtering, exactly.

Vectors are put into kd-trees, one for each block of a partition's vectors. A leaf is a few vectors, its
count, their integer sum and their bounding box. Leaves are written in the tree's order, as rows of the
shared folder, and every round reads them: nodes above are unions of neighbours. Centroids come down from
the top. One is pruned where another is strictly nearer to the whole box, which its corner farthest
towards the first tells; a node with one centroid left is assigned whole, by its count and sum; in leaves
with more, vectors are compared with those left. Only each cluster's count and sum, of a partition, leave it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.llm.common import written

#: Vectors of a tree, and of a leaf, at most. A leaf of equal vectors isn't split, whatever its size.
BLOCK, LEAF = 8192, 32
#: Beyond it squared distances of 64 components might not fit a long.
LIMIT = 1 << 27


def integer_vectors(embeddings: DataFrame, dimensions: int = 64, scale: int = 64) -> DataFrame:
    """vec_id and vector (array<long>: floor(scale * x)) of the rows whose embedding has exactly `dimensions` components, none null or not finite."""
    x = F.col("embedding").cast("array<double>")
    whole = (F.size(x) == dimensions) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = embeddings.where(F.col("embedding").isNotNull() & whole)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("vector"))


def _tree(points: np.ndarray, at: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Leaves, in the tree's order: `at` split at the median of the widest side until it is small or all points are equal."""
    own = points[at]
    extent = own.max(axis=0) - own.min(axis=0)
    axis = int(extent.argmax())
    if len(at) <= leaf or not extent[axis]:
        return [at]
    half = len(at) // 2
    order = np.argpartition(own[:, axis], half)
    return _tree(points, at[order[:half]], leaf) + _tree(points, at[order[half:]], leaf)


LEAVES = "ids array<long>, n long, points binary, low binary, high binary, total binary"


def _grow(dimensions: int, block: int, leaf: int):
    def grow(batches):
        for batch in batches:
            ids = batch.column("vec_id")
            points = batch.column("vector").flatten().to_numpy().reshape(-1, dimensions)
            if len(points) and max(int(points.max()), -int(points.min())) > LIMIT:
                raise ValueError(f"components beyond {LIMIT} after scaling: squared distances might not fit a long")
            for a in range(0, len(points), block):
                part = points[a : a + block]
                leaves = _tree(part, np.arange(len(part)), leaf)
                flat, size = np.concatenate(leaves), np.array([len(x) for x in leaves])
                begin = np.cumsum(size) - size
                part = part[flat]
                boxes = [f.reduceat(part, begin, axis=0) for f in (np.minimum, np.maximum, np.add)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array(np.append(begin, len(flat)), pa.int32()), ids.take(pa.array(a + flat))),
                        pa.array(size),
                        pa.array([part[b : b + n].tobytes() for b, n in zip(begin.tolist(), size.tolist())], pa.binary()),
                        *(pa.array([x.tobytes() for x in box], pa.binary()) for box in boxes),
                    ],
                    names=["ids", "n", "points", "low", "high", "total"],
                )

    return grow


def trees(vectors: DataFrame, dimensions: int = 64, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """Leaves of the kd-trees of all vectors (vec_id, vector array<long>), written to the shared folder in the trees' order."""
    return written(vectors.mapInArrow(_grow(dimensions, block, leaf), LEAVES))


def _rows(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, dimensions)


def _prune(low: np.ndarray, high: np.ndarray, centroids: np.ndarray, left: np.ndarray) -> np.ndarray:
    """`left` (nodes x centroids) without the centroids that another one is strictly nearer than to the whole box."""
    to_middle = ((low + high)[:, None, :] - 2 * centroids[None]) ** 2
    nearest = np.where(left, to_middle.sum(axis=2), np.iinfo(np.int64).max).argmin(axis=1)
    best = centroids[nearest][:, None, :]
    towards = centroids[None] - best
    corner = np.where(towards > 0, high[:, None, :], low[:, None, :])
    beyond = (towards * (centroids[None] + best - 2 * corner)).sum(axis=2)
    return left & (beyond <= 0)


@dataclass
class Filtered:
    """What centroids a block's leaves are left with, and the nodes above that were assigned whole."""

    cluster: np.ndarray  # of each leaf; -1 if several centroids are left
    left: np.ndarray  # leaves x centroids
    count: np.ndarray  # of the nodes assigned whole, by centroid
    total: np.ndarray


def _filter(low: np.ndarray, high: np.ndarray, n: np.ndarray, total: np.ndarray, centroids: np.ndarray) -> Filtered:
    """Take centroids down the tree above some leaves."""
    levels = [(low, high, n, total)]
    while len(levels[-1][2]) > 1:
        at = np.arange(0, len(levels[-1][2]), 2)
        levels.append(tuple(f.reduceat(x, at, axis=0) for f, x in zip((np.minimum, np.maximum, np.add, np.add), levels[-1])))
    k = len(centroids)
    count, sums = np.zeros(k, np.int64), np.zeros((k, low.shape[1]), np.int64)
    left, cluster = np.ones((1, k), bool), np.full(1, -1)
    for low, high, n, total in reversed(levels):
        up = np.arange(len(n)) // 2 if len(n) > len(left) else np.arange(len(n))
        left, cluster = left[up], cluster[up].copy()
        open_ = np.nonzero(cluster < 0)[0]
        left[open_] = _prune(low[open_], high[open_], centroids, left[open_])
        done = open_[left[open_].sum(axis=1) == 1]
        cluster[done] = left[done].argmax(axis=1)
        np.add.at(count, cluster[done], n[done])
        np.add.at(sums, cluster[done], total[done])
    return Filtered(cluster, left, count, sums)


def _nearest(points: np.ndarray, left: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each point among those left, the first of several."""
    bound = max(abs(int(x)) for x in (points.min(), points.max(), centroids.min(), centroids.max()))
    if points.shape[1] * 4 * bound * bound < 1 << 52:  # exact in floating point
        p, c = points.astype(float), centroids.astype(float)
        distance = (c * c).sum(axis=1)[None] - 2 * (p @ c.T)
        return np.where(left, distance, np.inf).argmin(axis=1)
    distance = np.stack([((points - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    return np.where(left, distance, np.iinfo(np.int64).max).argmin(axis=1)


def _blocks(batches, dimensions: int):
    """Of record batches of leaves, blocks of about BLOCK vectors: ids, counts, points' column, boxes and sums."""
    for batch in batches:
        size = np.cumsum(batch.column("n").to_numpy())
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + BLOCK, "right")))
            part = batch.slice(a, b - a)
            yield part, part.column("n").to_numpy(), *(_rows(part.column(c), dimensions) for c in ("low", "high", "total"))
            a = b


def _sums(centroids: np.ndarray):
    k, d = centroids.shape

    def sums(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for part, n, low, high, own in _blocks(batches, d):
            found = _filter(low, high, n, own, centroids)
            count += found.count
            total += found.total
            rest = np.nonzero(found.cluster < 0)[0]
            if len(rest):
                points = _rows(part.column("points").take(pa.array(rest)), d)
                to = _nearest(points, np.repeat(found.left[rest], n[rest], axis=0), centroids)
                count += np.bincount(to, minlength=k)
                for c in np.unique(to).tolist():
                    total[c] += points[to == c].sum(axis=0)
        some = np.nonzero(count)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), *(pa.array(total[some, j].copy()) for j in range(d))], names=["cluster", "n", *(f"x{j}" for j in range(d))])

    return sums


def _assign(centroids: np.ndarray):
    d = centroids.shape[1]

    def assign(batches):
        for part, n, low, high, own in _blocks(batches, d):
            found = _filter(low, high, n, own, centroids)
            to, points = np.repeat(found.cluster, n), _rows(part.column("points"), d)
            rest = np.nonzero(to < 0)[0]
            if len(rest):
                to[rest] = _nearest(points[rest], np.repeat(found.left, n, axis=0)[rest], centroids)
            yield pa.RecordBatch.from_arrays([part.column("ids").flatten(), pa.array(to.astype(np.int32)), pa.array(((points - centroids[to]) ** 2).sum(axis=1))], names=["vec_id", "cluster", "distance"])

    return assign


def hashed_start(vectors: DataFrame, k: int = 16, seed: int = 1) -> np.ndarray:
    """The k vectors, or all if fewer, with the smallest SHA-256 of `seed:vec_id`, in that order; vectors of one id by their components. A null id counts as empty."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return np.array([r[0] for r in vectors.orderBy(mark, "vector").limit(k).select("vector").collect()], np.int64)


def fit(leaves: DataFrame, centroids: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Centroids after `rounds` of assigning all vectors (ties: smaller number) and replacing each non-empty centroid by the floor of its vectors' mean. k rows a round reach the driver."""
    centroids, d = centroids.copy(), centroids.shape[1]
    schema = ", ".join(["cluster int", "n long", *(f"x{j} long" for j in range(d))])
    for _ in range(rounds):
        sums = leaves.mapInArrow(_sums(centroids), schema).groupBy("cluster").agg(F.sum("n"), *(F.sum(f"x{j}") for j in range(d)))
        for r in sums.collect():
            centroids[r[0]] = [x // r[1] for x in r[2:]]
    return centroids


def cluster(embeddings: DataFrame, k: int = 16, rounds: int = 3, dimensions: int = 64, scale: int = 64, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of each kept row of embeddings (vec_id, embedding), written to the shared folder, and the final centroids.

    Rows whose embedding is null, of another length, or has a null or non-finite component are left out. Repeated rows
    and rows without vec_id are clustered each. With fewer than k rows there are as many centroids as rows; an empty
    table gives an empty result and no centroids. Extra columns are ignored. Components beyond LIMIT after scaling raise
    an error, as their distances don't fit a long.
    """
    vectors = integer_vectors(embeddings, dimensions, scale)
    start = hashed_start(vectors, k, seed)
    if not len(start):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), start.reshape(0, dimensions)
    leaves = trees(vectors, dimensions)
    centroids = fit(leaves, start, rounds)
    return written(leaves.mapInArrow(_assign(centroids), "vec_id long, cluster int, distance long")), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """`assigned` with cluster_inertia, inertia, and centroid_sha256 of each row's cluster; a row a cluster is broadcast."""
    by_cluster = {r[0]: r[1] for r in assigned.groupBy("cluster").agg(F.sum("distance")).collect()}
    total = sum(by_cluster.values())

    def of(values: dict, kind: str) -> Column:
        return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), F.col("cluster")).cast(kind) if values else F.lit(None).cast(kind)

    marks = {c: ",".join(map(str, centroids[c].tolist())) for c in by_cluster}
    return assigned.select("*", of(by_cluster, "long").alias("cluster_inertia"), F.lit(total).cast("long").alias("inertia"), F.sha2(of(marks, "string").cast("binary"), 256).alias("centroid_sha256"))
