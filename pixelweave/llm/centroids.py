"""Lloyd's clustering in whole numbers, on distinct vectors with their multiplicities.

1. Components become floor(scale * x). A vector is kept if it has exactly dim components, none null or not finite.
2. Equal vectors become one with their number (a partial aggregation before the shuffle).
3. The first centroids are the kept vectors whose ids have the smallest hashes. Each round reads the distinct vectors once:
   tasks assign them to the nearest centroid and sum them, weighted, as whole numbers; k rows of sums come back, and a
   centroid becomes the floor of sum over number. Empty ones stay.
4. Assignments return to the vectors by value. Vectors that make up a thousandth of all rows or more (so a thousand at most)
   are broadcast, the others joined, so no group of copies meets in one task.

Cases: an empty table, or one without vectors to keep, gives an empty result; with fewer than k kept vectors there are as
many centroids as vectors; equal vectors may be several first centroids, of which the smallest number takes all; a null id
counts as an empty one where it is hashed, and of equal hashes the smaller vector comes first; components beyond 2^26
after scaling count as +-2^26, so that squared distances fit 64 bits; sums of distances beyond 64 bits give null; columns
other than the named ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, small_batches

DIM, SCALE, K, ROUNDS, SEED = 64, 1024, 8, 10, 3
MOST = 1 << 26
#: Below this all sums of products of a distance are exact in doubles, which matrix products are fast in.
EXACT = 1 << 22
HOT_SHARE = 1000


def _quantised(dim: int, scale: int):
    """(vec_id, packed) of the kept vectors: 16-bit numbers where all fit, else 32-bit ones, so equal vectors are equal bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            b = b.filter(pc.fill_null(pc.equal(pc.list_value_length(lists), dim), False))
            values = b.column(1).flatten()
            x = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # nulls become NaN
            whole = np.isfinite(x).all(1)
            with np.errstate(over="ignore", invalid="ignore"):
                q = np.clip(np.floor(scale * x[whole]), -MOST, MOST).astype(np.int32)
            small = (np.abs(q) < 1 << 15).all(1) if len(q) else np.empty(0, bool)
            packed = [(r.astype("<i2") if s else r.astype("<i4")).tobytes() for r, s in zip(q, small.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(whole)), pa.array(packed, pa.binary())], names=["vec_id", "packed"])

    return run


def unpacked(packed: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(packed, "<i2" if len(packed) == 2 * dim else "<i4").astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each row, all exact; of ties the smallest number."""
    kind = np.float64 if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT else np.int64
    a, c = x.astype(kind), centroids.astype(kind)
    d = ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
    near = d.argmin(1)
    return near, d[np.arange(len(d)), near]


def _assigned(centroids: np.ndarray, dim: int, sums: bool):
    """(packed, n, cluster, distance), or with sums the task's (cluster, place, total): a place beyond the components is the number
    of vectors, and one beyond that their weighted distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), dim + 2), object)
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([unpacked(p, dim) for p in b.column("packed").to_pylist()])
            n = b.column("n").to_numpy()
            cluster, distance = nearest(x, centroids)
            if not sums:
                yield pa.RecordBatch.from_arrays([b.column("packed"), b.column("n"), pa.array(cluster, pa.int32()), pa.array(distance)], names=["packed", "n", "cluster", "distance"])
                continue
            for k in np.unique(cluster):
                of = cluster == k
                # weighted sums by halves of the numbers, so that none leaves 64 bits
                for half, shift in ((n[of] & 0xFFFF, 0), (n[of] >> 16 & 0xFFFF, 16), (n[of] >> 32, 32)):
                    total[k, :dim] += (half[:, None] * x[of]).sum(0).astype(object) << shift
                total[k, dim] += int(n[of].sum())
                total[k, dim + 1] += sum(map(int.__mul__, n[of].tolist(), distance[of].tolist()))
        if sums:
            cluster, place = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(place, pa.int32()), pa.array([str(v) for v in total[cluster, place]], pa.string())], names=["cluster", "place", "total"])

    return run


def _totals(distinct: DataFrame, centroids: np.ndarray, dim: int) -> list[list[int]]:
    """Sums by cluster: at most k times the components' number of rows come back."""
    rows = distinct.mapInArrow(_assigned(centroids, dim, True), "cluster int, place int, total string")
    out = [[0] * (dim + 2) for _ in centroids]
    for r in rows.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        out[r.cluster][r.place] = int(r.total)
    return out


def _moved(centroids: np.ndarray, totals: list[list[int]], dim: int) -> np.ndarray:
    """Each centroid that has vectors becomes their mean, rounded down."""
    return np.array([[s // t[dim] for s in t[:dim]] if t[dim] else c.tolist() for t, c in zip(totals, centroids, strict=True)], np.int64)


def _long(x: int) -> int | None:
    return x if x < 1 << 63 else None


def clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, scale: int = SCALE, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    spark = vectors.sparkSession
    small_batches(spark, rows=4096)
    rows = vectors.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>")).mapInArrow(_quantised(dim, scale), "vec_id long, packed binary")
    distinct = cut(rows.groupBy("packed").agg(F.count("*").alias("n")), "distinct")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = rows.withColumn("order", order).orderBy("order", "packed").limit(k).collect()
    centroids = np.stack([unpacked(r.packed, dim) for r in first]) if first else np.empty((0, dim), np.int64)
    for _ in range(rounds if first else 0):
        centroids = _moved(centroids, _totals(distinct, centroids, dim), dim)
    totals = _totals(distinct, centroids, dim) if first else []
    n, inertia = sum(t[dim] for t in totals), _long(sum(t[dim + 1] for t in totals))
    rest = [(i, _long(t[dim + 1]), inertia, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, (t, c) in enumerate(zip(totals, centroids, strict=True))]
    told = spark.createDataFrame(rest, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    assigned = cut(distinct.mapInArrow(_assigned(centroids, dim, False), "packed binary, n long, cluster int, distance long"), "assigned")
    discard(distinct)
    is_hot = F.col("n") * HOT_SHARE >= max(1, n)
    hot = assigned.where(is_hot).select("packed", F.col("cluster").alias("hot_cluster"), F.col("distance").alias("hot_distance"))
    marked = rows.join(F.broadcast(hot), "packed", "left")
    common = marked.where("hot_cluster IS NOT NULL").select("vec_id", F.col("hot_cluster").alias("cluster"), F.col("hot_distance").alias("distance"))
    other = marked.where("hot_cluster IS NULL").select("vec_id", "packed").join(assigned.where(~is_hot).select("packed", "cluster", "distance"), "packed").select("vec_id", "cluster", "distance")
    out = common.unionByName(other).join(F.broadcast(told), "cluster")
    return out.select(F.col("vec_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
