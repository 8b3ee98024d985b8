"""Centroid clustering in exact integers: float32 products shortlist the centroids, integers decide.

A vector's components become integers floor(scale * x). For each batch of vectors one float32 matrix product with the
centroids gives every squared distance within a proven rounding error. Centroids whose interval overlaps the best one's are
computed again in 64-bit integers, and of equal distances the lowest number wins, so that the result does not depend on
rounding, on the order of rows or on how they are dealt.

What comes of each case: vectors that are null, have another number of components, or hold a null or non-finite component
take no part. Repeated rows are vectors of their own, each with its row in the result. A null id is an id; it seeds only when
there are too few others. With fewer vectors than `k` there are as many centroids as vectors; an empty table has none and
gives no rows. A component beyond 2^27 in size as integer is an error that says so: its squared distance would not fit a long.
Only the id and the vector are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

LARGEST = 1 << 27
CELLS = 1 << 21  # of a matrix of vectors by centroids that a task holds at once
UNIT = 2.0**-24  # rounding unit of float32


def usable(vector: str | Column, dims: int) -> Column:
    """Whether a vector has dims components, none null or non-finite."""
    v = F.col(vector) if isinstance(vector, str) else vector
    inf = float("inf")
    return F.coalesce((F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & (x > -inf) & (x < inf)), F.lit(False))


def to_integers(column: pa.Array, dims: int, scale: float) -> np.ndarray:
    """floor(scale * x) of a batch of usable vectors, n by dims."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).reshape(-1, dims)
    if x.size and np.abs(x).max() > LARGEST:
        raise ArithmeticError(f"a component is beyond {LARGEST} as integer: squared distances do not fit a long")
    return x.astype(np.int64)


def screen(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """n by k booleans: centroids that may be the nearest one, by float32 products and their greatest rounding error.

    A product of d terms is off by at most g |x| |c| for any order of summation, g = (d + 4) u / (1 - (d + 4) u): d - 1 sums,
    a product, and the rounding of both factors to float32. Norms are rounded up.
    """
    d = x.shape[1]
    g = (d + 4) * UNIT / (1 - (d + 4) * UNIT)
    up = 1 + 1e-9
    dot = (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    square = (c * c).sum(1).astype(np.float64)
    norms = np.sqrt((x.astype(np.float64) ** 2).sum(1)) * up, np.sqrt(square) * up
    score = square[None, :] - 2 * dot  # squared distance less |x|^2, which all centroids share
    off = (2 * g * up) * norms[0][:, None] * norms[1][None, :] + 2.0**-48 * (square[None, :] + 2 * np.abs(dot))
    return score - off <= (score + off).min(1, keepdims=True)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid of each vector (the lowest of equals), the exact squared distance, and for how many
    vectors more than one centroid was computed in integers."""
    best, again = np.empty(len(x), np.int64), 0
    step = max(CELLS // len(c), 1)
    for at in range(0, len(x), step):
        part = x[at : at + step]
        maybe = screen(part, c)
        found = maybe.argmax(1)
        open_ = np.flatnonzero(maybe.sum(1) > 1)
        again += len(open_)
        if len(open_):
            exact = np.full((len(open_), len(c)), np.iinfo(np.int64).max)
            row, col = np.nonzero(maybe[open_])
            for i in range(0, len(row), 1 << 16):
                r, k = row[i : i + (1 << 16)], col[i : i + (1 << 16)]
                exact[r, k] = ((part[open_[r]] - c[k]) ** 2).sum(1)
            found[open_] = exact.argmin(1)
        best[at : at + step] = found
    return best, ((x - c[best]) ** 2).sum(1) if len(x) else np.empty(0, np.int64), again


def _sums(dims: int, scale: float, centroids: np.ndarray):
    """One row a task and centroid: how many vectors it got and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for b in batches:
            x = to_integers(b.column(0), dims, scale)
            if len(x):
                best = nearest(x, centroids)[0]
                order = np.argsort(best, kind="stable")
                have, start = np.unique(best[order], return_index=True)
                total[have] += np.add.reduceat(x[order], start, axis=0)
                n += np.bincount(best, minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"]
        )

    return run


def _assign(dims: int, scale: float, centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = to_integers(b.column(1), dims, scale)
            best, far, _ = nearest(x, centroids) if len(x) else (np.empty(0), np.empty(0), 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.int32()), pa.array(far, pa.int64())], names=["id", "cluster", "distance"])

    return run


def seeds(vectors: DataFrame, key: str, vector: str, dims: int, scale: float, k: int, seed: str) -> np.ndarray:
    """The integers of the k vectors of least sha256 of `<seed>:<id>`; of equal ones the least components come first."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))
    first = vectors.select(rank.alias("r"), whole.alias("v")).orderBy(F.col("r").asc_nulls_last(), "v").limit(k).collect()  # k rows
    out = np.array([r["v"] for r in first], np.int64).reshape(-1, dims)
    if out.size and (out.max() > LARGEST or out.min() < -LARGEST):
        raise ArithmeticError(f"a component is beyond {LARGEST} as integer: squared distances do not fit a long")
    return out


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", *, dims: int = 64, scale: float = 64.0, k: int = 16, rounds: int = 3, seed: str = "1") -> tuple[DataFrame, DataFrame]:
    """(key, cluster, distance of each usable vector; cluster, n, inertia, centroid of each centroid).

    Each round is one pass: tasks add up their vectors by centroid, and the k centroids' sums reach the driver, which divides them
    exactly, rounding down. An empty centroid stays where it was. Tasks hold one batch of vectors and the k centroids.
    """
    spark = vectors.sparkSession
    kept = vectors.select(key, vector).where(usable(vector, dims))
    centroids = seeds(kept, key, vector, dims, scale, k, seed)
    id_type = kept.schema[key].dataType.simpleString()
    if not len(centroids):
        return spark.createDataFrame([], f"`{key}` {id_type}, cluster int, distance bigint"), spark.createDataFrame([], "cluster int, n bigint, inertia bigint, centroid array<bigint>")
    for _ in range(rounds):
        parts = kept.select(vector).mapInArrow(_sums(dims, scale, centroids), "cluster int, n bigint, sums array<bigint>")
        each = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i")
        for r in each.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(20,0)")).alias("s")).collect():  # k times dims rows at most
            centroids[r["cluster"], r["i"]] = int(r["s"]) // r["n"]
    assigned = stash(kept.select(F.col(key).alias("id"), vector).mapInArrow(_assign(dims, scale, centroids), f"id {id_type}, cluster int, distance bigint"), "clusters")
    # a sum beyond a long is null
    size = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("distance").cast("decimal(20,0)")).try_cast("bigint").alias("inertia"))
    stated = spark.createDataFrame([(i, [int(v) for v in c]) for i, c in enumerate(centroids)], "cluster int, centroid array<bigint>")
    about = F.broadcast(stated).join(size, "cluster", "left").select("cluster", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), 0).otherwise(F.col("inertia")).alias("inertia"), "centroid")
    return assigned.withColumnRenamed("id", key), about


def with_digests(assigned: DataFrame, about: DataFrame) -> DataFrame:
    """assigned with cluster_inertia, inertia (of all) and centroid_sha256 of its centroid's components joined by commas."""
    all_ = about.agg(F.sum(F.col("inertia").cast("decimal(20,0)")).try_cast("bigint").alias("inertia"))
    one = about.select("cluster", F.col("inertia").alias("cluster_inertia"), F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256")).crossJoin(F.broadcast(all_))  # one row
    return assigned.join(F.broadcast(one), "cluster")  # k rows
