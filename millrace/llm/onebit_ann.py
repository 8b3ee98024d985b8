"""Nearest neighbours by randomly rotated one-bit codes with error bounds.

A vector is centred, rotated by one random orthogonal matrix and kept as the signs of its coordinates, packed to bits,
with two scalars: its distance from the centre and the inner product of its unit vector with its code. A query's
rotated unit vector is cut to PLANES bits a coordinate, whose planes are packed likewise: the inner product with a code
is the sum of the planes' counts of common bits, by AND and population count on packed words. From it the inner product
with the vector is estimated without bias; the error is at most eps * sqrt((1 - f^2) / f^2 / (d - 1)) of the lengths
with high probability, and what the cutting can add. A vector is compared exactly only if the lower bound of its
distance is not above the k-th nearest of those that are nearest by estimate.

All vectors are indexed. Queries and vectors are dealt over a grid of cells of bounded size, so that neither needs to
be held whole; each cell gives a query's k nearest in it, and the k nearest of those are the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_batches, spread, stash

PLANES = 6
CELL_BYTES, QUERY_BYTES = 16 << 20, 4 << 20  # of doubles
_INDEX = "vec_id bigint, vector binary, code binary, radius double, fit double"
_FOUND = "query bigint, query_id bigint, vec_id bigint, score double"


def rotation(dims: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, uniform over all."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def lengths_of(v: np.ndarray) -> np.ndarray:
    """Euclidean lengths of rows; no square leaves the range of doubles."""
    top = np.abs(v).max(axis=1, initial=0.0)
    scale = np.where(top > 0, top, 1.0)
    return scale * np.sqrt(((v / scale[:, None]) ** 2).sum(axis=1))


def encode(vectors: np.ndarray, centre: np.ndarray, rotate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, whole words a row, distance from the centre, and inner product of unit vector and unit code (1 for the centre)."""
    gap = vectors / 2 - centre / 2  # halves, so that no difference overflows
    half = lengths_of(gap)
    unit = gap / np.where(half > 0, half, 1)[:, None] @ rotate
    fit = np.abs(unit).sum(axis=1) / np.sqrt(vectors.shape[1])
    with np.errstate(over="ignore"):
        return pack(unit > 0), half * 2, np.where(half > 0, fit, 1.0)


def pack(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as words of 64 bits, filled up with zeros."""
    return np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64))), axis=1).view(np.uint64)


def inner_products(unit: np.ndarray, codes: np.ndarray, planes: int = PLANES) -> tuple[np.ndarray, float]:
    """Inner products of a unit vector with unit codes, by counts of common bits, and the most they can be off.

    The vector is low + step * n, n of `planes` bits: with s = +-1 a code, sum s (low + step n) is
    2 (low * ones + step * common) - (low * d + step * sum n), where common adds up the planes' common bits.
    """
    dims = len(unit)
    low = float(unit.min())
    step = (float(unit.max()) - low) / ((1 << planes) - 1) or 1.0
    n = np.rint((unit - low) / step).astype(np.int64)
    common = np.zeros(len(codes), np.int64)
    for b in range(planes):
        plane = pack((n >> b & 1).astype(bool)[None, :])[0]
        common += np.bitwise_count(codes & plane).sum(axis=1, dtype=np.int64) << b
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    found = 2 * (low * ones + step * common) - (low * dims + step * n.sum())
    return found / np.sqrt(dims), float(np.abs(unit - (low + step * n)).sum() / np.sqrt(dims))


def exact(query: np.ndarray, columns: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Euclidean distances of query to columns[:, some], squares added in the order of coordinates.

    Where squares leave the range of doubles the distance is worked out scaled.
    """
    out = np.zeros(len(some))
    with np.errstate(over="ignore", under="ignore"):
        for j, q in enumerate(query):
            out += (columns[j, some] - q) ** 2
        out = np.sqrt(out)
    odd = np.flatnonzero(~np.isfinite(out) | (out < 1e-150))
    if len(odd):
        with np.errstate(over="ignore"):
            out[odd] = lengths_of(columns[:, some[odd]].T / 2 - query / 2) * 2
    return out


class Cell:
    """Some vectors with their codes, to be searched."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, codes: np.ndarray, radius: np.ndarray, fit: np.ndarray) -> None:
        self.ids, self.rows, self.columns, self.codes, self.radius = ids, rows, np.ascontiguousarray(vectors.T), codes, radius
        self.fit = np.maximum(fit, 1e-9)
        self.spread = np.sqrt(np.maximum(1 - self.fit**2, 0)) / self.fit / np.sqrt(max(vectors.shape[1] - 1, 1))

    def nearest(self, query: np.ndarray, own: int, length: float, unit: np.ndarray, k: int, eps: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest of the vectors but row `own`; ties to smaller ids."""
        about, off = inner_products(unit, self.codes)
        about, error = about / self.fit, eps * self.spread + off / self.fit
        scale = np.maximum(np.maximum(self.radius, length), 1e-300)
        r, h = self.radius / scale, length / scale
        with np.errstate(invalid="ignore"):
            likely = scale * np.sqrt(np.maximum(r * r + h * h - 2 * r * h * np.minimum(about, 1), 0))
            low = scale * np.sqrt(np.maximum(r * r + h * h - 2 * r * h * np.minimum(about + error, 1), 0)) * (1 - 1e-9)
        likely[np.isnan(likely)] = 0  # beyond doubles: compared exactly
        low[~np.isfinite(low)] = 0
        others = np.flatnonzero(self.rows != own)
        if not len(others):
            return self.ids[:0], np.empty(0)
        first = others if len(others) <= 4 * k else others[np.argpartition(likely[others], 4 * k)[: 4 * k]]
        d = exact(query, self.columns, first)
        worst = np.partition(d, k - 1)[k - 1] if len(d) >= k else np.inf
        live = others[low[others] <= worst]
        found = np.union1d(first, live)
        d = exact(query, self.columns, found)
        by = np.lexsort((self.ids[found], d))[:k]
        return self.ids[found[by]], d[by]


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id bigint, vector array<double> of rows that take part: id not null, components finite, not all zero."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("vector"), F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False)).alias("_ok")).where("_ok and vec_id is not null").drop("_ok")


def index(vectors: DataFrame, *, seed: int = 11) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Codes of all vectors(vec_id, vector) of the most common length (ties: the greater), the centre, the rotation.

    The centre is the coordinates' medians, which a few huge vectors don't move.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    lengths = vectors.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if lengths is None:
        return spark.createDataFrame([], _INDEX), np.zeros(0), np.zeros((0, 0))
    dims = lengths["n"]
    same = vectors.where(F.size("vector") == dims)
    middles = same.select(F.posexplode("vector").alias("i", "x")).groupBy("i").agg(F.percentile_approx("x", 0.5, F.lit(200)).alias("x")).collect()  # one row a dimension
    centre = np.zeros(dims)
    for r in middles:
        centre[r["i"]] = r["x"]
    rotate = rotation(dims, seed)

    def codes(batches):
        for b in batches:
            if b.num_rows:
                v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dims)
                bits, radius, fit = encode(v, centre, rotate)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in v], pa.binary()), pa.array([x.tobytes() for x in bits], pa.binary()), pa.array(radius), pa.array(fit)], names=["vec_id", "vector", "code", "radius", "fit"])

    return same.mapInArrow(codes, _INDEX), centre, rotate


def _matrix(column: pa.ChunkedArray, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def nearest(df: DataFrame, *, every: int = 100, k: int = 10, eps: float = 4.0, cell: int | None = None, query_cell: int | None = None, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row whose id is divisible by `every`.

    score is the Euclidean distance of the original vectors in double precision; rank is from 1, ties to the smaller
    id; a query with fewer candidates has fewer rows. Every row but the query's own is a candidate, rows that repeat its
    id or vector too; each of several query rows of one id has its own k rows under that id. Rows take no part whose id
    is null or whose vector is null, zero, holds nulls or non-finite numbers, or is not of the most common length.
    Vectors may be as large as doubles go; a distance beyond them is infinite. Other columns are ignored. An empty table
    gives an empty result.

    A cell holds CELL_BYTES of vectors and is asked QUERY_BYTES of queries, or `cell` and `query_cell` rows.
    """
    spark = df.sparkSession
    codes, centre, rotate = index(usable(spread(df), vec_id, vector))
    codes = stash(codes.withColumn("row", F.monotonically_increasing_id()), "ann-index")
    dims, n = len(centre), codes.count()
    q = codes.where(F.col("vec_id") % every == 0)
    cell, query_cell = cell or max(1024, CELL_BYTES // (8 * max(dims, 1))), query_cell or max(256, QUERY_BYTES // (8 * max(dims, 1)))
    across, down = max(1, -(-n // cell)), max(1, -(-q.count() // query_cell))
    deal = lambda parts, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(parts)).cast("int")
    held = codes.withColumn("x", deal(across, 1)).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    asked = q.select("vec_id", "vector", "row").withColumn("y", deal(down, 2)).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    words = -(-dims // 64)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out_r, out_q, out_v, out_d = [], [], [], []
        if left.num_rows and right.num_rows:
            some = Cell(left.column("vec_id").to_numpy(), left.column("row").to_numpy(), _matrix(left.column("vector"), np.float64, dims), _matrix(left.column("code"), np.uint64, words), left.column("radius").to_numpy(), left.column("fit").to_numpy())
            queries = _matrix(right.column("vector"), np.float64, dims)
            gap = queries / 2 - centre / 2
            half = lengths_of(gap)
            units = gap / np.where(half > 0, half, 1)[:, None] @ rotate
            with np.errstate(over="ignore"):
                length = half * 2
            for j, (row, own) in enumerate(zip(right.column("row").to_pylist(), right.column("vec_id").to_pylist())):
                i, d = some.nearest(queries[j], row, length[j], units[j], k, eps)
                out_r += [row] * len(i)
                out_q += [own] * len(i)
                out_v += i.tolist()
                out_d += d.tolist()
        return pa.table([pa.array(out_r, pa.int64()), pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_d, pa.float64())], names=["query", "query_id", "vec_id", "score"])

    found = held.groupBy("x", "y").cogroup(asked.groupBy("x", "y")).applyInArrow(search, _FOUND)
    by = W.partitionBy("query").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
