"""Joins and running sums that no hot key can bring together in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.sinks import stash

OFTEN = 1000


def join_often(rows: DataFrame, once: DataFrame, keys: Sequence[str], size: str | None = None) -> DataFrame:
    """rows left join once, which has one row a key; null keys are equal.

    Keys that hold more than one in OFTEN of the rows, fewer than OFTEN keys, are joined by broadcast: no task gets a hot
    key's rows, and one that `once` lacks gets its nulls there too. They are counted first, unless once's column `size` says
    how many rows a key has (then once has every key).
    """
    if size is None:
        counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        total = rows.count()
        often = counted.where(F.col("_n") > total / OFTEN).drop("_n")
        hot = stash(_equal(often, once, keys, "left"), "often")
    else:
        total = once.agg(F.sum(size)).first()[0] or 0
        hot = stash(once.where(F.col(size) > total / OFTEN), "often")
    if hot.isEmpty():
        return _equal(rows, once, keys, "left")
    rest = _equal(rows, F.broadcast(hot.select(*keys)), keys, "left_anti")
    return _equal(rows, F.broadcast(hot), keys, "inner").unionByName(_equal(rest, once, keys, "left"))


def _equal(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    renamed = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        on = same if on is None else on & same
    joined = left.join(renamed, on, how)
    return joined.drop(*[f"_k_{k}" for k in keys])


def running_sums(rows: DataFrame, by: Sequence[str], order: Sequence[Column], values: Mapping[str, Column]) -> DataFrame:
    """rows with sums of values over those up to each, by an order without ties, for each of by.

    Rows are dealt by ranges of the order, each range is summed by itself and kept, and what the ranges before it hold of a
    key, one row for each of by and range, is added.
    """
    part = "_part"
    ranged = rows.repartitionByRange(*[F.col(c) for c in by], *order)
    kept = stash(ranged.withColumns({part: F.spark_partition_id(), **{f"_v_{k}": v for k, v in values.items()}}), "running")
    inside = W.partitionBy(part, *by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = kept.groupBy(part, *by).agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in values])
    earlier = W.partitionBy(*(by or [F.lit(0)])).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    before = sums.select(part, *by, *[F.coalesce(F.sum(f"_s_{k}").over(earlier), F.lit(0)).alias(f"_b_{k}") for k in values])
    at = kept.withColumns({f"_i_{k}": F.sum(f"_v_{k}").over(inside) for k in values})
    both = _equal(at, before, [part, *by], "inner")
    drop = [part, *[f"_{x}_{k}" for k in values for x in "vib"]]
    return both.withColumns({k: F.col(f"_b_{k}") + F.col(f"_i_{k}") for k in values}).drop(*drop)
