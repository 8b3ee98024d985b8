"""Masks as runs: area, box and overlap without a row a pixel.

A mask of an image of some width is an array of structs (start, length), the runs of its set pixels counted row by row from 0,
in order and apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RUNS = "array<struct<start:bigint,length:bigint>>"


def runs_of(bits: Column) -> Column:
    """Runs of an array of booleans; null counts as false."""
    begin = F.struct(F.array().cast(RUNS).alias("runs"), F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("held"))
    closed = lambda a: F.when(a["held"] > 0, F.concat(a["runs"], F.array(F.struct((a["at"] - a["held"]).alias("start"), a["held"].alias("length"))))).otherwise(a["runs"])

    def step(a: Column, on: Column) -> Column:
        on = F.coalesce(on, F.lit(False))
        return F.struct(F.when(on, a["runs"]).otherwise(closed(a)).alias("runs"), (a["at"] + 1).alias("at"), F.when(on, a["held"] + 1).otherwise(F.lit(0).cast("bigint")).alias("held"))

    return F.aggregate(bits, begin, step, closed)


def area(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0).cast("bigint"), lambda n, r: n + r["length"])


def box(runs: Column, width: Column) -> Column:
    """x, y, w, h around the set pixels; null without any. A run that goes on in the next row touches both edges."""
    last = lambda r: r["start"] + r["length"] - 1
    row = lambda p: F.floor(p / width)
    wraps = lambda r: row(r["start"]) < row(last(r))
    left = F.array_min(F.transform(runs, lambda r: F.when(wraps(r), F.lit(0).cast("bigint")).otherwise(r["start"] % width)))
    right = F.array_max(F.transform(runs, lambda r: F.when(wraps(r), width - 1).otherwise(last(r) % width)))
    top, bottom = F.array_min(F.transform(runs, lambda r: row(r["start"]))), F.array_max(F.transform(runs, lambda r: row(last(r))))
    return F.when(F.size(runs) > 0, F.array(left, top, right - left + 1, bottom - top + 1))


def overlap(masks: DataFrame, key: Sequence[str], a: str, b: str) -> DataFrame:
    """key, area_a, area_b, both, either, iou, dice_loss of two columns of runs.

    The ends of runs are put in order and covered lengths are added up between them: as many rows as there are ends. The
    overlap of two empty masks is 0; the loss is smoothed by 1.
    """
    ends = lambda c, x, y: F.transform(F.coalesce(F.col(c), F.array().cast(RUNS)), lambda r: F.array(F.struct(r["start"].alias("at"), F.lit(x).alias("da"), F.lit(y).alias("db")), F.struct((r["start"] + r["length"]).alias("at"), F.lit(-x).alias("da"), F.lit(-y).alias("db"))))
    every = masks.select(*key, F.explode_outer(F.flatten(F.concat(ends(a, 1, 0), ends(b, 0, 1)))).alias("e")).select(*key, "e.*")
    order = W.partitionBy(*key).orderBy("at")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    covered = every.select(*key, (F.lead("at").over(order) - F.col("at")).alias("n"), F.sum("da").over(upto).alias("a"), F.sum("db").over(upto).alias("b"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    in_a, in_b = F.col("a") > 0, F.col("b") > 0
    sums = covered.groupBy(*key).agg(total(in_a).alias("area_a"), total(in_b).alias("area_b"), total(in_a & in_b).alias("both"), total(in_a | in_b).alias("either"))
    iou = F.when(F.col("either") > 0, F.col("both") / F.col("either")).otherwise(0.0)
    return sums.withColumns({"iou": iou, "dice_loss": 1 - (2 * F.col("both") + 1) / (F.col("area_a") + F.col("area_b") + 1)})
