"""Boxes that overlap, by a grid; greedy suppression and matching over the overlaps alone."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil, log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import stash

EDGES_IN_TASK = 1_000_000  # overlaps of one image and label that are decided one after the other


_CORNERS = ("x1", "y1", "x2", "y2")


def _side(rows: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """by, the struct as `name`, and corners and area as plain columns, of the boxes that have an area."""
    c = [F.col("v.b")[i] for i in range(4)]
    flat = rows.select(*by, F.col("v").alias(name), *[x.alias(f"{name}_{k}") for x, k in zip(c, _CORNERS)])
    x1, y1, x2, y2 = (F.col(f"{name}_{k}") for k in _CORNERS)
    inf = float("inf")
    kept = flat.where((x1 > -inf) & (y1 > -inf) & (x2 > x1) & (y2 > y1) & (x2 < inf) & (y2 < inf))
    return kept.withColumn(f"{name}_area", (x2 - x1) * (y2 - y1))


def _in_cells(rows: DataFrame, name: str) -> DataFrame:
    """rows with x and y of the cells of their level that the box touches: two by two at most for its own level or above."""
    size = F.pow(F.lit(2.0), F.col("_level"))
    at = lambda k: F.floor(F.col(f"{name}_{k}") / size)
    return rows.withColumn("x", F.explode(F.sequence(at("x1"), at("x2")))).withColumn("y", F.explode(F.sequence(at("y1"), at("y2"))))


def _by_grid(left: DataFrame, right: DataFrame, by: Sequence[str], least: float) -> DataFrame:
    def sized(rows: DataFrame, name: str) -> DataFrame:
        """With the power of two of the least square cell as large as the box."""
        side = F.greatest(F.col(f"{name}_x2") - F.col(f"{name}_x1"), F.col(f"{name}_y2") - F.col(f"{name}_y1"))
        return rows.withColumn("_own", F.ceil(F.log2(side)).cast("int"))

    left, right = sized(left, "l"), sized(right, "r")
    if least > 0:
        up = lambda own: F.sequence(own, own + ceil(log2(1 / min(least, 1.0))) + 1)
    else:
        seen = sorted({r[0] for side in (left, right) for r in side.select("_own").distinct().collect()}) or [0]  # a few levels
        up = lambda own: F.filter(F.array(*[F.lit(x) for x in seen]), lambda x: x >= own)
    held = lambda rows, name: _in_cells(rows.withColumnRenamed("_own", "_level"), name)
    looking = lambda rows, name: _in_cells(rows.withColumn("_level", F.explode(up(F.col("_own")))), name)
    size = F.pow(F.lit(2.0), F.col("_level"))
    corner = lambda k: F.floor(F.greatest(f"l_{k}", f"r_{k}") / size)
    owner = (F.col("x") == corner("x1")) & (F.col("y") == corner("y1"))
    keys = [*by, "_level", "x", "y"]
    up_left = looking(left, "l").join(held(right, "r").hint("merge"), keys).where(owner)
    up_right = looking(right, "r").join(held(left, "l").hint("merge"), keys).where(owner & (F.col("_own") < F.col("_level")))
    return up_left.drop("_own", "_level", "x", "y").unionByName(up_right.drop("_own", "_level", "x", "y"))


FEW = 64


def overlaps(left: DataFrame, right: DataFrame, by: Sequence[str], least: float = 0.0, few: int = FEW) -> DataFrame:
    """by, l, r, iou of boxes of left and right, equal in `by`, that overlap by `least` or more (and by more than 0).

    Both tables have by and `v`, a struct with `b`: the corners x1, y1, x2, y2 as doubles; l and r are such structs.
    Groups of up to `few` boxes a side, counted first, meet as they are. In larger ones a box lies on the level of its size,
    in the cells of that level's grid that it touches, and looks at the cells that it touches on each level from its own
    upwards. Two boxes meet where the lower corner of their intersection lies, once; boxes far from each other never do. A
    common `least` bounds how much larger the other box can be, and so the levels.
    Boxes without area, or with a corner missing, overlap with none.
    """
    l_, r_ = _side(left, by, "l"), _side(right, by, "r")
    sizes = l_.select(*by).unionAll(r_.select(*by)).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    large = stash(sizes.where(F.col("n") > 2 * few).select(*by), "large")
    if large.isEmpty():
        met = l_.join(r_.hint("merge"), list(by))
    else:
        part = lambda rows, how: rows.join(large, list(by), how)
        met = part(l_, "left_anti").join(part(r_, "left_anti").hint("merge"), list(by))
        met = met.unionByName(_by_grid(part(l_, "left_semi"), part(r_, "left_semi"), by, least))
    c = F.col
    met = met.where((c("l_x1") < c("r_x2")) & (c("r_x1") < c("l_x2")) & (c("l_y1") < c("r_y2")) & (c("r_y1") < c("l_y2")))
    shared = (F.least("l_x2", "r_x2") - F.greatest("l_x1", "r_x1")) * (F.least("l_y2", "r_y2") - F.greatest("l_y1", "r_y1"))
    both = met.select(*by, "l", "r", (c("l_area") + c("r_area")).alias("_areas"), shared.alias("_shared"))
    both = both.where((c("_shared") > 0) & (c("_shared") >= F.lit(least * (1 - 1e-9)) * (c("_areas") - c("_shared"))))
    out = both.select(*by, "l", "r", F.try_divide("_shared", c("_areas") - c("_shared")).alias("iou"))
    return out.where(c("iou") >= least) if least > 0 else out


def _beaten(edges: DataFrame) -> DataFrame:
    """_id of boxes that go, of edges(by, winner, loser, at): decided in the loser's order, one task an image and label.

    A task sees its edges in order and holds the losers of one image and label.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, gone = None, set()
        for b in batches:
            new = []
            for g, w, x in zip(*[b.column(i).to_pylist() for i in range(3)]):
                if g != group:
                    group, gone = g, set()
                if w not in gone and x not in gone:
                    gone.add(x)
                    new.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64())], names=["_id"])

    return edges.repartition("group").sortWithinPartitions("group", "at", "loser").select("group", "winner", "loser").mapInArrow(run, "_id bigint")


def suppress(boxes: DataFrame, image: str, label: str, box: Sequence[str], score: str, tie: Sequence[str], threshold: float = 0.85, most: int = EDGES_IN_TASK) -> DataFrame:
    """Greedy suppression in each image: by falling score (ties by `tie`), a box goes if one kept of its label overlaps by
    threshold or more. Whole rows of boxes come back.

    Overlaps come from the grid, so that boxes of one image are compared in many tasks, and form a graph from the better
    box to the worse. Where an image and label has more than `most` overlaps, rounds on the whole graph take the boxes that
    no other outranks, remove what they overlap, and repeat; what is left is decided in order.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be above 0")
    held = stash(boxes.withColumn("_id", F.monotonically_increasing_id()), "boxes")
    rank = F.struct((-F.col(score)).alias("s"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(tie)], F.col("_id").alias("id"))
    v = held.select(F.struct(F.col(image).alias("i"), F.col(label).alias("l")).alias("group"), F.struct(F.array(*[F.col(c).cast("double") for c in box]).alias("b"), rank.alias("o")).alias("v"))
    better = overlaps(v, v, ["group"], threshold).where("l.o < r.o")
    # the graph of all images, both of its ends by their number
    edges = stash(better.select("group", F.col("l.o.id").alias("winner"), F.col("r.o.id").alias("loser"), F.col("r.o").alias("at")), "overlaps")
    gone = None
    # all overlaps together are counted first, which reads no column; the count by group only where they are many
    while edges.count() > most and not edges.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).isEmpty():
        first = edges.join(edges.select(F.col("loser").alias("winner")).distinct(), "winner", "left_anti")
        beaten = stash(first.select(F.col("loser").alias("_id")).distinct(), "beaten")
        out = lambda end: beaten.withColumnRenamed("_id", end)
        edges = stash(edges.join(out("winner"), "winner", "left_anti").join(out("loser"), "loser", "left_anti"), "overlaps")
        gone = beaten if gone is None else gone.unionByName(beaten)
    rest = _beaten(edges)
    return held.join(rest if gone is None else gone.unionByName(rest), "_id", "left_anti").select(*boxes.columns)


def greedy_match(predicted: DataFrame, true: DataFrame, image: str, label: str, box: Sequence[str], order: str, threshold: float = 0.5, tie: str = "lowest") -> DataFrame:
    """image, label, tp, fp, fn, support, iou_sum: each prediction in order takes the free true box of its label that
    overlaps most, if by threshold; of equals the lowest or the highest in order.

    Overlaps come from the grid; a task then sees them in order and holds the true boxes taken of one image and label.
    """
    side = lambda rows: rows.select(F.col(image).alias("_i"), F.col(label).alias("_k"), F.struct(F.col(order).alias("o"), F.array(*[F.col(c).cast("double") for c in box]).alias("b")).alias("v"))
    met = overlaps(side(predicted), side(true), ["_i", "_k"], max(threshold, 0.0)).select(F.col("_i").alias(image), F.col("_k").alias(label), F.col("l.o").alias("_p"), F.col("r.o").alias("_t"), "iou")
    choice = [F.desc("iou"), F.col("_t") if tie == "lowest" else F.desc("_t")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, taken, done = None, set(), None
        for b in batches:
            rows = []
            for n, (i, k, p, t) in enumerate(zip(*[b.column(c).to_pylist() for c in range(4)])):
                if (i, k) != group:
                    group, taken, done = (i, k), set(), None
                if p != done and t not in taken:
                    done = p
                    taken.add(t)
                    rows.append(n)
            yield b.take(pa.array(rows, pa.int64())).select([image, label, "iou"])

    kinds = ", ".join(f"`{c}` {met.schema[c].dataType.simpleString()}" for c in (image, label, "iou"))
    hits = met.repartition(image, label).sortWithinPartitions(image, label, "_p", *choice).mapInArrow(run, kinds)
    nothing = F.lit(0).cast("bigint")
    counts = predicted.select(image, label, F.lit(1).alias("_n"), F.lit(0).alias("_s"), F.lit(None).cast("double").alias("iou"))
    counts = counts.unionByName(true.select(image, label, F.lit(0).alias("_n"), F.lit(1).alias("_s"), F.lit(None).cast("double").alias("iou")))
    counts = counts.unionByName(hits.select(image, label, F.lit(0).alias("_n"), F.lit(0).alias("_s"), "iou"))
    all_ = counts.groupBy(image, label).agg(F.count("iou").alias("tp"), F.sum("_n").alias("_n"), F.sum("_s").alias("support"), F.coalesce(F.sum("iou"), F.lit(0.0)).alias("iou_sum"))
    return all_.select(image, label, "tp", (F.col("_n") - F.col("tp") + nothing).alias("fp"), (F.col("support") - F.col("tp") + nothing).alias("fn"), "support", "iou_sum")
