"""Deterministic selection and splitting. Random orders are hash ranks of a seed and the key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import seeded_rank
from ..sources.sinks import stash
from .checks import ConstraintError
from .skew import running_sums


def quota_select(rows: DataFrame, key: str, group: str, label: str, quotas: Sequence[tuple[str, int]], total: int, seed: str) -> DataFrame:
    """key, group, label, step of rows chosen: for each (label, count) in order the rows of least rank whose group is not
    yet used, one a group; then any until total. step is the quota's number, or one past the last for the fill.

    One pass: the least row of each label and group is enough, and of those as many of least rank as this label's quotas and
    all quotas before them, for earlier steps can use up no more groups. The steps are then taken over these rows, whose
    number the quotas bound.
    """
    spark = rows.sparkSession
    ranked = rows.select(F.col(key).alias("k"), F.col(group).alias("g"), F.col(label).alias("l"), seeded_rank(F.col(key), seed).alias("r"))
    need, before = {}, 0
    for name, count in quotas:
        before += max(count, 0)
        need[name] = before
    least = F.min_by(F.struct("k", "g", "l", "r"), F.struct("r", "k"))
    of_label = ranked.where(F.col("l").isin(*need)).groupBy("l", "g").agg(least.alias("b")) if need else None
    of_any = ranked.groupBy("g").agg(least.alias("b")).select(F.lit(None).cast(ranked.schema["l"].dataType).alias("l"), "b").orderBy("b.r", "b.k").limit(max(total, before))
    if of_label is not None:
        most = F.element_at(F.create_map(*[F.lit(x) for kv in need.items() for x in kv]), F.col("l"))
        place = F.row_number().over(W.partitionBy("l").orderBy("b.r", "b.k"))
        some = of_label.withColumn("n", place).where(F.col("n") <= max(need.values())).where(F.col("n") <= most).select("l", "b")
        of_any = some.select("l", "b").withColumn("fill", F.lit(False)).unionByName(of_any.withColumn("fill", F.lit(True)))
    else:
        of_any = of_any.withColumn("fill", F.lit(True))
    held = sorted(of_any.select("fill", F.col("l").alias("of"), "b.*").collect(), key=lambda r: (r["r"], r["k"]))  # bounded by the quotas
    used, chosen = set(), []
    for step, (name, count) in enumerate([*quotas, (None, total)]):
        fill = step == len(quotas)
        wanted = total - len(chosen) if fill else count
        taken = []
        for r in held:
            if len(taken) >= wanted:
                break
            if r["g"] not in used and (r["fill"] if fill else not r["fill"] and r["of"] == name):
                used.add(r["g"])
                taken.append((r["k"], r["g"], r["l"], step))
        if len(taken) < wanted:
            raise ValueError(f"only {len(taken)} of {wanted} rows for {'the fill' if fill else name}")
        chosen += taken
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, group, label)]
    return spark.createDataFrame(chosen, ", ".join([*kinds, "step int"]))


def group_safe_split_large(rows: DataFrame, group: str, fraction: float, seed: str, bins: int = 4096) -> DataFrame:
    """group, n, split: groups in hash order go to validation until it has its fraction of rows, and then to train.

    Hash ranks are binned, whole bins go to either side, and only the bin in which validation fills up is ordered. A split
    that leaves a side empty raises.
    """
    by = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).withColumn("_rank", seeded_rank(F.col(group), seed))
    by = stash(by.withColumn("_bin", F.conv(F.substring("_rank", 1, 3), 16, 10).cast("int") % bins), "groups")
    size = by.groupBy("_bin").agg(F.sum("n").alias("words"))  # at most `bins` rows
    every = W.partitionBy(F.lit(0))
    upto = F.sum("words").over(every.orderBy("_bin").rowsBetween(W.unboundedPreceding, -1))
    place = size.select("_bin", F.coalesce(upto, F.lit(0)).alias("_before"), F.greatest(F.lit(1), F.round(F.sum("words").over(every) * fraction)).alias("_want"))
    inside = W.partitionBy("_bin").orderBy("_rank", group).rowsBetween(W.unboundedPreceding, -1)
    before = F.col("_before") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    out = by.join(F.broadcast(place), "_bin").select(group, "n", F.when(before < F.col("_want"), "validation").otherwise("train").alias("split"))
    sides = [r[0] for r in out.select("split").distinct().collect()]
    if len(sides) < 2:
        raise ConstraintError(f"groups cannot be split: all are in {sides[0] if sides else 'neither side'}")
    return out


def ordinals(rows: DataFrame, order: Sequence[str | Column], name: str = "ordinal") -> DataFrame:
    """rows with their place from 1 by an order without ties. No task sees all rows: ranges of the order are numbered each
    and kept, and what the ranges before hold, one number a range, is added."""
    part, place = "_part", "_place"
    ranged = rows.repartitionByRange(*[c if isinstance(c, Column) else F.col(c) for c in order]).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    kept = stash(ranged.withColumns({part: F.shiftright(at, 33), place: at.bitwiseAND(F.lit((1 << 33) - 1))}), "ordinals")
    sizes = kept.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))  # one row a range
    before = F.coalesce(F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(part, before.alias("_before"))
    return kept.join(F.broadcast(starts), part).withColumn(name, F.col("_before") + F.col(place) + 1).drop(part, place, "_before")


def prefix_split(rows: DataFrame, order: Sequence[str], fraction: float) -> DataFrame:
    """rows with ordinal (from 1) and split: the first fraction by order is train."""
    placed = ordinals(rows, order)
    many = F.broadcast(placed.agg(F.count(F.lit(1)).alias("_n")))  # one row
    return placed.crossJoin(many).withColumn("split", F.when(F.col("ordinal") <= F.floor(F.col("_n") * fraction), "train").otherwise("validation")).drop("_n")


def _at_places(rows: DataFrame, order: Sequence[str], places, least: int = 0) -> DataFrame:
    """rows with ordinal from 0, at places(N), an array of a few. Fewer rows than `least` raise."""
    placed = ordinals(rows, order).withColumn("ordinal", F.col("ordinal") - 1)
    if least and (n := placed.count()) < least:
        raise ConstraintError(f"{n} rows for {least} places")
    wanted = placed.agg(F.count(F.lit(1)).alias("_n")).select(F.explode(F.array_distinct(places(F.col("_n")))).alias("ordinal"))
    return placed.join(F.broadcast(wanted), "ordinal")  # as many as places


def evenly_spaced(rows: DataFrame, order: Sequence[str], count: int) -> DataFrame:
    """The rows at places round(i (N - 1) / (count - 1)), i from 0, half to even, with their ordinal from 0; fewer rows than
    count raise."""
    return _at_places(rows, order, lambda n: F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.bround(i * (n - 1) / (count - 1), 0).cast("bigint")), count)


def probe(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """The first, the middle and the last row by order, with their ordinal from 0; a row that is several comes once."""
    return _at_places(rows, order, lambda n: F.filter(F.array(F.lit(0).cast("bigint"), F.floor(n / 2), n - 1), lambda i: (i >= 0) & (i < n)))


def head(rows: DataFrame, order: Sequence[str], n: int, where: Column | None = None) -> DataFrame:
    """The first n rows by order, of those that fit: a top-k, no full sort."""
    return (rows if where is None else rows.where(where)).orderBy(*order).limit(n)


def by_ids(rows: DataFrame, key: str, ids: Sequence, limit: int | None = None) -> DataFrame:
    """Rows of an explicit list of ids, in the list's order with their `place` in it, the first `limit` if given; an id that
    no row has raises."""
    kind = rows.schema[key].dataType.simpleString()
    wanted = rows.sparkSession.createDataFrame([(i, n) for n, i in enumerate(dict.fromkeys(ids))], f"`{key}` {kind}, place int")
    unknown = sorted(r[0] for r in wanted.join(rows.select(key), key, "left_anti").select(key).collect())  # of the list
    if unknown:
        raise ConstraintError(f"unknown ids: {unknown[:5]}")
    found = rows.join(F.broadcast(wanted), key)  # the caller's list
    return found if limit is None else found.where(F.col("place") < limit)


def relabel(split: Column, names: Mapping[str, str]) -> Column:
    """A split's other name, where it has one."""
    out = split
    for old, new in names.items():
        out = F.when(split == old, new).otherwise(out)
    return out


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """rows with sample_id: the group's name and a number from 1, of four digits at least, in the order given, which has no
    ties; null without a group. A group is numbered by ranges of the order, so that one with nearly all rows is spread over
    the tasks."""
    placed = running_sums(rows, [group], [F.col(c) for c in order], {"_place": F.lit(1).cast("bigint")})
    named = F.format_string("%s_%04d", F.col(group), F.col("_place"))
    return placed.withColumn("sample_id", F.when(F.col(group).isNotNull(), named)).drop("_place")
