"""Exact and perceptual duplicates, leakage across splits, and the queue for reviewers."""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import stash
from .sampling import ordinals
from .skew import join_often


def split_order(split: Column, order: tuple[str, ...] = ("test", "val", "train")) -> Column:
    """Rank of a split when one row of a group is to be kept; unknown ones last."""
    out = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        out = F.when(split == name, i).otherwise(out)
    return out


def exact_keeper(rows: DataFrame, key: str, split: str, record: str, order: tuple[str, ...] = ("test", "val", "train")) -> DataFrame:
    """rows with group_size, keeper_id, keeper_split, selected and reason: one row of each group of equal key is kept.

    The keeper has the first split in order, of those the least record id; ids are unique within a split. A null key is a
    group too. A first pass
    aggregates (size and keeper by key, combined before the shuffle) and keeps the groups; the rows of hot groups meet
    their keeper by broadcast, so that neither pass brings a hot key's rows together.
    """
    best = F.struct(split_order(F.col(split), order).alias("p"), F.col(record).alias("id"), F.col(split).alias("split"))
    groups = stash(rows.groupBy(key).agg(F.count(F.lit(1)).alias("group_size"), F.min(best).alias("_best")), "groups")
    kept = F.col(record).eqNullSafe(F.col("_best.id")) & F.col(split).eqNullSafe(F.col("_best.split"))
    reason = (
        F.when(kept & (F.col("group_size") == 1), "unique")
        .when(kept, "kept_group_representative")
        .when(F.col(split) == F.col("_best.split"), "excluded_duplicate_in_split")
        .otherwise("excluded_duplicate_across_splits")
    )
    return (
        join_often(rows, groups, [key], "group_size")
        .withColumns({"keeper_id": F.col("_best.id"), "keeper_split": F.col("_best.split"), "selected": kept, "reason": reason})
        .drop("_best")
    )


def group_stats(rows: DataFrame, key: str) -> DataFrame:
    """One row: groups of equal key with more than one row, and the rows in them."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in_groups"))


def cross_split_keys(rows: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that occur in more than one split, with the sorted splits."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def median_hash(values: Column, first: int, bits: int) -> Column:
    """A long whose bits, first value highest, tell which of `bits` values (from place `first`, 1-based) exceed their
    median. bits is odd and at most 63."""
    part = F.slice(values, first, bits)
    # the median is part of what the fold begins with: inside its step it would be sorted out again for each value
    begin = F.struct(F.lit(0).cast("bigint").alias("code"), F.element_at(F.sort_array(part), bits // 2 + 1).alias("median"))
    step = lambda a, x: F.struct((a["code"] * 2 + F.when(x > a["median"], 1).otherwise(0)).alias("code"), a["median"].alias("median"))
    return F.aggregate(part, begin, step)["code"]


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def band_work(codes: int, bands: int, flips: int, bits: int) -> float:
    """Rows that the join of bands makes, by estimate."""
    width = bits / bands
    probes = sum(comb(ceil(width), i) for i in range(flips + 1))
    return bands * probes * (codes * 4 + codes * codes / 2 / 2**width)


def banding(codes: int, radius: int, bits: int) -> tuple[int, int]:
    """(bands, flips) of least work by estimate: two codes within radius agree on one of the bands but for `flips` bits,
    bands * (flips + 1) > radius. A code is looked up by all values within flips of its band's."""
    options = [(m, radius // m) for m in range(1, radius + 2) if sum(comb(ceil(bits / m), i) for i in range(radius // m + 1)) <= 4096]
    return min(options, key=lambda o: band_work(codes, *o, bits))


def _by_bands(codes: DataFrame, radius: int, bits: int, n: int, flips: int) -> DataFrame:
    """a < b of codes(c) within radius: they agree on one of n bands but for a few flips; a pair comes from the first such
    band and is then checked."""
    cuts = [round(i * bits / n) for i in range(n + 1)]
    part = lambda c, i: F.shiftrightunsigned(c, cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1))
    masks = lambda i: [sum(1 << b for b in some) for k in range(flips + 1) for some in combinations(range(cuts[i + 1] - cuts[i]), k)]
    bands = codes.select("c", F.posexplode(F.array(*[part("c", i) for i in range(n)])).alias("band", "part"))
    flipped = lambda own, i: F.transform(F.from_json(F.lit(str(masks(i))), "array<bigint>"), lambda m: own.bitwiseXOR(m))
    near_by = F.array(*[flipped(part("c", i), i) for i in range(n)])
    probes = codes.select("c", F.posexplode(near_by).alias("band", "parts")).select("c", "band", F.explode("parts").alias("part")) if flips else bands
    apart = F.array(*[F.bit_count(part(F.col("x.c").bitwiseXOR(F.col("y.c")), i)) for i in range(n)])
    return (
        bands.alias("x")
        .join(probes.alias("y"), ["band", "part"])
        .where("x.c < y.c")
        .where(hamming(F.col("x.c"), F.col("y.c")) <= radius)
        .where(F.array_position(F.transform(apart, lambda d: (d <= flips).cast("int")), 1) == F.col("band") + 1)
        .select(F.col("x.c").alias("a"), F.col("y.c").alias("b"))
    )


TILE = 2048  # codes of a block, about
PIVOTS = 16
SALTS = 64
COMPARED = 1 / 50  # work of comparing two codes in a tile, against that of a row of a join


def blocks_of(codes: DataFrame, many: int, bits: int, tile: int = TILE) -> tuple[DataFrame, list[int]]:
    """(block, cell, low, high, codes; the pivots): codes(c) packed into arrays of about `tile`.

    A code belongs to the cell of its nearest pivot. The counts of codes by cell and distance, PIVOTS * (bits + 1) rows at
    most, are cut into blocks: neighbouring distances together up to `tile`, a distance with more by hash. low and high are
    the distances of a block's codes from their pivot.
    """
    some = min(PIVOTS, 1 + many // tile)
    pivots = [r["c"] for r in codes.orderBy(F.xxhash64("c"), "c").limit(some).collect()] if some > 1 else [0]
    near = F.array_min(F.array(*[F.struct(hamming(F.col("c"), F.lit(p)).alias("far"), F.lit(i).alias("cell")) for i, p in enumerate(pivots)]))
    placed = codes.select("c", near.alias("p")).select("c", "p.cell", "p.far")
    if some == 1:
        return placed.groupBy().agg(F.collect_list("c").alias("codes"), F.min("far").alias("low"), F.max("far").alias("high")).select(F.lit(0).cast("bigint").alias("block"), F.lit(0).alias("cell"), "low", "high", "codes"), pivots
    counts = sorted((r["cell"], r["far"], r["n"]) for r in placed.groupBy("cell", "far").agg(F.count(F.lit(1)).alias("n")).collect())
    plan, held = {}, 0  # (cell, far): first block, blocks, low, high
    group: list[tuple[int, int]] = []
    block = 0

    def close() -> None:
        nonlocal block, held, group
        if group:
            parts = -(-held // tile)
            plan.update({k: (block, parts, group[0][1], group[-1][1]) for k in group})
            block, held, group = block + parts, 0, []

    for cell, far, n in counts:
        if group and (group[0][0] != cell or held + n > tile):
            close()
        group.append((cell, far))
        held += n
    close()
    stated = codes.sparkSession.createDataFrame([(c, f, *v) for (c, f), v in plan.items()], "cell int, far int, first bigint, parts bigint, low int, high int")
    dealt = placed.join(F.broadcast(stated), ["cell", "far"])  # PIVOTS * (bits + 1) rows at most
    return dealt.groupBy((F.col("first") + F.pmod(F.xxhash64("c"), F.col("parts"))).alias("block"), "cell", "low", "high").agg(F.collect_list("c").alias("codes")), pivots


def _by_tiles(codes: DataFrame, many: int, radius: int, bits: int, tile: int = TILE) -> DataFrame:
    """a < b of codes(c) within radius: every two blocks meet once, and those that the triangle inequality does not rule out
    are compared code by code.

    Blocks are dealt to rows of a square grid; a block is sent to the cells of its row and of its column, so that it
    travels as often as the square root of the tasks, and not to every other block.
    """
    packed, pivots = blocks_of(codes, many, bits, tile)
    if len(pivots) > 1:
        packed = stash(packed, "blocks")
    tasks = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = max(1, min(ceil((2 * tasks) ** 0.5), -(-many // tile)))
    row = F.pmod(F.xxhash64("block"), F.lit(side)).cast("int")
    at = packed.withColumn("row", row)
    first = at.withColumn("other", F.explode(F.sequence("row", F.lit(side - 1)))).select("row", "other", F.struct("block", "cell", "low", "high", "codes").alias("x"))
    second = at.withColumn("other", F.explode(F.sequence(F.lit(0), "row"))).select(F.col("other").alias("row"), F.col("row").alias("other"), F.struct("block", "cell", "low", "high", "codes").alias("y"))
    between = F.array(*[F.lit((p ^ q).bit_count()) for p in pivots for q in pivots])
    x, y = (lambda f: F.col(f"x.{f}")), (lambda f: F.col(f"y.{f}"))
    apart = F.greatest(F.get(between, x("cell") * len(pivots) + y("cell")) - x("high") - y("high"), F.when(x("cell") == y("cell"), F.greatest(x("low") - y("high"), y("low") - x("high"))).otherwise(0))
    met = first.join(second, ["row", "other"]).where((F.col("row") < F.col("other")) | (x("block") <= y("block"))).where(apart <= radius)
    each = met.select((x("block") == y("block")).alias("one"), F.explode("x.codes").alias("a"), F.col("y.codes").alias("more")).select("one", "a", F.explode("more").alias("b"))
    near = each.where((hamming(F.col("a"), F.col("b")) <= radius) & (~F.col("one") | (F.col("a") < F.col("b"))))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def code_members(rows: DataFrame, record: str, code: str) -> DataFrame:
    """c, salt, ids: the records of each code, those of a code with many in up to SALTS lists. Null codes have none."""
    kept = rows.select(F.col(code).alias("c"), F.pmod(F.xxhash64(record), F.lit(SALTS)).cast("int").alias("salt"), F.col(record).alias("id")).where("c is not null")
    return stash(kept.groupBy("c", "salt").agg(F.collect_list("id").alias("ids")), "members")


def class_pairs(members: DataFrame, radius: int, bits: int = 63) -> DataFrame:
    """left_code, right_code, distance, n_left, n_right: pairs of codes within radius, left_code < right_code, and each code
    that has several records with itself at distance 0. A class of equal codes is one row, however many records it has.

    Tiles compare all codes with all, at little cost each; bands of bits look at few where the radius is small. Which is
    used follows from the number of codes and the radius.
    """
    classes = members.groupBy("c").agg(F.sum(F.size("ids")).alias("n"))
    codes = classes.select("c")
    many = max(codes.count(), 1)
    n, flips = banding(many, radius, bits)
    near = _by_bands(codes, radius, bits, n, flips) if band_work(many, n, flips, bits) < many * many / 2 * COMPARED else _by_tiles(codes, many, radius, bits)
    sizes = lambda side: classes.select(F.col("c").alias(side), F.col("n").alias(f"n_{side}"))
    both = near.join(sizes("a"), "a").join(sizes("b"), "b").unionByName(classes.where("n > 1").select(F.col("c").alias("a"), F.col("c").alias("b"), F.col("n").alias("n_a"), F.col("n").alias("n_b")))
    return both.select(F.col("a").alias("left_code"), F.col("b").alias("right_code"), hamming(F.col("a"), F.col("b")).alias("distance"), F.col("n_a").alias("n_left"), F.col("n_b").alias("n_right"))


def hamming_pairs(rows: DataFrame, record: str, code: str, radius: int, bits: int = 63) -> DataFrame:
    """left_id, right_id, distance of all pairs within radius, left_id < right_id; ids are unique.

    Pairs of codes are found first (see `class_pairs`), and only then are the records of each code put back, list by list:
    the lists of a hot code meet in many tasks.
    """
    members = code_members(rows, record, code)
    near = class_pairs(members, radius, bits).select(F.col("left_code").alias("a"), F.col("right_code").alias("b"), "distance")
    side = lambda c, s: members.select(F.col("c").alias(c), F.col("salt").alias(f"{s}_salt"), F.col("ids").alias(s))
    lists = near.join(side("a", "left"), "a").join(side("b", "right"), "b").where((F.col("a") != F.col("b")) | (F.col("left_salt") <= F.col("right_salt")))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated: lists are small, what comes of them is not
    dealt = lists.repartition(tasks, F.col("a"), F.col("b"), F.col("left_salt"), F.col("right_salt"))
    each = dealt.select((F.col("a") != F.col("b")).alias("two"), (F.col("left_salt") != F.col("right_salt")).alias("apart"), "distance", F.explode("left").alias("i"), "right")
    both = each.select("two", "apart", "distance", "i", F.explode("right").alias("j")).where(F.col("two") | F.col("apart") | (F.col("i") < F.col("j")))
    return both.select(F.least("i", "j").alias("left_id"), F.greatest("i", "j").alias("right_id"), "distance")


def ranked_pairs(pairs: DataFrame) -> DataFrame:
    """pairs(left_id, right_id, distance, cross_split, exact) with pair_rank: across splits first, then equal bytes, then by
    distance and ids."""
    return ordinals(pairs, [F.desc("cross_split"), F.desc("exact"), F.col("distance"), F.col("left_id"), F.col("right_id")], "pair_rank")


def array_likeness(a: Column, b: Column) -> Column:
    """struct(correlation, mae, rmse) of two arrays of doubles; without variance the correlation is 1 if equal else 0."""
    n = F.size(a).cast("double")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    once = lambda value, f: F.get(F.transform(F.array(value), f), 0)
    # means are bound first: inside a step they would be summed again for each value
    means = F.struct((total(a) / n).alias("a"), (total(b) / n).alias("b"))
    spread = lambda m: F.struct(
        total(F.zip_with(a, b, lambda x, y: (x - m["a"]) * (y - m["b"]))).alias("both"),
        total(F.transform(a, lambda x: (x - m["a"]) * (x - m["a"]))).alias("a"),
        total(F.transform(b, lambda y: (y - m["b"]) * (y - m["b"]))).alias("b"),
    )
    like = lambda v: F.when((v["a"] > 0) & (v["b"] > 0), v["both"] / F.sqrt(v["a"] * v["b"])).otherwise(F.when(a == b, 1.0).otherwise(0.0))
    corr = once(once(means, spread), like)
    return F.struct(corr.alias("correlation"), (total(F.zip_with(a, b, lambda x, y: F.abs(x - y))) / n).alias("mae"), F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))) / n).alias("rmse"))


def measured_pairs(pairs: DataFrame, rows: DataFrame, record: str, split: str, vector: str, size: str | None = None) -> DataFrame:
    """Pairs across splits of rows, with likeness of their vectors, in no order. Only pairs both of whose ends are in rows are
    kept. Where a row stands for as many as its column `size` says, `n` is the number of pairs that a pair stands for."""
    own = {"split": F.col(split), "v": F.col(vector).cast("array<double>"), "n": F.col(size) if size else F.lit(1)}
    side = lambda s: rows.select(F.col(record).alias(f"{s}_id"), *[c.alias(f"{s}_{k}") for k, c in own.items()])
    both = pairs.join(side("left"), "left_id").join(side("right"), "right_id").where("left_split <> right_split")
    many = [(F.col("left_n") * F.col("right_n")).alias("n")] if size else []
    return both.withColumn("k", array_likeness(F.col("left_v"), F.col("right_v"))).select(
        "left_id", "right_id", "left_split", "right_split", "distance", F.round("k.correlation", 6).alias("correlation"), F.round("k.mae", 6).alias("mae"), F.round("k.rmse", 6).alias("rmse"), *many
    )


def review_queue(pairs: DataFrame, rows: DataFrame, record: str, split: str, vector: str) -> DataFrame:
    """Pairs across splits of rows, with likeness of their vectors, ranked: distance, correlation (greatest first), mae,
    ids. Only pairs both of whose ends are in rows are kept. Pairs are measured once and kept, since ranges of their order are
    found from them first."""
    like = stash(measured_pairs(pairs, rows, record, split, vector), "measured")
    order = [F.col("distance"), F.desc("correlation"), F.col("mae"), F.col("left_id"), F.col("right_id")]
    return ordinals(like, order, "review_rank").withColumn("review_rank", F.col("review_rank").cast("int"))


def crossing_ids(rows: DataFrame, record: str, split: str, code: str, radius: int, bits: int = 63) -> DataFrame:
    """id, split of the rows that have a row of another split within radius; ids are unique.

    Codes tell: the splits that a code and those near it have, not the pairs of their records, which no row needs.
    """
    known = rows.select(F.col(code).alias("c"), F.col(split).alias("split"), F.col(record).alias("id")).where("c is not null and id is not null and split is not null")
    near = class_pairs(code_members(rows, record, code), radius, bits).where("left_code <> right_code").select(F.col("left_code").alias("a"), F.col("right_code").alias("b"))
    splits = stash(known.groupBy("c").agg(F.min("split").alias("low"), F.max("split").alias("high")), "splits")
    ways = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    beside = ways.join(splits.withColumnRenamed("c", "b"), "b").select(F.col("a").alias("c"), "low", "high").unionByName(splits)
    around = beside.groupBy("c").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high")
    return join_often(known, stash(around, "around"), ["c"]).where("low <> high").select("id", "split")


# Least correlation, and greatest mean error of a duplicate and of a near duplicate, for a first decision.
ALIKE, SAME, CLOSE = 0.90, 0.05, 0.08


def prefill(distance: Column, correlation: Column, mae: Column, near: int = 2) -> Column:
    """A first decision for reviewers from three measures."""
    return (
        F.when((distance == 0) & (correlation >= ALIKE) & (mae <= SAME), "same_duplicate")
        .when((distance <= near) & (correlation >= ALIKE) & (mae <= CLOSE), "same_parent_near_duplicate")
        .otherwise("uncertain")
    )


# What a prefilled decision says to the human who confirms it.
NOTES = {
    "same_duplicate": "Machine-assisted prefill: pHash distance=0, high grayscale correlation, and low grayscale MAE. Human must confirm visually.",
    "same_parent_near_duplicate": "Machine-assisted prefill: very small pHash distance, high grayscale correlation, and low grayscale MAE. Human must confirm shared scene/capture.",
    "uncertain": "Machine-assisted prefill could not establish a safe duplicate decision from metrics alone. Human visual review required.",
}


def prefilled(queue: DataFrame, near: int = 2) -> DataFrame:
    """queue(distance, correlation, mae, ...) with machine_decision and machine_review_notes."""
    decision = prefill(F.col("distance"), F.col("correlation"), F.col("mae"), near)
    note = F.create_map(*[F.lit(x) for kv in NOTES.items() for x in kv])
    return queue.withColumn("machine_decision", decision).withColumn("machine_review_notes", F.element_at(note, F.col("machine_decision")))


def blocked_ids(queue: DataFrame, locked: str = "test") -> DataFrame:
    """Distinct ids, not of the locked split, of queued pairs that are pending or decided duplicates."""
    sides = queue.where(F.col("decision").isin("pending_human_review", "duplicate")).select(F.explode(F.array(F.struct(F.col("left_id").alias("id"), F.col("left_split").alias("split")), F.struct(F.col("right_id").alias("id"), F.col("right_split").alias("split")))).alias("s"))
    return sides.select("s.id", "s.split").where(F.col("split") != locked).select("id").distinct()
