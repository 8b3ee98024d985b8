"""Mix sources to target weights by Pareto order sampling.

Shares are settled by water filling: a part gets its weight's share of the total up to its cap, and what the capped
parts leave is shared among the rest by weight. It is used twice: for sources, and within a source for the sizes of
its documents, whose expected copies fall with size (tempering). A document's whole expected copies are certain; for
the rest all documents of a source are ranked by random odds over inclusion odds, and the first are taken until the
source's words are met.

Everything is DataFrame code. Ranks are never taken over a whole source: documents are counted by bins of the rank key
first, and sorting stays within a bin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stash, word_count

BINS = 4096
SOURCES_SENT, SIZES_SENT = 100_000, 100_000


def water_fill(parts: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add `share` to parts(group..., order..., weight, cap, total): least of cap and level * weight, summing to total.

    Where the caps sum to less than total every part gets its cap. `order` breaks ties, so that sums are taken in one
    order. One row is one part (a source, or a document size), never a document.
    """
    ratio = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(0.0))
    w = W.partitionBy(*group).orderBy("_ratio", *order)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    after = w.rowsBetween(0, W.unboundedFollowing)
    out = (
        parts.withColumn("_ratio", ratio)
        .withColumn("_used", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("_left", F.sum("weight").over(after))
        .withColumn("_level", F.when(F.col("_left") > 0, (F.col("total") - F.col("_used")) / F.col("_left")))
        .withColumn("_free", ~(F.col("_ratio") <= F.col("_level")))
    )
    level = F.max(F.when(F.col("_free"), F.col("_level"))).over(W.partitionBy(*group))
    return out.withColumn("share", F.when(F.col("_free"), F.col("weight") * level).otherwise(F.col("cap").cast("double"))).drop(
        "_ratio", "_used", "_left", "_level", "_free"
    )


def source_targets(sized: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """source, source_size, target of sized(source, size). Sources by code point, null last, take `weights` in turn."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = W.partitionBy(F.lit(0))
    rank = F.row_number().over(everything.orderBy(F.col("source").cast("binary").asc_nulls_last()))
    turn = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    parts = (
        by.withColumn("weight", turn.cast("long"))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("_all", F.lit(0))
    )
    return water_fill(parts, ["_all"], ["source"]).select("source", "source_size", F.col("share").alias("target"))


def pareto_mix(
    docs: DataFrame, *, weights: Sequence[int] = (1, 2, 3), most: int = 3, temper: float = 0.25, seed: int = 20260911, doc_id: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """doc_id, source, size, source_size, target, expected, taken: one row for each row of docs.

    size counts words; target is the source's words in the mix; expected is the document's expected copies; taken is
    its words in the mix, a whole number of copies up to `most`. Expected copies go as size ** -temper in a source, so
    inclusion is unequal: with temper 0 all documents of a source expect the same copies. A source's taken words miss
    its target by half the size of one document at most, unless the source has too few documents left to choose.

    Null and empty texts have size 0 and are never taken. A null source is a source. Random numbers depend on the seed,
    the id and the text, so that reruns agree; rows with equal id and text are interchangeable, and ties go by id and
    size. An empty table gives an empty result. Other columns are ignored.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit(""))))), 1, 12), 16, 10)
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), ((u.cast("double") + 0.5) / float(1 << 48)).alias("u"))
    sized = stash(read, "mix-sizes")  # ids and sizes; texts are read once
    targets = stash(source_targets(sized.select("source", "size"), weights, most), "mix-targets")
    copies = stash(_expected(sized, targets, most, temper), "mix-copies")
    if copies.count() <= SIZES_SENT:  # one row for each size in a source; beyond that a hot size's rows are split by adaptive execution
        copies = F.broadcast(copies)
    ranked = (
        sized.alias("d")
        .join(copies.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.size") == F.col("c.size")), "left")
        .select("d.doc_id", "d.source", "d.size", "d.u", "c.expected", "c.source_size", "c.target")
        .withColumn("whole", F.floor("expected"))
        .withColumn("part", F.col("expected") - F.col("whole"))
        .withColumn("rank_key", F.when(F.col("part") > 0, (F.col("u") / (1 - F.col("u"))) * ((1 - F.col("part")) / F.col("part"))))
        .withColumn("bin", F.floor(F.col("rank_key") / (1 + F.col("rank_key")) * BINS).cast("int"))
    )
    quota = _quota(ranked)
    if targets.count() <= SOURCES_SENT:  # one row a source; without this a hot source's documents would meet in one task
        quota = F.broadcast(quota)
    at = (
        ranked.alias("d")
        .join(quota.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source")), "left")
        .select("d.*", "q.edge", "q.rest")
    )
    met = F.coalesce(F.col("bin") == F.col("edge"), F.lit(False))  # only these rows, one bin of a source, are put in order
    in_bin = W.partitionBy("source").orderBy("rank_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(in_bin), F.lit(0))
    edge = at.where(met).withColumn("extra", (before + F.col("size") / 2 <= F.col("rest")).cast("int"))
    others = at.where(~met).withColumn("extra", F.coalesce((F.col("bin") < F.col("edge")).cast("int"), F.lit(0)))
    return edge.unionByName(others).select(
        "doc_id", "source", "size", "source_size", "target", "expected", (F.col("size") * (F.col("whole") + F.col("extra"))).cast("long").alias("taken")
    )


def _expected(sized: DataFrame, targets: DataFrame, most: int, temper: float) -> DataFrame:
    """source, size, source_size, target, expected copies: one row for each size of document in a source."""
    by = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    parts = (
        by.alias("b")
        .join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
        .select("b.source", "b.size", "b.n", "t.source_size", "t.target")
        .withColumn("weight", F.when(F.col("size") > 0, F.col("n") * F.pow(F.col("size").cast("double"), F.lit(1.0 - temper))).otherwise(0.0))
        .withColumn("cap", F.col("n") * F.col("size") * most)
        .withColumn("total", F.col("target"))
    )
    each = F.when(F.col("size") > 0, F.col("share") / (F.col("n") * F.col("size"))).otherwise(0.0)
    return water_fill(parts, ["source"], ["size"]).select("source", "size", "source_size", "target", F.round(F.least(each, F.lit(float(most))), 9).alias("expected"))


def _quota(ranked: DataFrame) -> DataFrame:
    """source, edge, rest: the bin of rank keys in which the source's words are met, and the words left for that bin."""
    bins = ranked.groupBy("source", "bin").agg(
        F.sum(F.col("size") * F.col("whole")).alias("sure"), F.sum("size").alias("words"), F.first("target").alias("target")
    )
    w = W.partitionBy("source")
    need = F.col("target") - F.sum("sure").over(w)
    upto = F.sum(F.when(F.col("bin").isNotNull(), F.col("words")).otherwise(0)).over(w.orderBy(F.col("bin").asc_nulls_first()))
    met = (
        bins.withColumn("need", need)
        .withColumn("upto", upto)
        .where(F.col("bin").isNotNull() & (F.col("upto") > F.col("need")))
        .groupBy("source")
        .agg(F.min(F.struct("bin", (F.col("need") - (F.col("upto") - F.col("words"))).alias("rest"))).alias("m"))
        .select("source", F.col("m.bin").alias("edge"), F.col("m.rest").alias("rest"))
    )
    # a source whose documents all fit has no edge: every bin lies below one past the last
    return bins.select("source").distinct().alias("s").join(met.alias("m"), F.col("s.source").eqNullSafe(F.col("m.source")), "left").select(
        "s.source", F.coalesce(F.col("m.edge"), F.lit(BINS + 1)).alias("edge"), F.coalesce(F.col("m.rest"), F.lit(0.0)).alias("rest")
    )
