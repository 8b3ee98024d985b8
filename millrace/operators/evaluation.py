"""Scores of predictions: thresholds, precision and recall, average precision, suppression and matching of boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .boxes import greedy_match, overlaps, suppress  # noqa: F401
from .sampling import ordinals
from .skew import running_sums


def _rates(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p = tp / F.greatest(F.lit(1.0), tp + fp)
    r = tp / F.greatest(F.lit(1.0), tp + fn)
    return p, r, 2 * p * r / F.greatest(F.lit(1e-12), p + r)


def binary_metrics(rows: DataFrame, target: str, score: str, threshold: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, support, precision, recall, f1 of score >= threshold against target 0/1, for each of by."""
    t = F.col(threshold) if isinstance(threshold, str) else threshold
    said, true = F.col(score) >= t, F.col(target) == 1
    n = rows.groupBy(*by).agg(F.count_if(said & true).cast("double").alias("tp"), F.count_if(said & ~true).cast("double").alias("fp"), F.count_if(~said & true).cast("double").alias("fn"), F.count_if(true).alias("support"))
    p, r, f = _rates(F.col("tp"), F.col("fp"), F.col("fn"))
    return n.withColumns({"precision": p, "recall": r, "f1": f})


def average_precision(rows: DataFrame, target: str, score: str, tie: str, by: Sequence[str] = ()) -> DataFrame:
    """average_precision and positives for each of by: mean precision at the positives by falling score, ties by `tie`.
    A label of any size: its rows are ranked by ranges of the score."""
    at = running_sums(rows.select(*by, target, score, tie), by, [F.desc(score), F.col(tie)], {"_t": F.col(target).cast("bigint"), "_n": F.lit(1).cast("bigint")})
    n = F.sum(target)
    return at.groupBy(*by).agg(F.when(n > 0, F.sum(F.col("_t") / F.col("_n") * F.col(target)) / n).otherwise(0.0).alias("average_precision"), n.alias("positives"))


def threshold_sweep(rows: DataFrame, target: str, score: str, grid: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """For each of by the grid's threshold of greatest f1 (the least of equals; the first without positives) and its f1.

    Scores are counted by grid step in one pass; nothing is multiplied by the grid.
    """
    passed = F.aggregate(F.array(*[F.lit(float(t)) for t in grid]), F.lit(0), lambda n, t: n + F.when(F.col(score) >= t, 1).otherwise(0))
    steps = rows.groupBy(*by, passed.alias("_k")).agg(F.count_if(F.col(target) == 1).alias("t"), F.count_if(F.col(target) != 1).alias("f"))
    steps = steps.groupBy(*by).agg(F.collect_list(F.struct("_k", "t", "f")).alias("s"), F.sum("t").alias("all"))  # grid + 1 entries at most
    sums = lambda field, i: F.aggregate(F.filter("s", lambda x: x["_k"] > i), F.lit(0).cast("bigint"), lambda n, x: n + x[field])
    each = steps.select(*by, "all", "s", F.posexplode(F.array(*[F.lit(float(t)) for t in grid])).alias("i", "threshold"))
    tp, fp = sums("t", F.col("i")).cast("double"), sums("f", F.col("i")).cast("double")
    f1 = _rates(tp, fp, F.col("all") - tp)[2]
    best = F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.col("threshold"))).alias("b")
    return each.withColumn("f1", f1).groupBy(*by).agg(best).select(*by, "b.threshold", "b.f1")


def micro_metrics(rows: DataFrame, target: str, score: str, thresholds: DataFrame, label: str) -> DataFrame:
    """Metrics over all labels at the mean of the labels' thresholds (thresholds: label, threshold)."""
    mean = thresholds.agg(F.avg("threshold").alias("threshold"))  # one row
    return binary_metrics(rows.crossJoin(F.broadcast(mean)), target, score, "threshold").crossJoin(F.broadcast(mean))


def micro_metrics_own(rows: DataFrame, target: str, score: str, thresholds: DataFrame, label: str) -> DataFrame:
    """Metrics over all labels, each at its own threshold; a label without one raises."""
    each = rows.join(thresholds.select(label, "threshold"), label, "left")
    missing = F.raise_error(F.concat(F.lit("no threshold for label "), F.coalesce(F.col(label).cast("string"), F.lit("null"))))
    own = F.when(F.col("threshold").isNotNull(), F.col("threshold")).otherwise(missing.cast("double"))
    return binary_metrics(each.withColumn("threshold", own), target, score, "threshold")


def operating_point(metrics: DataFrame) -> DataFrame:
    """The row of greatest f1, then greatest recall, then least confidence, of metrics(confidence, f1, recall, ...)."""
    return metrics.agg(F.max_by(F.struct(*metrics.columns), F.struct("f1", "recall", -F.col("confidence"))).alias("b")).select("b.*")


def mask_metrics(pixels: DataFrame, p: str, t: str, by: Sequence[str] = ()) -> DataFrame:
    """bce, dice_loss (smoothed by 1) and iou (at 0.5) of probabilities p against targets t of 0/1."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-7)), F.lit(1 - 1e-7))
    on = F.col(p) >= 0.5
    inter, union = F.count_if(on & (F.col(t) == 1)), F.count_if(on | (F.col(t) == 1))
    return pixels.groupBy(*by).agg(
        F.avg(-(F.col(t) * F.log(q) + (1 - F.col(t)) * F.log(1 - q))).alias("bce"),
        (1 - (2 * F.sum(F.col(p) * F.col(t)) + 1) / (F.sum(p) + F.sum(t) + 1)).alias("dice_loss"),
        F.when(union > 0, inter / union).otherwise(0.0).alias("iou"),
    )


def sequence_likelihood(log_p: Column) -> Column:
    """exp of the mean of an array of log probabilities, within 0..1; null if it is empty."""
    mean = F.aggregate(log_p, F.lit(0.0), lambda s, x: s + x) / F.size(log_p)
    return F.when(F.size(log_p) > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(mean))))


def early_stopping(epochs: DataFrame, run: str, epoch: str, loss: str, patience: int) -> DataFrame:
    """epochs with the best loss so far, epochs since it, and stopped."""
    w = W.partitionBy(run).orderBy(epoch).rowsBetween(W.unboundedPreceding, W.currentRow)
    best = epochs.withColumn("best", F.min(loss).over(w)).withColumn("_new", F.when(F.col(loss) == F.col("best"), F.col(epoch)))
    since = F.col(epoch) - F.min_by(F.col(epoch), F.struct(F.col(loss), F.col(epoch))).over(w)
    return best.withColumn("since", since).withColumn("stopped", F.col("since") >= patience).drop("_new")


def rank_groups(rows: DataFrame, by: str, metric: str, target: float = 0.85) -> DataFrame:
    """by, metric (the mean of those that are not null), n (how many), rank from 1 by falling mean (none counts as 0), then
    by name, and priority: high below target, review otherwise or without a mean. Any number of groups."""
    means = rows.groupBy(by).agg(F.avg(metric).alias("metric"), F.count(metric).alias("n"))
    ranked = ordinals(means.withColumn("_m", F.coalesce("metric", F.lit(0.0))), [F.desc("_m"), F.col(by)], "rank")
    return ranked.withColumn("priority", F.when(F.col("metric") < target, "high").otherwise("review")).select(by, "metric", "n", "rank", "priority")
