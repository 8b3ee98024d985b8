"""Pairing of two sides, label counts and other registry aggregations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import ConstraintError, require_none


def pair(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, state of every key of either side: paired, left_only or right_only."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))
    state = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("paired")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def pairing_report(left: DataFrame, right: DataFrame, key: str, group: str, expected: dict[str, int] | None = None) -> DataFrame:
    """For each group: keys of left, keys without a partner on either side, and whether the sides agree and number as expected.

    A key that only right has counts in right's group if it has that column, else in the group null.
    """
    theirs = F.col(group) if group in right.columns else F.lit(None).cast(left.schema[group].dataType)
    b = right.select(key, theirs.alias("_g")).groupBy(key).agg(F.min("_g").alias("_g"), F.lit(1).alias("_r"))
    both = left.select(key, group, F.lit(1).alias("_l")).join(b, key, "full_outer").withColumn(group, F.when(F.col("_l").isNull(), F.col("_g")).otherwise(F.col(group)))
    report = both.groupBy(group).agg(F.count("_l").alias("n_left"), F.count_if(F.col("_l").isNotNull() & F.col("_r").isNull()).alias("n_unpaired"), F.count_if(F.col("_l").isNull()).alias("n_right_only"))
    agree = (F.col("n_unpaired") == 0) & (F.col("n_right_only") == 0)
    if expected:
        want = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])
        return report.withColumn("paired", agree & (F.col("n_left") == F.coalesce(F.try_element_at(want, F.col(group)), F.lit(-1))))
    return report.withColumn("paired", agree)


def class_counts(rows: DataFrame, labels: DataFrame, key: str, label: str, image: str, group: str) -> DataFrame:
    """Instances and distinct images for each group and label; labels(key, label) is a dimension, unknown ones named by key."""
    named = rows.join(labels, key, "left").withColumn("label", F.coalesce(F.col(label), F.concat(F.lit("unknown_"), F.col(key).cast("string"))))
    return named.groupBy(group, "label").agg(F.count(F.lit(1)).alias("instances"), F.countDistinct(image).alias("images"))


def multi_label_counts(rows: DataFrame, labels: Column, group: str) -> DataFrame:
    """Rows of each group by label of an array of labels, blanks left out."""
    return rows.select(group, F.explode(labels).alias("label")).where("label <> ''").groupBy(group, "label").agg(F.count(F.lit(1)).alias("n"))


def inverse_frequency(rows: DataFrame, label: str, low: float = 0.1, high: float = 10.0) -> DataFrame:
    """label, n, weight n_all / (classes * n) clipped to low..high, and pos_weight (n_all - n) / n."""
    by = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = by.agg(F.sum("n").alias("n_all"), F.count(F.lit(1)).alias("classes"))  # one row
    n = F.greatest(F.col("n"), F.lit(1)).cast("double")
    return by.crossJoin(F.broadcast(total)).select(
        label, "n", F.greatest(F.lit(low), F.least(F.lit(high), F.col("n_all") / (F.col("classes") * n))).alias("weight"), ((F.col("n_all") - F.col("n")) / n).alias("pos_weight")
    )


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row by order for each key without blanks; every column is kept. Combined before the shuffle."""
    whole = rows.where(" and ".join(f"coalesce(cast(`{k}` as string), '') <> ''" for k in keys))
    last = F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_row")
    return whole.groupBy(*keys).agg(last).select("_row.*")


def first_k(rows: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    """The first k rows by order of each group, with their rank from 1."""
    from pyspark.sql import Window as W

    return rows.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def summary_text(rows: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """group, summary: k:v of its rows joined by commas in the order of keys. For reports: a group is a short list."""
    each = F.struct(F.col(key).alias("k"), F.col(value).alias("v"))
    return rows.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda s: F.concat(s["k"].cast("string"), F.lit(":"), s["v"].cast("string"))), ",").alias("summary"))


def pair_left(left: DataFrame, right: DataFrame, key: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """left with the columns of right's last row of its key (nulls where there is none) and `state`, paired or left_only;
    and right's rows, last of their key, that no left has."""
    once = last_wins(right, [key], list(order))
    marked = once.withColumn("_r", F.lit(1))
    paired = left.join(marked, key, "left").withColumn("state", F.when(F.col("_r").isNull(), "left_only").otherwise("paired")).drop("_r")
    return paired, once.join(left.select(key), key, "left_anti")


def enrich_one_to_one(rows: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """rows with extra's columns; raises unless each row has exactly one partner and each partner one row."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_a")).join(extra.groupBy(key).agg(F.count(F.lit(1)).alias("_b")), key, "full_outer")
    odd = counts.where("not (_a <=> 1) or not (_b <=> 1)")
    require_none(odd.select(F.lit("one_to_one").alias("rule"), F.col(key).cast("string").alias("key")))
    return rows.join(extra, key)


def lookup_all(rows: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """rows left join dim (each key once); a null key finds nothing, a key that dim lacks raises."""
    unknown = rows.select(key).where(F.col(key).isNotNull()).join(dim.select(key), key, "left_anti").distinct()
    require_none(unknown.select(F.lit("unknown").alias("rule"), F.col(key).cast("string").alias("key")))
    return rows.join(dim, key, "left")


def compare_expected(expected: DataFrame, actual: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key, state (match, different, missing, unexpected) and the sorted names of columns that differ, nulls being equal."""
    a = expected.select(key, *[F.col(c).alias(f"_e_{c}") for c in columns], F.lit(1).alias("_e"))
    b = actual.select(key, *[F.col(c).alias(f"_a_{c}") for c in columns], F.lit(1).alias("_a"))
    differ = F.array_compact(F.array(*[F.when(~F.col(f"_e_{c}").eqNullSafe(F.col(f"_a_{c}")), F.lit(c)) for c in sorted(columns)]))
    both = a.join(b, key, "full_outer").withColumn("differ", F.when(F.col("_e").isNotNull() & F.col("_a").isNotNull(), differ).otherwise(F.array().cast("array<string>")))
    state = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.size("differ") > 0, "different").otherwise("match")
    return both.select(key, state.alias("state"), "differ")


def histogram(rows: DataFrame, value: str) -> DataFrame:
    """value, n by value."""
    return rows.groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(value)


def distinct_sets(rows: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """For each of by the sorted distinct values of columns, without nulls. For reports: a set is a short list."""
    return rows.groupBy(by).agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in columns])


def first_values(rows: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """key and its first value by order that is not null; null if there is none."""
    at = F.struct(*[F.col(c) for c in order])
    return rows.groupBy(key).agg(F.min_by(F.col(value), F.when(F.col(value).isNotNull(), at)).alias(value))


def first_examples(rows: DataFrame, key: str, n: int = 20) -> DataFrame:
    """The first n rows by key (a top-k, no full sort); n is the report's length."""
    return rows.orderBy(key).limit(n)


def flags(rows: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """For each of by whether a boolean column is true for all, and for any, of its rows; nulls are left out."""
    return rows.groupBy(*by).agg(*[f(c).alias(f"{name}_{c}") for c in columns for name, f in (("all", F.bool_and), ("any", F.bool_or))])


def totals(rows: DataFrame, by: str, size: str) -> DataFrame:
    """Rows and bytes for each of by."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def review_totals(rows: DataFrame, state: str, routes: str, pending: str = "pending") -> DataFrame:
    """One row: rows, those reviewed, and how many distinct routes their arrays name."""
    counts = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(state) != pending).alias("reviewed"))
    return counts.crossJoin(F.broadcast(rows.select(F.explode(routes).alias("r")).agg(F.countDistinct("r").alias("routes"))))  # one row each


def expand_aliases(names: DataFrame, name: str, ordinal: str, aliases: Mapping[str, Sequence[str]], known: Sequence[str]) -> DataFrame:
    """name, place: names with aliases put out into their members, each once, by first place. Unknown names raise."""
    table = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]))]) if aliases else F.lit(None).cast("map<string,array<string>>")
    each = names.select(F.col(ordinal).alias("_o"), F.posexplode(F.coalesce(F.try_element_at(table, F.col(name)), F.array(name))).alias("_p", "name"))
    once = each.groupBy("name").agg(F.min(F.struct("_o", "_p")).alias("place"))
    odd = once.where(~F.col("name").isin(*known))
    if bad := sorted(r["name"] for r in odd.limit(5).collect()):
        raise ConstraintError(f"unknown names: {', '.join(bad)}")
    return once.select("name", F.col("place._o").alias("place"), F.col("place._p").alias("member"))


def split_counts(rows: DataFrame, by: Sequence[str], conditions: Mapping[str, Column], sums: Mapping[str, str]) -> DataFrame:
    """For each of by its rows, rows that fit each condition, and sums of columns."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in conditions.items()], *[F.sum(c).alias(k) for k, c in sums.items()])


def parent_counts(rows: DataFrame, by: Sequence[str], parent: str) -> DataFrame:
    """For each of by its distinct parents, nulls and blanks left out, its rows, and the rows without a parent."""
    known = F.when(F.coalesce(F.col(parent).cast("string"), F.lit("")) != "", F.col(parent))
    return rows.groupBy(*by).agg(F.countDistinct(known).alias("parents"), F.count(F.lit(1)).alias("n"), F.count_if(known.isNull()).alias("empty"))


def union_sources(sources: Mapping[str, DataFrame], name: str, fill: Mapping[str, object]) -> DataFrame:
    """All rows of all sources with their source's name; columns that a source lacks are filled."""
    out = None
    for k, df in sources.items():
        rows = df.select(F.lit(k).alias(name), *df.columns)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out.na.fill(dict(fill))
