"""Judge urls by rules and, where no rule fits, by empirical-Bayes reputation of their host.

Labelled page outcomes (1 bad, 0 good) are summed by host. A beta-binomial prior is fitted at each level by the method
of moments over the level's groups, and each group's posterior mean becomes the prior mean of the groups within: the
suffix (public suffix of the name) is shrunk to all pages, the registered domain to its suffix, the host to its
registered domain. A url is blocked if the lower bound of its host's posterior is above a threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_often, stash

# Second labels that, before a country's two letters, belong to the public suffix.
SECOND = ("ac", "co", "com", "edu", "gov", "go", "mil", "ne", "net", "or", "org")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end; empty without one or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.coalesce(lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty without :// or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(host: Column) -> Column:
    """The host's name without user, port and final dot."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")


def suffix_of(name: Column) -> Column:
    """The public suffix by rule: the last label, or the last two as in co.uk. Numbers and single labels have none."""
    labels = F.split(name, r"\.")
    last, second = F.element_at(labels, -1), F.when(F.size(labels) > 2, F.element_at(labels, -2)).otherwise("")
    two = (F.length(last) == 2) & second.isin(*SECOND)
    plain = (F.size(labels) < 2) | name.rlike(r"^[0-9.]+$|^\[")
    return F.when(plain, "").when(two, F.concat_ws(".", second, last)).otherwise(last)


def domain_of(name: Column) -> Column:
    """The registered domain: the suffix and one label before it; the whole name where it has no suffix."""
    suffix, labels = suffix_of(name), F.split(name, r"\.")
    n = F.least(F.size(F.split(suffix, r"\.")) + 1, F.size(labels))
    return F.when(suffix == "", name).otherwise(F.array_join(F.slice(labels, -n, n), "."))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct(rule, verdict) of the longest of rules (verdict, host, path start) that fits; null if none does.

    A rule list is held in the expression: it is for hundreds of rules, not for millions. Equal lengths go by text.
    """
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _strength(counts: DataFrame, low: float, high: float) -> DataFrame:
    """For groups(bad, n, prior): one row, the prior strength by moments.

    Rates of groups vary by m(1-m)/n from chance and m(1-m)/(s+1) from true difference; s solves the weighted sums.
    """
    m = F.col("prior")
    spread = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - m, 2))
    chance = F.sum(m * (1 - m))
    room = F.sum(m * (1 - m) * (F.col("n") - 1))
    between = F.greatest((spread - chance) / F.nullif(room, F.lit(0.0)), F.lit(1e-9))
    return counts.agg(F.coalesce(F.least(F.greatest(1 / between - 1, F.lit(low)), F.lit(high)), F.lit(high)).alias("strength"))


def host_reputation(outcomes: DataFrame, *, low: float = 1.0, high: float = 1000.0) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Posteriors of outcomes(host, domain, suffix, bad 0/1): tables of hosts, domains, suffixes, and all (one row).

    Each has its keys and a, b of its beta posterior, prior included. Rows of one group are summed before any shuffle.
    """
    hosts = stash(outcomes.groupBy("suffix", "domain", "host").agg(F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("n")), "host-counts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    every = suffixes.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    every = every.select((F.col("bad") + 0.5).alias("a"), (F.col("n") - F.col("bad") + 0.5).alias("b"))

    def shrink(groups: DataFrame, above: DataFrame, keys: list[str]) -> DataFrame:
        prior = above.withColumn("prior", F.col("a") / (F.col("a") + F.col("b"))).drop("a", "b", "strength")
        known = join_often(groups, prior, keys) if keys else groups.join(F.broadcast(prior))  # one row
        s = _strength(known, low, high)
        out = known.join(F.broadcast(s)).withColumns(  # one row
            {"a": F.col("prior") * F.col("strength") + F.col("bad"), "b": (1 - F.col("prior")) * F.col("strength") + F.col("n") - F.col("bad")}
        )
        return stash(out.drop("bad", "n", "prior", "strength"), "host-levels")  # each level is read several times

    by_suffix = shrink(suffixes, every, [])
    by_domain = shrink(domains, by_suffix, ["suffix"])
    by_host = shrink(hosts, by_domain, ["suffix", "domain"])
    return by_host, by_domain, by_suffix, every


def lower_bound(a: Column, b: Column, z: float) -> Column:
    """Normal approximation of the beta posterior's lower quantile."""
    return a / (a + b) - z * F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1)))


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]], *, labelled: DataFrame | None = None, threshold: float = 0.5, z: float = 1.645, page_id: str = "page_id", url: str = "url"
) -> DataFrame:
    """page_id, host, path, rule, verdict, p_bad, bound: one row for each row of pages.

    rules: (verdict, host, path start); the longest that fits decides. Other pages are blocked if the lower bound
    (z standard deviations) of their host's posterior of being bad is above threshold, else allowed; a host without
    labelled pages has its registered domain's posterior, or its suffix's, or that of all pages. labelled(url, bad)
    are the page outcomes to learn from; by default the pages that a rule decides, blocked ones as bad.

    A null url or one without :// has empty host and path, no rule, and is judged as a host without labels. Repeated
    rows are judged alike and each counts as an outcome. Other columns are ignored. An empty table gives an empty
    result.
    """
    read = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    judged = read.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules)).withColumn("_name", name_of(F.col("host")))
    judged = stash(judged, "urls-judged")  # hosts and paths, without the pages' other columns: read several times
    if labelled is None:
        marks = judged.where("_rule is not null").select("_name", (F.col("_rule.verdict") == "block").cast("long").alias("bad"))
    else:
        marks = labelled.select(name_of(host_of(F.col("url"))).alias("_name"), F.col("bad").cast("long").alias("bad")).where("bad in (0, 1)")
    marks = marks.where("_name <> ''").select(F.col("_name").alias("host"), domain_of(F.col("_name")).alias("domain"), suffix_of(F.col("_name")).alias("suffix"), "bad")
    by_host, by_domain, by_suffix, every = host_reputation(marks)
    names = judged.select("_name").distinct().select(F.col("_name").alias("host"), domain_of(F.col("_name")).alias("domain"), suffix_of(F.col("_name")).alias("suffix"))
    names = stash(names, "host-names")
    pick = lambda t, keys, to: t.select(*keys, F.struct("a", "b").alias(to))
    known = names.join(pick(by_host, ["suffix", "domain", "host"], "h"), ["suffix", "domain", "host"], "left")
    known = join_often(known, pick(by_domain, ["suffix", "domain"], "d"), ["suffix", "domain"])
    known = join_often(known, pick(by_suffix, ["suffix"], "s"), ["suffix"])
    known = known.join(F.broadcast(pick(every, [], "e"))).withColumn("p", F.coalesce("h", "d", "s", "e"))  # one row
    known = known.select(F.col("host").alias("_name"), (F.col("p.a") / (F.col("p.a") + F.col("p.b"))).alias("p_bad"), lower_bound(F.col("p.a"), F.col("p.b"), z).alias("bound"))
    judged = join_often(judged, stash(known, "host-known"), ["_name"])
    return judged.select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), F.when(F.col("bound") > threshold, "block").otherwise("allow")).alias("verdict"), "p_bad", "bound"
    )
