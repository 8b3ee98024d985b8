"""Constraints. A check gives a DataFrame of violations; `require_none` raises on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import held_out_path


class ConstraintError(ValueError):
    """Rows that a constraint forbids were found."""


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """rule, key of rows where a rule (a condition that must hold; null counts as broken) is broken. One pass."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return rows.select(F.col(key).cast("string").alias("key"), F.explode(broken).alias("rule")).select("rule", "key")


def duplicate_keys(rows: DataFrame, key: str, rule: str = "unique") -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def wrong_cardinality(rows: DataFrame, expected: int, rule: str = "cardinality") -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != expected).select(F.lit(rule).alias("rule"), F.col("n").cast("string").alias("key"))


def missing_keys(wanted: DataFrame, rows: DataFrame, key: str, rule: str = "missing") -> DataFrame:
    return wanted.select(key).distinct().join(rows.select(key), key, "left_anti").select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def different_sets(a: DataFrame, b: DataFrame, key: str, rule: str = "same_set") -> DataFrame:
    """Keys that only one side has, repeats counted."""
    x, y = a.select(F.col(key).cast("string").alias("key")), b.select(F.col(key).cast("string").alias("key"))
    return x.exceptAll(y).unionAll(y.exceptAll(x)).select(F.lit(rule).alias("rule"), "key")


def all_of(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def require_none(found: DataFrame, show: int = 5) -> None:
    """Raise with the first few violations, if there are any."""
    some = found.orderBy("rule", "key").limit(show).collect()
    if some:
        raise ConstraintError("; ".join(f"{r['rule']}: {r['key']}" for r in some))


LOCKED_CHARS = 2_000_000


def locked_texts(docs: DataFrame, locked: DataFrame, doc_id: str, text: str, locked_id: str) -> DataFrame:
    """doc_id, locked_id for each row of docs and locked text that it contains as it is, of any length, once a pair of rows.

    The locked texts are a stated set: they go out in blocks of LOCKED_CHARS characters, and each block is sought in one
    pass over all documents by an automaton of all its texts. Null and empty locked texts are in no document; documents
    and locked texts without an id are reported with null.
    """
    kind = f"`doc_id` {docs.schema[doc_id].dataType.simpleString()}, `locked_id` {locked.schema[locked_id].dataType.simpleString()}"
    out = docs.sparkSession.createDataFrame([], kind)
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    block: dict[str, list] = {}
    size = 0

    def sought(block: dict[str, list]) -> DataFrame:
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches):
            import ahocorasick
            import pyarrow as pa

            find, ids = ahocorasick.Automaton(), held.value
            for t in ids:
                find.add_word(t, t)
            find.make_automaton()
            for b in batches:
                rows = [(i, k) for i, t in enumerate(b.column(1).to_pylist()) if t for x in sorted({x for _, x in find.iter(t)}) for k in ids[x]]
                at = pa.array([i for i, _ in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([k for _, k in rows], theirs)], names=["doc_id", "locked_id"])

        return read.mapInArrow(run, kind)

    from pyspark.sql.pandas.types import to_arrow_type

    theirs = to_arrow_type(locked.schema[locked_id].dataType)
    for r in locked.select(F.col(locked_id).alias("i"), F.col(text).alias("t")).where("t <> ''").toLocalIterator():
        block.setdefault(r["t"], []).append(r["i"])
        size += len(r["t"])
        if size >= LOCKED_CHARS:
            out, block, size = out.unionByName(sought(block)), {}, 0
    return out.unionByName(sought(block)) if block else out


def finding_errors(findings: DataFrame) -> DataFrame:
    """Violations of flat findings: families, scores, boxes, states, and, where there is such a column, physical
    measurements that need a calibration."""
    physical = {"physical": physical_rule(F.col("measurement_kind"), F.col("calibration_status"), F.col("calibration_method"))} if "measurement_kind" in findings.columns else {}
    return violations(
        findings,
        "finding_id",
        physical
        | {
            "family": F.col("defect_family").isNotNull(),
            "confidence": F.col("confidence").between(0, 1),
            "box": (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("width") > 0) & (F.col("height") > 0),
            "state": F.col("review_state").isin("pending", "approved", "rejected", "relabelled"),
        },
    )


def held_out(rows: DataFrame, key: str, path: str) -> DataFrame:
    """Violations: rows whose path lies in a test folder."""
    return rows.where(held_out_path(F.col(path))).select(F.lit("held_out_path").alias("rule"), F.col(key).cast("string").alias("key"))


def physical_rule(measured: Column, status: Column, method: Column) -> Column:
    """Holds unless a measurement is physical without a valid calibration and a method; for `violations`."""
    return (F.coalesce(measured, F.lit("")) != "physical") | (F.coalesce(status == "valid", F.lit(False)) & (F.coalesce(method, F.lit("")) != ""))


# The first bytes of the image formats that an annotation may have, TIFF in either byte order.
SIGNATURES = {".png": ("89504E470D0A1A0A",), ".jpg": ("FFD8FF",), ".jpeg": ("FFD8FF",), ".tif": ("49492A00", "4D4D002A"), ".tiff": ("49492A00", "4D4D002A")}


def format_error(path: Column, content: Column) -> Column:
    """Why an annotation file is refused, null if it is not: its ending is not known, its JSON does not parse, or its first
    bytes are of no such image."""
    ending = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    json = F.try_parse_json(content.cast("string"))
    head = F.hex(F.substring(content.cast("binary"), 1, 8))
    wrong = F.lit(False)
    for e, signatures in SIGNATURES.items():
        known = F.lit(False)
        for s in signatures:
            known = known | head.startswith(s)
        wrong = wrong | ((ending == e) & ~known)
    return F.when(~ending.isin(".json", *SIGNATURES), "unsupported_format").when((ending == ".json") & json.isNull(), "broken_json").when(wrong, "broken_image")


def first_errors(found: DataFrame, by: str = "rule", show: int = 5) -> DataFrame:
    """by, n, errors: how many violations, and the first few keys in order."""
    return found.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_set("key")), 1, show).alias("errors"))


def ledger_errors(decisions: DataFrame, labels: list[str], states: list[str]) -> DataFrame:
    """Violations of reviewers' decisions(sample_id, canonical_label, annotation_status): one known label, a known state."""
    one = F.coalesce(F.col("canonical_label").isin(*labels), F.lit(False))
    return violations(decisions, "sample_id", {"single_label": ~F.coalesce(F.col("canonical_label").rlike(r"[|;]"), F.lit(False)), "label": one, "state": F.col("annotation_status").isin(*states)})


def changed_files(manifest: DataFrame, files: DataFrame, path: str, content: str) -> DataFrame:
    """path, problem (missing or mismatch) of manifest(path, sha256) against files as they are now: before they are used."""
    now = files.select(F.col(path).alias("path"), F.sha2(F.col(content).cast("binary"), 256).alias("_now"))
    problem = F.when(F.col("_now").isNull(), "missing").when(F.lower("sha256") != F.col("_now"), "mismatch")
    return manifest.join(now, "path", "left").select("path", problem.alias("problem")).where("problem is not null")


def subset(a: DataFrame, b: DataFrame, key: str, rule: str = "subset") -> DataFrame:
    """Keys of a that b lacks."""
    return missing_keys(a, b, key, rule)


# Sizes above this many bytes are stated roughly, and may be off by this share.
ROUGH_FROM, ROUGH = 1_000_000_000, 0.05


def download_state(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """key, state of expected(key, bytes, sha256, md5; each may be null) against actual(key, bytes, sha256, md5): missing,
    wrong_size, rough_size (a warning: a large size that is off by more), wrong_sha256, wrong_md5, unknown (what is expected
    is not known of the actual one) or verified."""
    have = actual.select(key, *[F.col(c).alias(f"_{c}") for c in ("bytes", "sha256", "md5")], F.lit(1).alias("_there"))
    rough, off = F.col("bytes") > ROUGH_FROM, F.abs(F.col("_bytes") - F.col("bytes"))
    differs = lambda c: F.lower(c) != F.lower(f"_{c}")
    unknown = lambda c: F.col(c).isNotNull() & F.col(f"_{c}").isNull()
    state = (
        F.when(F.col("_there").isNull(), "missing")
        .when(~rough & (off > 0), "wrong_size")
        .when(differs("sha256"), "wrong_sha256")
        .when(differs("md5"), "wrong_md5")
        .when(unknown("bytes") | unknown("sha256") | unknown("md5"), "unknown")
        .when(rough & (off / F.col("bytes") > ROUGH), "rough_size")
        .otherwise("verified")
    )
    return expected.join(have, key, "left").select(key, state.alias("state"))
