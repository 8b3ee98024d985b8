"""Findings: predictions that never change, reviews as events over them, flat views and run summaries."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry
from ..sources.files import optional
from ..sources.stash import stash

# What a review does to a finding's state.
ACTIONS = {"approve": "approved", "reject": "rejected", "relabel": "relabelled"}


@F.pandas_udf(T.StringType())
def uuid5(name: pd.Series) -> pd.Series:
    """Name-based UUID in the URL namespace; Spark has none that is not random."""
    return name.map(lambda x: None if x is None else str(uuid.uuid5(uuid.NAMESPACE_URL, x)))


# Fixed values of finding records.
SCHEMA_VERSION = "1.0.0-beta"
TAXONOMY = "BDI-TAX-001@0.1.0-beta"
CAPTURE_MODES = ("handheld", "UAV", "fixed_camera", "unknown")
LIMITATIONS = ("candidate_only", "manual_review_required", "not_structural_safety_determination")


@F.pandas_udf(T.StringType())
def finding_id(run: pd.Series, sample: pd.Series, family: pd.Series, subtype: pd.Series, box: pd.Series) -> pd.Series:
    """`finding-` and the name-based UUID of the compact JSON of the five."""
    keys = (json.dumps([r, s, f, t, [float(v) for v in b]], separators=(",", ":")) for r, s, f, t, b in zip(run, sample, family, subtype, box))
    return pd.Series([f"finding-{uuid.uuid5(uuid.NAMESPACE_URL, k)}" for k in keys])


def finding_records(detections: DataFrame, run: str, project: str, created_at: Column, provenance: dict[str, str]) -> DataFrame:
    """One nested record a detection, with the whole content of the finding schema.

    detections: sample_id, source_image_id, parent_image_id, group_id, source_dataset, capture_mode, uri, sha256,
    width_pixels, height_pixels, defect_family, subtype, box_xyxy, confidence, pipeline_route (array), escalation_state,
    quality (struct decision, flags, notes), calibration (null, or struct method, unit, mm_per_pixel, uncertainty) and
    unavailable_scale_status. provenance: model_id, checkpoint_sha256, pipeline_version, dataset_manifest_version, runtime.
    The box is clipped to the image; one that leaves nothing raises.
    """
    c, text = F.col, lambda v: F.lit(v).cast("string")
    w, h = c("width_pixels").cast("double"), c("height_pixels").cast("double")
    clipped = geometry.clamp_box(*[c("box_xyxy")[i].cast("double") for i in range(4)], w, h)
    bad = F.raise_error(F.concat(F.lit("no area is left of the box of "), c("sample_id"))).cast("array<double>")
    rows = detections.withColumn("_box", F.transform(F.coalesce(clipped, bad), lambda v: F.round(v, 4)))
    box, cal = c("_box"), c("calibration")
    rounded = lambda s, names: F.struct(*[F.round(s[n], 4).alias(n) for n in names])
    sizes = ("length", "max_width", "area")
    scaled = geometry.measure_scaled(box, cal["mm_per_pixel"], cal["unit"], cal["uncertainty"])
    physical = F.when(cal.isNotNull(), F.struct(cal["unit"].alias("unit"), *[F.round(scaled[n], 4).alias(n) for n in (*sizes, "uncertainty")]))
    off = F.when(c("unavailable_scale_status").isin("invalid", "out_of_plane"), c("unavailable_scale_status")).otherwise("not_provided")
    measurement = F.struct(
        F.when(cal.isNotNull(), "valid").otherwise(off).alias("scale_status"), F.coalesce(cal["method"], F.lit("none")).alias("scale_method"),
        rounded(geometry.measure_pixels(box), sizes).alias("pixel"), physical.alias("physical"),
    )
    limits = F.array_compact(F.array(*[F.lit(x) for x in LIMITATIONS], F.when(cal.isNull(), "uncalibrated_measurement"), F.when(c("quality.decision") != "accepted", "low_image_quality")))
    return rows.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        finding_id(F.lit(run), c("sample_id"), c("defect_family"), c("subtype"), box).alias("finding_id"),
        F.lit(project).alias("project_id"),
        F.lit(run).alias("inspection_id"),
        created_at.alias("created_at"),
        F.struct(
            "source_image_id", F.when(c("parent_image_id") != "", c("parent_image_id")).alias("parent_image_id"), "uri", "sha256", "width_pixels", "height_pixels", text(None).alias("captured_at"),
            F.when(c("capture_mode").isin(*CAPTURE_MODES), c("capture_mode")).otherwise("unknown").alias("capture_mode"), text(None).alias("camera_id"), "quality",
        ).alias("image"),
        F.struct(
            F.concat(F.lit("dataset:"), "source_dataset").alias("site_id"), F.coalesce(F.when(c("group_id") != "", c("group_id")), c("source_image_id")).alias("building_id"), text(None).alias("elevation_or_facade"),
            text(None).alias("floor"), text(None).alias("room_or_zone"), F.lit("unknown").alias("element_type"), F.lit(None).cast("struct<latitude:double,longitude:double>").alias("gps"),
        ).alias("location"),
        F.struct(
            F.lit(True).alias("immutable"), "defect_family", "subtype", F.round(F.greatest(F.lit(0.0), F.least(c("confidence"), F.lit(1.0))), 6).alias("confidence"),
            F.struct(F.lit("source_image_pixels").alias("coordinate_space"), box.alias("box_xywh"), text(None).alias("centerline_uri")).alias("geometry"), "pipeline_route", "escalation_state",
        ).alias("prediction"),
        measurement.alias("measurement"),
        F.struct(F.lit("unreviewed").alias("state"), *[text(None).alias(n) for n in ("reviewer_id", "reviewed_at", "reviewer_label", "notes")]).alias("review"),
        F.struct(*[F.lit(provenance[n]).alias(n) for n in ("model_id", "checkpoint_sha256", "pipeline_version")], F.lit(TAXONOMY).alias("taxonomy_version"), *[F.lit(provenance[n]).alias(n) for n in ("dataset_manifest_version", "runtime")]).alias("provenance"),
        F.array(F.struct(F.lit("RGB").alias("modality"), c("uri").alias("uri"), F.lit("source").alias("status"))).alias("evidence_links"),
        limits.alias("limitation_codes"),
    )


def record_json(records: DataFrame) -> Column:
    """A record as JSON: nulls are stated, but a measurement without calibration has no `physical`."""
    whole = F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"})
    return F.replace(whole, F.lit(',"physical":null'), F.lit(""))


# An image with a shorter side is of low resolution; least and greatest mean brightness; least variance of edges.
LOW_SIDE, DARK, BRIGHT, FLAT = 512, 35, 220, 45


def image_quality(width: Column, height: Column, luma: Column, edges: Column) -> Column:
    """struct(decision, flags, notes) of an image's size, mean brightness and variance of edges. Warnings never reject."""
    flags = F.array_compact(F.array(F.when(F.least(width, height) < LOW_SIDE, "low_resolution"), F.when(luma < DARK, "underexposed").when(luma > BRIGHT, "overexposed"), F.when(edges < FLAT, "blur")))
    note = F.format_string("Automated feasibility warning; thresholds require target-domain calibration. mean_luma=%.2f, edge_variance=%.2f", luma, edges)
    some = F.size(flags) > 0
    return F.struct(F.when(some, "accepted_with_warning").otherwise("accepted").alias("decision"), flags.alias("flags"), F.when(some, note).alias("notes"))


def upsert(stored: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The latest row of each key over both tables; the new one of equals."""
    both = stored.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)), allowMissingColumns=True)
    cols = [c for c in both.columns if c != "_n"]
    return both.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(version, "_n")).alias("r")).select("r.*")


def upsert_table(spark, path: str, new: DataFrame, key: str, version: str, buckets: int = 64) -> int:
    """Upsert into a table of files below path, in `buckets` folders by hash of the key; returns how many were rewritten.

    Only buckets that new rows fall into are read and written again; the files of the others stay. An upsert that is run
    again, or rows that come a second time, change nothing: the greatest version of a key wins, the new row of equals.
    """
    at = (F.pmod(F.xxhash64(key), F.lit(buckets))).cast("int")
    fresh = new.withColumn("bucket", at)
    touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most `buckets`
    if not touched:
        return 0
    stored, there = optional(spark, path, fresh.schema.simpleString()[7:-1], lambda: spark.read.schema(fresh.schema).parquet(path))
    merged = upsert(stored.where(F.col("bucket").isin(*touched)), fresh, key, version) if there else upsert(fresh.limit(0), fresh, key, version)
    kept = stash(merged, "merged")  # what is read is not overwritten while it is read
    kept.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return len(touched)


def review_state(findings: DataFrame, events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """findings with review_state and review_label of their last valid event(key, action, label, order...); else pending.
    Events of unknown actions count for nothing."""
    known = events.where(F.col("action").isin(*ACTIONS))
    last = known.groupBy(key).agg(F.max_by(F.struct("action", "label"), F.struct(*order)).alias("e"), F.count(F.lit(1)).alias("n_reviews"))
    state = F.lit("pending")
    for action, s in ACTIONS.items():
        state = F.when(F.col("e.action") == action, s).otherwise(state)
    label = F.when(F.col("e.action") == "relabel", F.col("e.label"))
    return findings.join(last, key, "left").withColumns({"review_state": state, "review_label": label, "n_reviews": F.coalesce("n_reviews", F.lit(0))}).drop("e")


def build_findings(detections: DataFrame, sample: str, label: str, box: str, score: str, measured: Column) -> DataFrame:
    """Nested findings from detections(sample, label, box x y w h, score): id, prediction and an empty review. The id is a
    name-based UUID of the compact JSON of those four."""
    return detections.select(
        uuid5(F.to_json(F.struct(F.col(sample).cast("string").alias("sample_id"), F.col(label).alias("label"), F.col(box).alias("box"), F.col(score).alias("score")), {"ignoreNullFields": "false"})).alias("finding_id"),
        F.col(sample).alias("sample_id"),
        F.struct(F.col(label).alias("defect_family"), F.col(score).alias("confidence"), F.struct(F.col(box).alias("box_xywh")).alias("geometry"), measured.alias("measurement"), F.lit(True).alias("immutable")).alias("prediction"),
        F.struct(F.lit("pending").alias("state"), F.lit(None).cast("string").alias("label")).alias("review"),
    )


def flatten(findings: DataFrame) -> DataFrame:
    """One flat row a finding, for CSV."""
    b = F.col("prediction.geometry.box_xywh")
    return findings.select(
        "finding_id", "sample_id", F.col("prediction.defect_family").alias("defect_family"), F.col("prediction.confidence").alias("confidence"), b[0].alias("x"), b[1].alias("y"), b[2].alias("width"), b[3].alias("height"),
        F.col("prediction.measurement.length").alias("length"), F.col("prediction.measurement.max_width").alias("max_width"), F.col("prediction.measurement.area").alias("area"), F.col("review.state").alias("review_state"), F.col("review.label").alias("review_label"),
    )


def should_escalate(policy: str, n_detections: Column, likelihood: Column, uncertain_below: float) -> Column:
    """Whether a sample goes to the larger model: never, always, when uncertain, or when positive or uncertain."""
    unsure = F.coalesce(likelihood < uncertain_below, F.lit(True))
    rules = {"none": F.lit(False), "all": F.lit(True), "uncertain": unsure, "positive_or_uncertain": (n_detections > 0) | unsure}
    if policy not in rules:
        raise ValueError(f"unknown policy {policy!r}")
    return rules[policy]


def prefer_large(base: Column, large: Column) -> Column:
    """The larger model's detections only if it has any."""
    return F.when(F.size(large) > 0, large).otherwise(base)


def run_summary(samples: DataFrame) -> DataFrame:
    """One row over samples(n_findings, escalated, rejected, physical)."""
    return samples.agg(
        F.count(F.lit(1)).alias("samples"), F.coalesce(F.sum("n_findings"), F.lit(0)).alias("findings"), F.count_if("escalated").alias("escalated"),
        F.count_if(F.col("n_findings") > 0).alias("with_candidates"), F.count_if(F.col("n_findings") == 0).alias("without_candidates"),
        F.coalesce(F.sum("rejected"), F.lit(0)).alias("rejected"), F.count_if("physical").alias("physical"),
    )


def merge_partial(old: DataFrame, new: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """old with the non-null values of new in allowed columns; other columns of new are ignored."""
    part = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in allowed])
    return old.join(part, key, "left").withColumns({c: F.coalesce(f"_n_{c}", c) for c in allowed}).drop(*[f"_n_{c}" for c in allowed])


def processing_status(attempts: DataFrame, key: str, order: list[str], outcome: str = "outcome") -> DataFrame:
    """key, status (completed, failed or processing) and attempts of the last attempt of each key by order."""
    last = attempts.groupBy(key).agg(F.max_by(F.col(outcome), F.struct(*order)).alias("_o"), F.count(F.lit(1)).alias("attempts"))
    return last.select(key, F.when(F.col("_o") == "ok", "completed").when(F.col("_o") == "error", "failed").otherwise("processing").alias("status"), "attempts")


def pending(rows: DataFrame, done: DataFrame, key: str, resume: bool = True) -> DataFrame:
    """rows whose key has no result yet; all of them without resume."""
    return rows.join(done.select(key), key, "left_anti") if resume else rows


def recovered(stored: DataFrame, text: str, schema: str, key: str) -> DataFrame:
    """Stored JSON records by their fields; corrupt ones, and ones without the key, are left out."""
    return stored.select(F.from_json(text, schema).alias("r")).select("r.*").where(F.col(key).isNotNull())


def ready(**there: DataFrame) -> DataFrame:
    """One row: for each table whether it has a row, and ready, whether all have."""
    out = None
    for name, df in there.items():
        one = df.select(F.lit(1).alias("x")).limit(1).agg((F.count("x") > 0).alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))  # one row each
    all_of = F.lit(True)
    for name in there:
        all_of = all_of & F.col(name)
    return out.withColumn("ready", all_of)


def throughput(runs: DataFrame, by: str, seconds: str, matched: str) -> DataFrame:
    """For each of by: images, images a second, mean seconds, and the mean of the matched overlaps that are not null."""
    total = F.sum(seconds)
    return runs.groupBy(by).agg(F.count(F.lit(1)).alias("images"), F.when(total > 0, F.count(F.lit(1)) / total).alias("per_second"), F.avg(seconds).alias("mean_seconds"), F.avg(matched).alias("mean_iou"))


def asset_inventory(assets: DataFrame, model: str, path: str, content: str, wanted: DataFrame) -> DataFrame:
    """model, files, bytes, ready: of files by model against wanted(model, path, sha256); ready if every wanted file is
    there with its digest."""
    have = assets.select(F.col(model).alias("model"), F.col(path).alias("path"), F.sha2(F.col(content).cast("binary"), 256).alias("_have"), F.octet_length(F.col(content).cast("binary")).alias("_size"))
    both = wanted.join(have, ["model", "path"], "full_outer")
    good = F.col("sha256").isNull() | F.coalesce(F.col("sha256") == F.col("_have"), F.lit(False))
    return both.groupBy("model").agg(F.count("_have").alias("files"), F.coalesce(F.sum("_size"), F.lit(0)).alias("bytes"), (F.bool_and(good) & (F.count("sha256") > 0)).alias("ready"))


def smoke_summary(records: DataFrame, text: str) -> DataFrame:
    """model, runs, passed, mean_seconds, samples of JSON records {model, sample, ok, seconds}."""
    r = records.select(F.from_json(text, "model string, sample string, ok boolean, seconds double").alias("r")).select("r.*").where("model is not null")
    return r.groupBy("model").agg(F.count(F.lit(1)).alias("runs"), F.coalesce(F.bool_and("ok"), F.lit(False)).alias("passed"), F.avg("seconds").alias("mean_seconds"), F.array_join(F.array_sort(F.collect_set("sample")), "|").alias("samples"))
