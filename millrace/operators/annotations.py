"""Nested annotation payloads: normalising, reviewers' overlay, targets and task views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.labels import NATIVE_LABELS, join_labels, lookup, zip_shortest

OVERLAID = ("canonical_label", "annotation_status", "reviewer_id", "review_notes")
# The views of one master manifest and whether a view needs annotations.
TASKS = {"detection": False, "segmentation": True, "classification": False, "florence_product": False}


def normalise(rows: DataFrame, native: str, table=NATIVE_LABELS) -> DataFrame:
    """rows with canonical_label, mapping_strength and annotation_status; labels not in the table are unknown_review."""
    known = lookup(F.col(native), table, "label", "strength")
    label = F.coalesce(known["label"], F.lit("unknown_review"))
    return rows.withColumns(
        {"canonical_label": label, "mapping_strength": F.coalesce(known["strength"], F.lit("unknown")), "annotation_status": F.when(label == "unknown_review", "unknown").otherwise("positive")}
    )


def overlay(annotations: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """annotations with a reviewer's values where the ledger has a row for the keys (each key once, see last_wins)."""
    have = [c for c in OVERLAID if c in ledger.columns]
    decided = ledger.select(*keys, *[F.col(c).alias(f"_r_{c}") for c in have], F.lit(True).alias("reviewed"))
    both = annotations.join(decided, keys, "left")
    new = {c: F.coalesce(F.col(f"_r_{c}"), F.col(c)) if c in annotations.columns else F.col(f"_r_{c}") for c in have}
    return both.withColumns(new | {"reviewed": F.coalesce("reviewed", F.lit(False))}).drop(*[f"_r_{c}" for c in have])


def payloads(annotations: DataFrame, sample: str, order: str) -> DataFrame:
    """One row a sample: its annotations in order as an array of structs, its labels joined, and the rejected count."""
    cols = [c for c in annotations.columns if c != sample]
    each = F.struct(F.col(order).alias("_order"), F.struct(*cols).alias("a"))
    packed = annotations.groupBy(sample).agg(F.array_sort(F.collect_list(each)).alias("_l"))
    out = packed.withColumn("annotations", F.transform("_l", lambda x: x["a"])).drop("_l")
    return out.withColumn("labels", join_labels(F.transform("annotations", lambda a: a["canonical_label"])))


def positive(annotations: Column) -> Column:
    return F.filter(annotations, lambda a: a["annotation_status"] == "positive")


def valid_polygons(polygons: Column) -> Column:
    """struct(kept, rejected) of flat polygons: those with three points or more, as pairs, and how many are not."""
    kept = F.filter(F.transform(polygons, geometry.points), lambda p: p.isNotNull())
    return F.struct(kept.alias("kept"), (F.size(polygons) - F.size(kept)).alias("rejected"))


def task_views(master: DataFrame, count: str, eligible: Column | None = None) -> DataFrame:
    """master once for each task in column task; segmentation keeps rows with annotations only."""
    rows = master if eligible is None else master.where(eligible)
    tasks = F.array(*[F.struct(F.lit(k).alias("task"), F.lit(v).alias("needs")) for k, v in TASKS.items()])
    return rows.withColumn("_t", F.explode(tasks)).where(~F.col("_t.needs") | (F.col(count) > 0)).withColumn("task", F.col("_t.task")).drop("_t")


def label_lines(box: Column, class_number: Column, width: Column, height: Column) -> Column:
    """One line of a detector's label file: class and relative centre box with eight decimals, ties away from zero."""
    n = geometry.normal_box(box, width, height)
    return F.format_string("%d %.8f %.8f %.8f %.8f", class_number, n[0], n[1], n[2], n[3])


def targets(annotations: Column, labels: list[str]) -> Column:
    """Positive annotations of known labels as structs of label and corner box; rows without any are for QA to report."""
    known = F.filter(positive(annotations), lambda a: a["canonical_label"].isin(labels))
    corners = lambda b: F.array(b[0], b[1], b[0] + b[2], b[1] + b[3])
    return F.transform(known, lambda a: F.struct(a["canonical_label"].alias("label"), corners(a["box_xywh"]).alias("box_xyxy")))


def with_targets(rows: DataFrame, key: str, annotations: str, labels: list[str]) -> DataFrame:
    """rows with targets; a row that has none raises, naming its key."""
    found = targets(F.col(annotations), labels)
    none = F.raise_error(F.concat(F.lit("no targets for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    out = rows.withColumn("targets", found)
    kind = out.schema["targets"].dataType
    return out.withColumn("targets", F.when(F.size("targets") > 0, F.col("targets")).otherwise(none.cast(kind)))


# Class numbers of one source, and colours of another's masks, to native label, canonical label and strength.
CLASS_NUMBERS = {
    1: ("Algae", "unknown_review", "excluded"),
    2: ("Crack", "crack", "direct"),
    3: ("Net-Crack", "crack", "direct"),
    4: ("Crack with Precipitation", "crack", "direct"),
    5: ("Rust", "rust_staining", "direct_visual"),
    6: ("Spalling", "spalling", "direct"),
}
MASK_COLOURS = {
    (255, 255, 255, 255): ("crack", "crack", "direct"),
    (255, 0, 0, 255): ("spalling", "spalling", "direct"),
    (255, 255, 0, 255): ("corrosion", "rust_staining", "weak"),
    (0, 255, 255, 255): ("efflorescence", "efflorescence_leaching", "direct"),
}
_MAPPED = "struct<native_label:string,canonical_label:string,mapping_strength:string>"


def _mapped(native: Column, canonical: str, strength: str) -> Column:
    return F.struct(native.alias("native_label"), F.lit(canonical).alias("canonical_label"), F.lit(strength).alias("mapping_strength"))


def class_number(number: Column) -> Column:
    """struct(native_label, canonical_label, mapping_strength) of a class number; unknown ones are for review."""
    out = _mapped(F.concat(F.lit("unknown_"), number.cast("string")), "unknown_review", "unknown")
    for n, (native, canonical, strength) in CLASS_NUMBERS.items():
        out = F.when(number == n, _mapped(F.lit(native), canonical, strength)).otherwise(out)
    return out


def mask_colour(rgba: Column) -> Column:
    """The same of a mask's colour, an array of four; null for other colours, which mean nothing."""
    out = F.lit(None).cast(_MAPPED)
    for colour, (native, canonical, strength) in MASK_COLOURS.items():
        out = F.when(rgba == F.array(*[F.lit(c) for c in colour]), _mapped(F.lit(native), canonical, strength)).otherwise(out)
    return out


def from_class_numbers(rows: DataFrame, sample: str, objects: str, width: Column, height: Column) -> DataFrame:
    """sample, annotation_id, the three labels, box_xywh (clipped), polygons_xy, segmentation_provenance and
    rejected_geometry_count of objects, a struct of arrays category_id, bbox, segmentation (a list of flat polygons each) and
    id, by place. Excluded classes go. The id is the place where there is none."""
    o = F.col(objects)
    place = rows.select(F.col(sample), o.alias("o"), width.cast("double").alias("w"), height.cast("double").alias("h"), F.posexplode(o["category_id"]).alias("i", "number")).withColumn("m", class_number(F.col("number")))
    box = F.get("o.bbox", F.col("i"))
    judged = F.transform(F.coalesce(F.get("o.segmentation", F.col("i")), F.array().cast("array<array<double>>")), lambda p: geometry.pixel_polygon(p, F.col("w"), F.col("h")))
    good = F.filter(judged, lambda p: p.isNotNull())
    return place.where("m.mapping_strength <> 'excluded'").select(
        sample, F.coalesce(F.get("o.id", F.col("i")).cast("string"), F.col("i").cast("string")).alias("annotation_id"), "m.*",
        geometry.clamp_box(box[0], box[1], box[0] + box[2], box[1] + box[3], F.col("w"), F.col("h")).alias("box_xywh"), good.alias("polygons_xy"),
        F.when(F.size(good) > 0, "native_polygon").otherwise("unavailable_after_geometry_qc").alias("segmentation_provenance"), (F.size(judged) - F.size(good)).alias("rejected_geometry_count"),
    )


def from_mask_colours(colours: DataFrame, sample: str) -> DataFrame:
    """sample, annotation_id, the three labels, box_xywh, pixel_count of colours(sample, rgba, pixel_count, box_xywh), one row
    a colour that a mask has: those that mean something."""
    known = colours.where("pixel_count > 0").withColumn("m", mask_colour(F.col("rgba"))).where("m is not null")
    return known.select(sample, F.concat(F.lit("color-"), F.array_join(F.col("rgba").cast("array<string>"), "-")).alias("annotation_id"), "m.*", "box_xywh", "pixel_count")


def indexed(rows: DataFrame, array: str, index: str = "annotation_index") -> DataFrame:
    """One row a member of an array, with its place from 0; rows without members go."""
    others = [c for c in rows.columns if c != array]
    return rows.select(*others, F.posexplode(array).alias(index, array))


def training_pairs(rows: DataFrame, annotations: str = "annotations") -> DataFrame:
    """sample columns, annotation_index, box_xywh, polygon: positive annotations that have both a box and a polygon."""
    each = indexed(rows, annotations).where(F.col(f"{annotations}.annotation_status") == "positive")
    both = each.withColumns({"box_xywh": F.col(f"{annotations}.box_xywh"), "polygon": geometry.first_polygon(F.col(f"{annotations}.polygons"))}).drop(annotations)
    return both.where("box_xywh is not null and polygon is not null")


def status_rows(listing: DataFrame, constants: dict[str, object]) -> DataFrame:
    """listing with the same values in every row."""
    return listing.withColumns({k: F.lit(v) for k, v in constants.items()})


def without_field(record: Column, *fields: str) -> Column:
    """A struct without some fields, of binary data for one."""
    return record.dropFields(*fields)


def eligible(rows: DataFrame, eligibility: str = "eligibility", geometry_qc: str = "geometry_qc") -> DataFrame:
    return rows.where((F.coalesce(F.col(eligibility), F.lit("")) != "") & (F.col(geometry_qc) == "passed"))


def normalise_sources(**sources: DataFrame) -> DataFrame:
    """One table of annotations of sources, each a table source(sample_id, payload) and of one payload form.

    s2ds and uav: {"masks": [{"label", "pixels", "box"}]}; cif: {"objects": {"category": [], "bbox": []}}, zipped to the
    shorter; voc: {"object": [{"name", "box"}]}. What a payload lacks is an empty list; broken payloads give no rows.
    """
    one = "label string, box_xywh array<double>"
    forms = {
        "cif": ("objects struct<category:array<string>,bbox:array<array<double>>>", lambda p: F.transform(zip_shortest(label=p["objects"]["category"], box_xywh=p["objects"]["bbox"]), lambda z: F.struct(z["label"].alias("label"), z["box_xywh"].alias("box_xywh")))),
        "voc": ("object array<struct<name:string,box:array<double>>>", lambda p: F.transform(p["object"], lambda o: F.struct(o["name"].alias("label"), o["box"].alias("box_xywh")))),
    }
    masks = ("masks array<struct<label:string,pixels:bigint,box:array<double>>>", lambda p: F.transform(F.filter(p["masks"], lambda m: m["pixels"] > 0), lambda m: F.struct(m["label"].alias("label"), m["box"].alias("box_xywh"))))
    out = None
    for name, df in sources.items():
        schema, each = forms.get(name, masks)
        parsed = df.select(F.lit(name).alias("source"), "sample_id", F.from_json("payload", schema).alias("p"))
        rows = parsed.select("source", "sample_id", F.posexplode(F.coalesce(each(F.col("p")), F.array().cast(f"array<struct<{one.replace(' ', ':').replace(',:', ',')}>>"))).alias("annotation_index", "a")).select("source", "sample_id", "annotation_index", "a.*")
        out = rows if out is None else out.unionByName(rows)
    return normalise(out, "label")
