"""Boxes, polygons and measurements on columns. Boxes are arrays of four doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Corners clipped to the image, as x, y, w, h; null when nothing is left."""
    a, b = F.greatest(F.lit(0.0), F.least(x1, width)), F.greatest(F.lit(0.0), F.least(y1, height))
    c, d = F.greatest(F.lit(0.0), F.least(x2, width)), F.greatest(F.lit(0.0), F.least(y2, height))
    return F.when((c > a) & (d > b), F.array(a, b, c - a, d - b))


def box_area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two x1, y1, x2, y2 boxes; 0 when the union is empty."""
    both = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = box_area(a) + box_area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def points(flat: Column) -> Column:
    """x, y, x, y... as an array of pairs; null if the length is odd or there are under three points."""
    ok = (F.size(flat) % 2 == 0) & (F.size(flat) >= 6)
    return F.when(ok, F.transform(F.sequence(F.lit(0), F.floor(F.size(flat) / 2).cast("int") - 1), lambda i: F.array(F.get(flat, i * 2), F.get(flat, i * 2 + 1))))


def pixel_polygon(flat: Column, width: Column, height: Column) -> Column:
    """x, y, x, y... as pairs clipped to the image, to four decimals; null if the length is odd or there are under three."""
    inside = lambda v, most: F.round(F.greatest(F.lit(0.0), F.least(v, most)), 4)
    return F.transform(points(flat), lambda p: F.array(inside(p[0], width), inside(p[1], height)))


def box_of_points(pts: Column) -> Column:
    """x, y, w, h around points."""
    xs, ys = F.transform(pts, lambda p: p[0]), F.transform(pts, lambda p: p[1])
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))


def polygon_area(pts: Column) -> Column:
    """Shoelace area."""
    after = F.concat(F.slice(pts, 2, F.size(pts)), F.slice(pts, 1, 1))
    cross = F.zip_with(pts, after, lambda p, q: p[0] * q[1] - q[0] * p[1])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, x: s + x)) / 2


def normal_box(box: Column, width: Column, height: Column) -> Column:
    """x, y, w, h as centre and size relative to the image."""
    return F.array((box[0] + box[2] / 2) / width, (box[1] + box[3] / 2) / height, box[2] / width, box[3] / height)


def determinant(m: Column) -> Column:
    """Of a 3 by 3 array of arrays."""
    return m[0][0] * (m[1][1] * m[2][2] - m[2][1] * m[1][2]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])


def project(p: Column, m: Column) -> Column:
    """A point through a homography; null at its horizon."""
    d = m[2][0] * p[0] + m[2][1] * p[1] + m[2][2]
    return F.when(F.abs(d) >= 1e-12, F.array((m[0][0] * p[0] + m[0][1] * p[1] + m[0][2]) / d, (m[1][0] * p[0] + m[1][1] * p[1] + m[1][2]) / d))


def measure_pixels(box: Column) -> Column:
    """struct(length, max_width, area) of x, y, w, h."""
    return F.struct(F.greatest(box[2], box[3]).alias("length"), F.least(box[2], box[3]).alias("max_width"), (box[2] * box[3]).alias("area"))


def measure_scaled(box: Column, mm_per_pixel: Column, unit: Column, uncertainty: Column) -> Column:
    """struct(length, max_width, area, uncertainty) in mm or cm by one scale."""
    d = F.when(unit == "cm", 10.0).otherwise(1.0)
    return F.struct(
        (F.greatest(box[2], box[3]) * mm_per_pixel / d).alias("length"),
        (F.least(box[2], box[3]) * mm_per_pixel / d).alias("max_width"),
        (box[2] * box[3] * mm_per_pixel * mm_per_pixel / (d * d)).alias("area"),
        (uncertainty / d).alias("uncertainty"),
    )


def measure_projected(box: Column, m: Column, unit: Column, uncertainty: Column) -> Column:
    """struct(length, max_width, area, uncertainty) of the box through a homography; null if it is singular or a corner
    lies on the horizon. Length and width are the longest and shortest side."""
    d = F.when(unit == "cm", 10.0).otherwise(1.0)
    x, y, w, h = box[0], box[1], box[2], box[3]
    corners = F.array(*[project(F.array(a, b), m) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))])
    after = F.concat(F.slice(corners, 2, 3), F.slice(corners, 1, 1))
    sides = F.zip_with(corners, after, lambda p, q: F.hypot(q[0] - p[0], q[1] - p[1]))
    out = F.struct((F.array_max(sides) / d).alias("length"), (F.array_min(sides) / d).alias("max_width"), (polygon_area(corners) / (d * d)).alias("area"), (uncertainty / d).alias("uncertainty"))
    return F.when((F.abs(determinant(m)) >= 1e-12) & ~F.exists(corners, lambda c: c.isNull()), out)


def calibration_error(status: Column, method: Column, unit: Column, uncertainty: Column, scale: Column, homography: Column, methods: list[str]) -> Column:
    """Code of the first rule that a calibration breaks; null if it is valid."""
    return (
        F.when(F.coalesce(status, F.lit("")) != "valid", "status")
        .when(~F.coalesce(method.isin(methods), F.lit(False)), "method")
        .when(~F.coalesce(unit, F.lit("mm")).isin("mm", "cm"), "unit")
        .when(uncertainty.isNull() | F.isnan(uncertainty) | (uncertainty < 0) | (uncertainty == float("inf")), "uncertainty")
        .when(scale.isNull() == homography.isNull(), "one_of_scale_or_homography")
        .when(scale.isNotNull() & (F.isnan(scale) | (scale <= 0) | (scale == float("inf"))), "scale")
        .when(homography.isNotNull() & (F.abs(determinant(homography)) < 1e-12), "singular")
        .when((method == "camera_planar_calibration") & homography.isNull(), "needs_homography")
    )


def clamp_xywh(box: Column, width: Column, height: Column) -> Column:
    """struct(box, rejected) of an x, y, w, h box within the image; rejected is 1 where nothing is left, and box null."""
    b = clamp_box(box[0], box[1], box[0] + box[2], box[1] + box[3], width, height)
    return F.struct(b.alias("box"), b.isNull().cast("int").alias("rejected"))


def first_polygon(polygons: Column) -> Column:
    """The first of flat polygons that has three points or more, as pairs; null if none has."""
    return F.get(F.filter(F.transform(polygons, points), lambda p: p.isNotNull()), F.lit(0))


def largest_polygon(polygons: Column) -> Column:
    """Of polygons as pairs the one of greatest area, the first of equals."""
    sized = F.transform(polygons, lambda p, i: F.struct(polygon_area(p).alias("area"), (-i).alias("place"), p.alias("points")))
    return F.array_max(sized)["points"]


def prompt_box(boxes: Column, width: Column, height: Column) -> Column:
    """The first x, y, w, h box as corners within the image, the far ones on its last pixel at most; null without one."""
    b = F.get(boxes, F.lit(0))
    return F.when(b.isNotNull(), F.array(F.greatest(b[0], F.lit(0.0)), F.greatest(b[1], F.lit(0.0)), F.least(b[0] + b[2], width - 1), F.least(b[1] + b[3], height - 1)))
