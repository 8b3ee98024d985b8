import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import geometry as g
from millrace.functions import labels as lb
from millrace.operators import checks, dedup, evaluation, images, sampling


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_measurements(spark):
    assert one(spark, g.measure_pixels(arr(10, 20, 30, 80))["length"]) == 80
    m = one(spark, g.measure_scaled(arr(0, 0, 20, 40), F.lit(0.25), F.lit("mm"), F.lit(1.0)))
    assert (m["length"], m["max_width"], m["area"]) == (10, 5, 50)
    h = F.array(arr(2, 0, 0), arr(0, 3, 0), arr(0, 0, 1))
    m = one(spark, g.measure_projected(arr(0, 0, 20, 40), h, F.lit("cm"), F.lit(2.0)))
    assert (m["length"], m["max_width"], m["area"], m["uncertainty"]) == (12, 4, 48, 0.2)
    flat = F.array(arr(1, 2, 0), arr(2, 4, 0), arr(0, 0, 1))
    assert one(spark, g.measure_projected(arr(0, 0, 20, 40), flat, F.lit("cm"), F.lit(2.0))) is None


def test_text_labels(spark):
    for text, want in {"network crack": ("crack", "network_alligator"), "exposed reinforcement": ("exposed_rebar", "not_applicable"), "rust staining": ("rust_staining", "not_applicable"), "wall": None, "Crack-with deposit": ("crack", "with_deposit")}.items():
        got = one(spark, lb.canonical_text(F.lit(text)))
        assert (tuple(got) if got else None) == want
    assert tuple(one(spark, lb.canonical_model_label(F.lit(" Exposed Rebar ")))) == ("exposed_rebar", "not_applicable")
    assert one(spark, lb.canonical_model_label(F.lit("unknown_review"))) is None
    assert one(spark, F.concat(*[lb.location_token(F.lit(v), F.lit(1024.0)) for v in (0.0, 0.0, 1024.0, 1024.0)])) == "<loc_0><loc_0><loc_1000><loc_1000>"
    assert one(spark, lb.split_labels(F.lit("a| b;;c"))) == ["a", "b", "c"]
    assert one(spark, lb.human_bytes(F.lit(1536))) == "1.50 KiB"
    assert one(spark, lb.stem(F.lit("A/B/Img.01.PNG"))) == "img.01"


def test_boxes(spark):
    assert one(spark, g.clamp_box(*[F.lit(float(v)) for v in (-5, 2, 50, 9, 20, 20)])) == [0, 2, 20, 7]
    assert one(spark, g.clamp_box(*[F.lit(float(v)) for v in (30, 2, 50, 9, 20, 20)])) is None
    assert one(spark, g.iou(arr(0, 0, 2, 2), arr(1, 0, 3, 2))) == pytest.approx(1 / 3)
    assert one(spark, g.iou(arr(0, 0, 0, 0), arr(0, 0, 0, 0))) == 0
    assert one(spark, g.points(arr(1, 2, 3))) is None
    assert one(spark, g.polygon_area(g.points(arr(0, 0, 4, 0, 4, 3)))) == 6


def iou(a, b):
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    u = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / u if u else 0


def some_boxes(seed, n=60):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y = r.randint(0, 20), r.randint(0, 20)
        out.append((i % 3, r.choice("ab"), float(x), float(y), float(x + r.randint(5, 20)), float(y + r.randint(5, 20)), r.randint(0, 5) / 5, i))
    return out


COLS = "image int, label string, x1 double, y1 double, x2 double, y2 double, score double, n int"


def test_suppress_is_greedy(spark):
    rows = some_boxes(1)
    kept = []
    for r in sorted(rows, key=lambda r: (-r[6], r[7])):
        if not any(k[0] == r[0] and k[1] == r[1] and iou(k[2:6], r[2:6]) >= 0.4 for k in kept):
            kept.append(r)
    got = evaluation.suppress(spark.createDataFrame(rows, COLS), "image", "label", ["x1", "y1", "x2", "y2"], "score", ["n"], 0.4).collect()
    assert sorted(tuple(x) for x in got) == sorted(kept)


@pytest.mark.parametrize("tie", ["lowest", "highest"])
def test_greedy_match(spark, tie):
    p, t = some_boxes(2), some_boxes(3)
    want = {}
    for key in {r[:2] for r in p + t}:
        used, tp = set(), 0
        true = [r for r in t if r[:2] == key]
        for r in [r for r in p if r[:2] == key]:
            c = [(iou(r[2:6], q[2:6]), -j if tie == "lowest" else j, j) for j, q in enumerate(true) if j not in used]
            if c and max(c)[0] >= 0.3:
                used.add(max(c)[2])
                tp += 1
        want[key] = (tp, sum(r[:2] == key for r in p) - tp, len(true) - tp)
    got = evaluation.greedy_match(spark.createDataFrame(p, COLS), spark.createDataFrame(t, COLS), "image", "label", ["x1", "y1", "x2", "y2"], "n", 0.3, tie).collect()
    assert {(r["image"], r["label"]): (r["tp"], r["fp"], r["fn"]) for r in got} == want


@pytest.mark.parametrize("radius", [0, 6, 16])
def test_hamming_pairs_are_all_pairs(spark, radius):
    r = random.Random(radius)
    codes = [r.getrandbits(63) for _ in range(40)]
    for c in codes[:20]:
        for k in (0, 1, 6, 12):
            x = c
            for b in r.sample(range(63), k):
                x ^= 1 << b
            codes.append(x)
    rows = list(enumerate(codes))
    want = {(i, j, (a ^ b).bit_count()) for i, a in rows for j, b in rows if i < j and (a ^ b).bit_count() <= radius}
    got = dedup.hamming_pairs(spark.createDataFrame(rows, "id int, c bigint"), "id", "c", radius).collect()
    assert {tuple(x) for x in got} == want


@pytest.mark.parametrize("tile", [8, 64, 2048])
@pytest.mark.parametrize("radius", [0, 3, 20])
def test_tiles_and_bands_find_the_same_codes(spark, radius, tile):
    """Codes in clusters and far ones, in many blocks of a few pivots' cells."""
    r = random.Random(radius)
    codes = {r.getrandbits(63) for _ in range(60)}
    for c in list(codes)[:12]:
        for _ in range(25):
            codes.add(c ^ sum(1 << b for b in r.sample(range(63), r.randint(1, 9))))
    codes = sorted(codes) + [0, (1 << 63) - 1]
    want = {(a, b) for a in codes for b in codes if a < b and (a ^ b).bit_count() <= radius}
    df = spark.createDataFrame([(c,) for c in codes], "c bigint")
    blocks = dedup.blocks_of(df, len(codes), 63, tile)[0].collect()
    assert sorted(c for x in blocks for c in x["codes"]) == sorted(codes) and len(blocks) >= len(codes) / tile
    assert sorted(tuple(x) for x in dedup._by_tiles(df, len(codes), radius, 63, tile).collect()) == sorted(want)
    if tile == 8:
        n, flips, _ = dedup.banding(len(codes), radius, 63)
        assert sorted(tuple(x) for x in dedup._by_bands(df, radius, 63, n, flips).collect()) == sorted(want)


def test_a_class_of_equal_codes_is_one_row(spark):
    rows = [(i, 5) for i in range(500)] + [(500 + i, 7) for i in range(40)] + [(4000, 1 << 40), (4001, None)]
    df = spark.createDataFrame(rows, "id int, c bigint")
    got = dedup.class_pairs(dedup.code_members(df, "id", "c"), 1).collect()
    assert {tuple(x) for x in got} == {(5, 5, 0, 500, 500), (7, 7, 0, 40, 40), (5, 7, 1, 500, 40)}
    assert len(got) == 3
    pairs = dedup.hamming_pairs(df, "id", "c", 1)
    assert pairs.count() == 500 * 499 // 2 + 40 * 39 // 2 + 500 * 40 == pairs.where("left_id < right_id").distinct().count()
    sizes = [len(x) for x in pairs.rdd.glom().collect()]
    assert len(sizes) > 1 and max(sizes) < sum(sizes) * 2 / len(sizes)


@pytest.mark.parametrize("few", [0, 100, 1000])
@pytest.mark.parametrize("least", [0.0, 0.3, 0.85])
def test_overlaps_meet_once(spark, least, few):
    r = random.Random(9)
    rows = []
    for i in range(150):
        w, h = 2.0 ** r.uniform(-6, 9), 2.0 ** r.uniform(-6, 9)
        x, y = r.choice([r.uniform(-300, 300), 0.0, 64.0]), r.choice([r.uniform(-300, 300), 0.0, -128.0])
        rows.append((i % 2, i, [x, y, x + w, y + h]))
    for i in range(150, 300):
        a = rows[r.randrange(150)][2]
        rows.append((i % 2, i, [v + r.uniform(-0.02, 0.02) * (a[2] - a[0]) for v in a]))
    rows += [(0, 300, [0.0, 0.0, 0.0, 5.0]), (None, 305, [0.0, 0.0, 9.0, 9.0]), (0, 301, [5.0, 5.0, 1.0, 9.0]), (0, 302, [0.0, None, 1.0, 1.0]), (0, 303, [float("nan"), 0.0, 1.0, 1.0]), (0, 304, None)]
    df = spark.createDataFrame(rows, "g int, n int, b array<double>").selectExpr("g", "struct(n, b) as v")
    left, right = df.where("v.n % 3 <> 0"), df.where("v.n % 3 <> 1")
    got = evaluation.overlaps(left, right, ["g"], least, few).select("l.n", "r.n").collect()
    good = [x for x in rows if x[2] and None not in x[2] and all(v == v for v in x[2])]
    want = {(a, b) for g, a, p in good for k, b, q in good if g == k is not None and a % 3 != 0 and b % 3 != 1 and 0 < iou(p, q) >= least}
    assert sorted(tuple(x) for x in got) == sorted(want)


@pytest.mark.parametrize("most", [0, 50, 10**6])
def test_suppression_by_rounds_is_greedy(spark, most):
    """Chains of overlaps, heaps of equal boxes, one image with nearly all."""
    r = random.Random(most)
    rows = [(0, "a", float(i), 0.0, i + 4.0, 4.0, r.randint(0, 3) / 3, i) for i in range(120)]
    rows += [(0, "a", 500.0, 500.0, 510.0, 510.0, 0.5, i) for i in range(120, 180)]
    rows += [(1, "b", 0.0, 0.0, 0.0, 4.0, 0.5, i) for i in range(180, 184)] + [(r.randint(0, 1), None, *(x := [float(r.randint(0, 9)), float(r.randint(0, 9))]), x[0] + 5, x[1] + 5, 0.1, i) for i in range(184, 220)]
    kept = []
    for b in sorted(rows, key=lambda x: (-x[6], x[7])):
        if not any(k[:2] == b[:2] and iou(k[2:6], b[2:6]) >= 0.4 for k in kept):
            kept.append(b)
    got = evaluation.suppress(spark.createDataFrame(rows, COLS), "image", "label", ["x1", "y1", "x2", "y2"], "score", ["n"], 0.4, most).collect()
    assert sorted((tuple(x) for x in got), key=repr) == sorted(kept, key=repr)


def test_splits_agree_and_hold_groups(spark):
    rows = spark.range(3000).select((F.col("id") % 211).alias("g"))
    import hashlib

    a = sampling.group_safe_split_large(rows, "g", 0.2, "s").collect()
    before, want = 0, {}
    for g in sorted(range(211), key=lambda g: hashlib.sha256(f"s:{g}".encode()).hexdigest()):
        want[g] = "validation" if before < 600 else "train"
        before += len(range(g, 3000, 211))
    assert {r["g"]: r["split"] for r in a} == want
    n = sum(r["n"] for r in a if r["split"] == "validation")
    assert 600 <= n <= 620


def test_quota_select_is_the_greedy_loop(spark):
    import hashlib

    r = random.Random(4)
    rows = [(i, r.randint(0, 30), r.choice("abc")) for i in range(200)]
    rank = lambda i: hashlib.sha256(f"s:{i}".encode()).hexdigest()
    used, want = set(), []
    for step, (name, n) in enumerate([("a", 5), ("b", 7), (None, 8)]):
        for row in sorted(rows, key=lambda x: rank(x[0])):
            if n and row[1] not in used and (name is None or row[2] == name):
                used.add(row[1])
                want.append((*row, step))
                n -= 1
    got = sampling.quota_select(spark.createDataFrame(rows, "k int, g int, l string"), "k", "g", "l", [("a", 5), ("b", 7)], 20, "s").collect()
    assert sorted(tuple(x[c] for c in ("k", "g", "l", "step")) for x in got) == sorted(want)
    with pytest.raises(ValueError):
        sampling.quota_select(spark.createDataFrame(rows, "k int, g int, l string"), "k", "g", "l", [("a", 500)], 600, "s")


def test_images():
    import numpy as np

    rng = np.random.default_rng(0)
    h = images.perceptual_hash(rng.random((32, 32)))
    assert h.bit_count() == 31
    m = np.zeros((10, 12))
    m[2:5, 3:9] = 1
    assert images.mask_box(m) == [3, 2, 6, 3]
    assert images.mask_box(m * 0) is None
    assert images.palette_counts(np.zeros((2, 3, 4), np.uint8)) == [(0, 6)]
    assert images.rasterise(np.array([[1, 1], [5, 1], [5, 4], [1, 4]], float), 8, 8).sum() == 12
    assert images.quality_flags(100, 900, 20, 10) == ["low_resolution", "underexposed", "blur"]


def test_likeness_and_checks(spark):
    k = one(spark, dedup.array_likeness(arr(1, 2, 3), arr(2, 4, 6)))
    assert k["correlation"] == pytest.approx(1) and k["mae"] == pytest.approx(2)
    assert one(spark, dedup.array_likeness(arr(1, 1), arr(1, 1))["correlation"]) == 1
    rows = spark.createDataFrame([(1, 5), (2, None), (2, 9)], "id int, v int")
    found = checks.all_of(checks.violations(rows, "id", {"small": F.col("v") < 8}), checks.duplicate_keys(rows, "id"), checks.wrong_cardinality(rows, 3))
    assert sorted(map(tuple, found.collect())) == [("small", "2"), ("small", "2"), ("unique", "2")]
    with pytest.raises(checks.ConstraintError):
        checks.require_none(found)
    checks.require_none(found.where("false"))
