import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import labels
from millrace.operators import annotations, checks, dedup, evaluation, findings, images, inference, masks, registry, sampling, skew
from millrace.operators.checks import ConstraintError
from millrace.sources import files, sinks


def png(rgba, kind=6, filters=(0, 1, 2, 3, 4)):
    """A PNG of pixels, its lines filtered by turns."""
    step = {0: 1, 2: 3, 6: 4}[kind]
    px = rgba[..., :1] if kind == 0 else rgba[..., :step]
    flat = px.reshape(px.shape[0], -1).astype(int)
    lines, up = b"", np.zeros(flat.shape[1], int)
    for y, line in enumerate(flat):
        f = filters[y % len(filters)]
        left, corner = np.concatenate([np.zeros(step, int), line[:-step]]), np.concatenate([np.zeros(step, int), up[:-step]])
        p = left + up - corner
        d = [abs(p - left), abs(p - up), abs(p - corner)]
        paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], up, corner))
        guess = (0, left, up, (left + up) // 2, paeth)[f]
        lines += bytes([f]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        up = line
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    head = struct.pack(">IIBBBBB", px.shape[1], px.shape[0], 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def picture(h=40, w=50, seed=0):
    rgba = np.random.default_rng(seed).integers(0, 256, (h, w, 4)).astype(np.uint8)
    rgba[..., 3] = 255
    return rgba


def test_png_and_kernels():
    a = picture()
    assert (images.decode_png(png(a)) == a).all() and (images.decode_png(png(a, 2)) == a).all()
    assert (images.decode_png(png(a, 0))[..., 0] == a[..., 0]).all()
    for bad in (b"", b"GIF89a", png(a)[:60]):
        with pytest.raises(ValueError):
            images.decode_png(bad)
    smooth = np.add.outer(np.arange(64.0), np.arange(80.0))
    assert np.allclose(images.resized(smooth, 64, 80), np.floor(smooth + 0.5)) and images.resized(np.full((9, 7), 33.0), 32, 32).tolist() == [[33.0] * 32] * 32
    assert images.image_hash(a).bit_count() == 31 and len(images.thumbnail(a, 16)) == 256
    m = np.zeros((10, 12, 4), np.uint8)
    m[..., 3] = 255
    m[2:5, 3:8, 0] = 255
    m[7, 9, 1] = 255
    assert images.colour_masks(m) == [(0x00FF00FF, 1, [9.0, 7.0, 1.0, 1.0]), (0xFF0000FF, 15, [3.0, 2.0, 5.0, 3.0])]
    assert images.quality_of(m) == ["low_resolution", "underexposed"] and "blur" in images.quality_of(np.full((20, 20, 4), 10, np.uint8))


def test_outlines():
    m = np.zeros((8, 9), bool)
    m[1:5, 2:6] = True
    m[6, 7] = True
    assert images.outlines(m) == [[[2, 1], [5, 1], [5, 4], [2, 4]]]
    m[3, 3] = False  # a hole
    assert images.outlines(m) == [[[2, 1], [5, 1], [5, 4], [2, 4]]]
    assert images.outlines(np.zeros((3, 3))) == [] and images.outlines(np.eye(4), 0) == []
    tri = np.tril(np.ones((6, 6), bool))
    assert images.outlines(tri) == [[[0, 0], [5, 5], [0, 5]]]


def test_images_as_tables(spark, tmp_path):
    a = picture()
    (tmp_path / "a.png").write_bytes(png(a))
    (tmp_path / "b.png").write_bytes(b"no image")
    got = {r["path"].rsplit("/", 1)[1]: (r["width"], r["height"], r["readable"]) for r in files.image_headers(spark, str(tmp_path)).collect()}
    assert got == {"a.png": (50, 40, True), "b.png": (None, None, False)}
    rows = files.files(spark, str(tmp_path), "*.png")
    out = images.map_images(rows.select("name", "content"), "content", images.decode_png, images.image_hash, "hash", "bigint").select("name", "hash").collect()
    assert {r["name"]: r["hash"] for r in out} == {"a.png": images.image_hash(a), "b.png": None}


def test_model_is_loaded_once_a_worker(spark, tmp_path):
    log = tmp_path / "loads"

    def load():
        with open(log, "a") as f:
            f.write("x")
        return 3

    rows = spark.range(1000).repartition(1)
    out = inference.apply_model(rows, ["id"], load, lambda m, b: [[float(i * m)] for i in b["id"]], "scores", inference.SCORES, "test")
    assert all(r["scores"] == [3.0 * r["id"]] for r in out.collect()) and log.read_text() == "x"


def test_raising_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert registry.enrich_one_to_one(a, a.select("k", F.lit(1).alias("n")), "k").count() == 2
    for other in (a.where("k = 1"), a.union(a), spark.createDataFrame([(1,), (2,), (3,)], "k int")):
        with pytest.raises(ConstraintError):
            registry.enrich_one_to_one(a, other.select("k", F.lit(1).alias("n")), "k")
    assert registry.lookup_all(spark.createDataFrame([(1,), (None,)], "k int"), a, "k").count() == 2
    with pytest.raises(ConstraintError):
        registry.lookup_all(spark.createDataFrame([(5,)], "k int"), a, "k")
    with pytest.raises(ConstraintError):
        registry.expand_aliases(spark.createDataFrame([("z", 1)], "n string, o int"), "n", "o", {}, ["a"])
    with pytest.raises(ConstraintError):
        sampling.by_ids(a, "k", [1, 9])
    assert [r["state"] for r in registry.compare_expected(a, a.limit(0), "k", ["v"]).collect()] == ["missing"] * 2
    left, right = spark.createDataFrame([(1, "g")], "k int, g string"), spark.createDataFrame([(1,), (2,)], "k int")
    report = {r["g"]: (r["n_left"], r["n_right_only"], r["paired"]) for r in registry.pairing_report(left, right, "k", "g").collect()}
    assert report == {"g": (1, 0, True), None: (0, 1, False)}


def test_keeper_of_null_and_hot_keys(spark):
    rows = [(i, None if i % 50 == 0 else ("hot" if i % 3 else f"k{i}"), ("train", "val", "test")[i % 3 if i % 7 else 0]) for i in range(2500)]
    got = {r["id"]: r for r in dedup.exact_keeper(spark.createDataFrame(rows, "id int, sha string, split string"), "sha", "split", "id").collect()}
    assert len(got) == len(rows)
    order = {"test": 0, "val": 1, "train": 2}
    for key in (None, "hot", "k3"):
        some = [(order[s], i) for i, k, s in rows if k == key]
        assert all(got[i]["keeper_id"] == min(some)[1] and got[i]["group_size"] == len(some) for _, i in some)


def test_join_often_is_the_left_join(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"), "id")
    once = spark.createDataFrame([("hot", 1), ("3", 2), ("none", 3), (None, 4)], "k string, v int")
    got = skew.join_often(rows, once, ["k"])
    assert got.count() == 5000 and sorted(map(tuple, got.groupBy("v").count().collect()), key=repr) == sorted([(1, 2500), (2, 1), (4, 500), (None, 1999)], key=repr)
    assert skew.join_often(rows.limit(0), once, ["k"]).count() == 0


def test_ordinals_and_running_sums(spark):
    rows = spark.range(3000).select(((F.col("id") * 7919) % 3001).alias("x"), (F.col("id") % 4).alias("g"), "id").repartition(5)
    got = sampling.ordinals(rows, [F.desc("x"), F.col("id")]).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in got] == list(range(1, 3001)) and [(-r["x"], r["id"]) for r in got] == sorted((-r["x"], r["id"]) for r in got)
    sums = skew.running_sums(rows, ["g"], [F.col("x"), F.col("id")], {"s": F.col("x"), "n": F.lit(1).cast("bigint")}).collect()
    for g in range(4):
        total = 0
        for n, r in enumerate(sorted((r for r in sums if r["g"] == g), key=lambda r: (r["x"], r["id"])), 1):
            total += r["x"]
            assert (r["s"], r["n"]) == (total, n)
    assert sampling.ordinals(rows.limit(0), ["x"]).count() == 0
    assert [r["ordinal"] for r in sampling.probe(spark.range(1), ["id"]).collect()] == [0] and sampling.probe(spark.range(0), ["id"]).count() == 0


def test_match_ties(spark):
    box = ["a", "b", "c", "d"]
    one = lambda rows: spark.createDataFrame([(i, l, *map(float, x), o) for i, l, *x, o in rows], "i int, l string, a double, b double, c double, d double, o int")  # noqa: E731, E741
    p = one([(1, "x", 0, 0, 10, 10, 1), (1, "x", 0, 0, 10, 10, 2), (2, "x", 0, 0, 1, 1, 1)])
    t = one([(1, "x", 0, 0, 10, 10, 1), (1, "x", 0, 0, 10, 8, 2), (1, "y", 0, 0, 10, 10, 3)])
    got = {(r["i"], r["l"]): (r["tp"], r["fp"], r["fn"], r["support"], round(r["iou_sum"], 6)) for r in evaluation.greedy_match(p, t, "i", "l", box, "o", 0.5).collect()}
    assert got == {(1, "x"): (2, 0, 0, 2, 1.8), (2, "x"): (0, 1, 0, 0, 0.0), (1, "y"): (0, 0, 1, 1, 0.0)}
    same = one([(1, "x", 0, 0, 10, 10, 1), (1, "x", 0, 0, 10, 10, 2)])
    assert evaluation.greedy_match(p.limit(1), same, "i", "l", box, "o", 0.5, "highest").first()["tp"] == 1


def test_long_label_lines(spark):
    n = 250_000
    line = "0 " + " ".join(["0.5"] * n)
    got = spark.createDataFrame([(line,)], "t string").select(F.size(files.label_lines(F.col("t"))[0]["numbers"]).alias("n")).first()["n"]
    assert got == n


def test_writes(spark, tmp_path):
    path = f"file://{tmp_path}/x/y.bin"
    assert sinks.write_bytes(spark, path, b"1") == "written" and sinks.write_bytes(spark, path, b"1") == "reused_identical"
    with pytest.raises(FileExistsError):
        sinks.write_bytes(spark, path, b"2")
    assert sinks.write_bytes(spark, path, b"2", overwrite=True) == "overwritten"
    rows = spark.createDataFrame([("a<b", 1)], "t string, n int")
    out = sinks.export(rows, f"file://{tmp_path}/e", "html")
    assert spark.read.text(out).first()[0] == "<tr><td>a&lt;b</td><td>1</td></tr>"
    with pytest.raises(ValueError):
        sinks.export(rows, f"file://{tmp_path}/e", "docx")
    lines = spark.createDataFrame([("train", "s1", 0, "0 1"), ("train", "s1", 1, "0 2"), ("val", "s2", 0, "1 1")], "split string, s string, o int, l string")
    sinks.label_dataset(lines, f"file://{tmp_path}/d", "s", "o", "l", "split", ["crack"])
    assert "nc: 1" in (tmp_path / "d" / "data.yaml").read_text() and spark.read.text(f"file://{tmp_path}/d/lists").where("split = 'train'").first()[0] == "images/train/s1"
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "p"))
    at = files.parquet_with_position(spark, str(tmp_path / "p"), ["id"])
    with pytest.raises(LookupError):
        files.parquet_lookup(spark, str(tmp_path / "p"), ["id"], at.select("file_name", (F.col("row_index") + 5).alias("row_index")))
    assert files.row_count(spark, str(tmp_path / "p")) == 10


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert one(labels.shard_split(F.lit("a/train_tiled-00001-of-00009.parquet"))) == "train"
    assert one(labels.shard_split(F.lit("train-00001-of-00009.parquet"))) == "train" and one(labels.paired_name(F.lit("a.png"))) is None
    assert one(checks.format_error(F.lit("a.JSON"), F.lit("[1]").cast("binary"))) is None
    assert one(inference.polygons_or_boxes(F.array(F.array(*[F.lit(float(v)) for v in (1, 2, 3, 4)])), F.lit(None).cast("array<array<double>>"))) == [[1, 2, 4, 2, 4, 6, 1, 6]]
    broken = spark.createDataFrame([(1, "{")], "sample_id int, payload string")
    assert annotations.normalise_sources(cif=broken, voc=broken, uav=broken).count() == 0


def test_ids_of_pairs_across_splits_without_pairs(spark):
    near = [(i, "train", 7 << 20) for i in range(600)] + [(600, "val", (7 << 20) + 1), (601, "val", 1 << 40), (602, "val", (1 << 40) + 2), (603, "test", 5 << 50), (604, "test", 5 << 50), (605, "val", None)]
    rows = spark.createDataFrame(near, "id bigint, split string, code bigint")
    found = dedup.crossing_ids(rows, "id", "split", "code", 2)
    pairs = dedup.hamming_pairs(rows, "id", "code", 2).join(rows.select(F.col("id").alias("left_id"), F.col("split").alias("l")), "left_id").join(rows.select(F.col("id").alias("right_id"), F.col("split").alias("r")), "right_id").where("l <> r")
    want = {i for p in pairs.collect() for i in (p["left_id"], p["right_id"])}
    assert sorted(r["id"] for r in found.collect()) == sorted(want) == list(range(601))


def test_likeness_takes_time_in_proportion_to_length(spark):
    v = lambda n, k: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: ((i * k) % 97).cast("double"))
    got = spark.range(1).select(v(20_000, 31).alias("a"), v(20_000, 57).alias("b")).select(dedup.array_likeness(F.col("a"), F.col("b")).alias("k")).first()["k"]
    a, b = (np.arange(1, 20_001) * k % 97 for k in (31, 57))
    assert got["correlation"] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-9) and got["mae"] == pytest.approx(abs(a - b).mean()) and got["rmse"] == pytest.approx(((a - b) ** 2).mean() ** 0.5)


def test_bands_hold_every_pair():
    for n in (10, 5000, 10**6, 10**9):
        for radius in range(17):
            bands, flips = dedup.banding(n, radius, 63)
            assert bands * (flips + 1) > radius


def test_schema_errors(spark):
    from millrace.operators import json_schema

    schema = {
        "$defs": {"name": {"type": "string", "minLength": 1}},
        "type": "object",
        "required": ["id", "tags"],
        "additionalProperties": False,
        "properties": {
            "id": {"$ref": "#/$defs/name"},
            "n": {"type": "integer", "minimum": 0, "exclusiveMaximum": 9},
            "at": {"type": ["string", "null"], "format": "date-time"},
            "tags": {"type": "array", "uniqueItems": True, "maxItems": 3, "items": {"enum": ["a", "b", 1, None]}},
            "pair": {"prefixItems": [{"type": "number"}, {"type": "boolean"}], "items": {"type": "object", "required": ["x"]}},
            "one": {"oneOf": [{"type": "string"}, {"const": "z"}, {"type": "null"}]},
            "any": {"anyOf": [{"maximum": 3}, {"minimum": 7}], "not": {"const": 8}},
        },
        "if": {"required": ["n"]},
        "then": {"required": ["at"]},
        "else": {"properties": {"id": {"pattern": "^x"}}},
    }
    good = ['{"id": "x", "tags": []}', '{"id": "é", "n": 2.0, "at": null, "tags": ["a", 1, null], "pair": [1.5, true, {"x": null}], "one": "y", "any": 7}', '{"id": "i", "n": 8, "at": "2026-01-31T10:00:00.5+02:00", "tags": []}']
    bad = {
        "{": [("", "is no JSON")],
        None: [("", "is no JSON")],
        "[]": [("", "is not of type object")],
        "{}": [("", "id is required"), ("", "tags is required")],
        '{"id": "", "n": 1.5, "tags": ["a", "a", "c", 2], "zz": 1}': [("", "at is required"), ("", "zz is not allowed"), ("id", "is shorter than 1"), ("n", "is not of type integer"), ("tags", "has equal items")],
        '{"id": "y", "tags": [], "pair": ["s", 1, {"y": 1}], "one": "z"}': [("id", "does not match ^x"), ("one", "does not fit exactly one of the forms"), ("pair.0", "is not of type number"), ("pair.1", "is not of type boolean"), ("pair.2", "x is required")],
        '{"id": "x", "n": 9, "at": "2026-13-01T10:00:00Z", "tags": null, "any": 8}': [("any", "has a form that is not allowed"), ("at", "is not a date-time"), ("n", "is not below 9"), ("tags", "is not of type array")],
        '{"id": "x", "tags": [], "any": 5}': [("any", "fits none of the forms")],
    }
    rows = spark.createDataFrame([(x,) for x in [*good, *bad]], "t string")
    got = rows.select("t", json_schema.schema_errors(F.col("t"), schema).alias("e")).collect()
    assert {r["t"]: [tuple(e) for e in r["e"]] for r in got} == {**{g: [] for g in good}, **bad}
    with pytest.raises(ValueError, match="dependentRequired"):
        json_schema.schema_errors(F.lit("{}"), {"dependentRequired": {}})


def test_errors_are_raised(spark):
    with pytest.raises(checks.ConstraintError, match="all are in validation"):
        sampling.group_safe_split_large(spark.createDataFrame([("g",)] * 5, "g string"), "g", 0.2, "s")
    with pytest.raises(checks.ConstraintError, match="3 rows for 12 places"):
        sampling.evenly_spaced(spark.range(3), ["id"], 12)
    with pytest.raises(Exception, match="no rows to take the last of"):
        files.last_row(spark.createDataFrame([], "epoch int, loss double"), "epoch").collect()
    scores = spark.createDataFrame([("a", 1, 0.5), ("b", 0, 0.5)], "label string, target int, score double")
    with pytest.raises(Exception, match="no threshold for label b"):
        evaluation.micro_metrics_own(scores, "target", "score", spark.createDataFrame([("a", 0.4)], "label string, threshold double"), "label").collect()
    one = "struct<canonical_label:string,annotation_status:string,box_xywh:array<double>>"
    rows = spark.createDataFrame([(7, [("crack", "positive", [1.0, 2.0, 3.0, 4.0])]), (8, [("crack", "unknown", [1.0, 2.0, 3.0, 4.0])])], f"s int, a array<{one}>")
    assert annotations.with_targets(rows.where("s = 7"), "s", "a", ["crack"]).first()["targets"][0]["box_xyxy"] == [1.0, 2.0, 4.0, 6.0]
    with pytest.raises(Exception, match="no targets for 8"):
        annotations.with_targets(rows, "s", "a", ["crack"]).collect()


def test_unknown_is_not_verified(spark):
    kind = "k int, bytes bigint, sha256 string, md5 string"
    want = spark.createDataFrame([(1, 100, None, None), (2, None, "a", None), (3, 100, "a", "b"), (4, None, None, None), (5, 3_000_000_000, None, None), (6, 100, None, "B")], kind)
    have = spark.createDataFrame([(1, None, "x", "x"), (2, 5, None, None), (3, 100, "A", None), (4, 1, None, None), (5, None, None, None), (6, 100, None, "b")], kind)
    assert {r["k"]: r["state"] for r in checks.download_state(want, have, "k").collect()} == {1: "unknown", 2: "unknown", 3: "unknown", 4: "verified", 5: "unknown", 6: "verified"}
    one = lambda name, head: spark.range(1).select(checks.format_error(F.lit(name), F.unhex(F.lit(head)))).first()[0]
    assert [one("a.tiff", "4D4D002A00"), one("a.TIF", "49492A00"), one("a.bmp", "424D"), one("a.tiff", "00")] == [None, None, "unsupported_format", "broken_image"]


def test_keepers_are_told_by_their_split(spark):
    rows = spark.createDataFrame([(1, "train", "h"), (1, "test", "h"), (2, None, "i")], "id int, split string, h string")
    got = dedup.exact_keeper(rows, "h", "split", "id").collect()
    assert sorted((r["id"], str(r["split"])) for r in got if r["selected"]) == [(1, "test"), (2, "None")]


def test_findings_are_made_once_before_their_check(spark):
    import __spark_entry__ as e

    found = e.queries()["finding_record_content"](spark, e.SMALLEST)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_a_walk_of_a_document_is_not_repeated_for_its_kind(spark):
    from millrace.operators import json_schema

    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "array", "items": {"type": "integer"}, "minItems": 1}, "b": {}}}
    one = spark.createDataFrame([('{"a": [1, 2]}',), ('{"a": [1, "x"]}',), ('{"b": 1}',), ("[1]",), ("{}",), ("null",), (None,)], "t string")
    column = json_schema.schema_errors(F.col("t"), schema)
    got = [[f"{e['path']}: {e['message']}" for e in r["e"]] for r in one.select(column.alias("e")).collect()]
    assert got == [[], ["a.1: is not of type integer"], [": a is required"], [": is not of type object"], [": a is required"], [": is not of type object"], [": is no JSON"]]
    quick = json_schema.Compiler(schema, quick=True).errors(F.try_parse_json("t"), schema, F.lit(""))
    assert one.where("t is not null").select(quick.alias("wrong")).collect() == [(bool(g),) for g in got[:-1]]
    assert json_schema._kind(F.try_parse_json("t"))._jc.toString().count("schema_of_variant") == 1


def test_links_to_files(spark):
    docs = [("docs/a.md", "[x](b.md) [y](<../img/p q.png#top>) [z](../img/p%20q.png) [w](http://x/y.md) [m](mailto:a@b) [f](#here) [g](./sub/../gone+1.md) [d](..)")]
    there = spark.createDataFrame([("docs/b.md",), ("img/p q.png",), ("README.md",)], "path string")
    rows = spark.createDataFrame(docs, "path string, text string")
    assert sorted(r["resolved"] for r in files.local_links(rows, "path", "text").collect()) == ["", "docs/b.md", "docs/gone+1.md", "img/p q.png", "img/p q.png"]
    assert [r["target"] for r in files.missing_links(rows.withColumn("text", F.replace("text", F.lit("[d](..)"), F.lit("[d](../docs)"))), "path", "text", there).collect()] == ["./sub/../gone+1.md"]


def test_numbers_within_a_hot_group(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 10 == 0, F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).otherwise("hot").alias("source"))
    got = sampling.numbered(rows, "source", ["id"])
    want = {}
    for r in sorted(rows.collect(), key=lambda r: r["id"]):
        want.setdefault(r["source"], []).append(r["id"])
    assert {r["sample_id"]: r["id"] for r in got.collect()} == {f"{s}_{i:04d}": x for s, ids in want.items() for i, x in enumerate(ids, 1)}


def test_numbers_without_a_group_and_of_five_digits(spark):
    got = {r["id"]: r["sample_id"] for r in sampling.numbered(spark.range(10_003).select("id", F.when(F.col("id") > 1, "s").alias("source")), "source", ["id"]).collect()}
    assert got[0] is None and got[1] is None and got[2] == "s_0001" and got[10_002] == "s_10001"


def test_prefill_and_quality_say_why(spark):
    q = spark.createDataFrame([(0, 0.95, 0.01), (1, 0.95, 0.06), (9, 0.1, 0.5)], "distance int, correlation double, mae double")
    assert [(r["machine_decision"], r["machine_review_notes"]) for r in dedup.prefilled(q).orderBy("distance").collect()] == list(dedup.NOTES.items())
    i = spark.createDataFrame([(100, 900, 20.0, 10.0), (900, 900, 100.0, 99.0)], "w int, h int, l double, e double").select(findings.image_quality(*[F.col(c) for c in "whle"]).alias("q")).collect()
    assert (i[0]["q"]["decision"], i[0]["q"]["flags"]) == ("accepted_with_warning", ["low_resolution", "underexposed", "blur"]) and i[0]["q"]["notes"].endswith("mean_luma=20.00, edge_variance=10.00")
    assert tuple(i[1]["q"]) == ("accepted", [], None)


def test_mask_colours(spark):
    c = spark.createDataFrame([("s", [255, 0, 0, 255], 9, [0.0, 0.0, 3.0, 3.0]), ("s", [1, 2, 3, 255], 9, None), ("s", [255, 255, 255, 255], 0, None)], "s string, rgba array<int>, pixel_count bigint, box_xywh array<double>")
    got = annotations.from_mask_colours(c, "s").collect()
    assert [(r["annotation_id"], r["canonical_label"], r["mapping_strength"], r["pixel_count"]) for r in got] == [("color-255-0-0-255", "spalling", "direct", 9)]


def test_a_hot_key_without_partner_is_spread(spark):
    rows = spark.range(20_000).repartition(8).select("id", F.when(F.col("id") % 2 == 0, F.lit(None)).when(F.col("id") % 4 == 1, F.lit(-1)).otherwise(F.col("id")).cast("bigint").alias("k"))
    once = spark.range(0, 20_000, 7).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = skew.join_often(rows, once, ["k"])
        sizes = [r[1] for r in got.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1))).collect()]
        assert sum(sizes) == 20_000 and max(sizes) < 2 * 20_000 / 8
        want = {i: (None if i % 2 == 0 or i % 4 == 1 or i % 7 else f"v{i}") for i in range(20_000)}
        assert {r["id"]: r["v"] for r in got.collect()} == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_masks_by_runs(spark):
    import random

    r = random.Random(2)
    width, height = 7, 6
    rows = []
    for i in range(40):
        p = r.choice([0.0, 0.2, 0.6, 1.0])
        rows.append((i, [r.random() < p for _ in range(width * height)], [r.random() < 0.5 for _ in range(width * height)]))
    df = spark.createDataFrame(rows, "i int, a array<boolean>, b array<boolean>").select("i", masks.runs_of(F.col("a")).alias("a"), masks.runs_of(F.col("b")).alias("b"))
    one = {x["i"]: x for x in df.select("i", masks.area(F.col("a")).alias("area"), masks.box(F.col("a"), F.lit(width)).alias("box")).collect()}
    two = {x["i"]: x for x in masks.overlap(df, ["i"], "a", "b").collect()}
    for i, a, b in rows:
        on = [(p % width, p // width) for p, v in enumerate(a) if v]
        xs, ys = [x for x, _ in on], [y for _, y in on]
        assert one[i]["area"] == len(on) and one[i]["box"] == ([min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1] if on else None)
        both, either = sum(x and y for x, y in zip(a, b)), sum(x or y for x, y in zip(a, b))
        assert (two[i]["area_a"], two[i]["area_b"], two[i]["both"], two[i]["either"]) == (sum(a), sum(b), both, either)
        assert two[i]["iou"] == (both / either if either else 0) and abs(two[i]["dice_loss"] - (1 - (2 * both + 1) / (sum(a) + sum(b) + 1))) < 1e-12


def test_upserts_rewrite_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    names = lambda: {str(p.relative_to(path)) for p in (tmp_path / "t").rglob("*.parquet")}
    rows = spark.range(500).select(F.col("id").alias("k"), F.lit(1).alias("v"), F.lit("a").alias("x"))
    assert findings.upsert_table(spark, path, rows, "k", "v", 16) == 16
    before = names()
    some = spark.createDataFrame([(3, 2, "new"), (3, 1, "old"), (9999, 1, "more")], "k bigint, v int, x string")
    touched = findings.upsert_table(spark, path, some, "k", "v", 16)
    assert touched <= 2 and len(before & names()) == 16 - touched
    read = lambda: sorted(tuple(r) for r in spark.read.parquet(path).select("k", "v", "x").collect())
    want = sorted([(i, 1, "a") for i in range(500) if i != 3] + [(3, 2, "new"), (9999, 1, "more")])
    assert read() == want
    findings.upsert_table(spark, path, some, "k", "v", 16)
    assert read() == want and findings.upsert_table(spark, path, some.limit(0), "k", "v", 16) == 0
    # the same by a stream, in batches of one file
    src = str(tmp_path / "src")
    for part in (rows, some, some):
        part.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    from millrace.streaming import reviews

    q = reviews.upserts(stream, str(tmp_path / "s"), "k", "v", 16).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "s")).select("k", "v", "x").collect()) == want


def test_image_headers(spark, tmp_path):
    rgba = np.zeros((4, 6, 4), np.uint8)
    rgba[..., 3] = 255
    (tmp_path / "a b.png").write_bytes(png(rgba))
    (tmp_path / "broken.jpg").write_bytes(bytes.fromhex("FFD8FFE0") + b"nothing")
    (tmp_path / "none.tif").write_bytes(b"text")
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.image_headers(spark, str(tmp_path)).collect()}
    p = got["a b.png"] if "a b.png" in got else got["a%20b.png"]
    assert (p["width"], p["height"], p["mode"], p["format"], p["readable"]) == (6, 4, "RGBA", "PNG", True)
    assert (got["broken.jpg"]["format"], got["broken.jpg"]["width"], got["broken.jpg"]["readable"]) == ("JPEG", None, False)
    assert (got["none.tif"]["format"], got["none.tif"]["readable"]) == (None, False)
