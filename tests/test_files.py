import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.operators import annotations, findings
from millrace.sources import files, sinks
from millrace.streaming import reviews


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("train/Img1.PNG", b"x")
        z.writestr("train/b/img1.png", b"yy")
        z.writestr("__MACOSX/train/._img1.png", b"z")
        z.writestr("train/c.txt", b"t")
    m = files.zip_members(spark, str(tmp_path), prefix="train/", suffix=".png")
    assert sorted((r["member"], bytes(r["payload"])) for r in m.collect()) == [("train/Img1.PNG", b"x"), ("train/b/img1.png", b"yy")]
    assert [r["member"] for r in files.members_by_stem(m).collect()] == ["train/b/img1.png"]


def test_label_files(spark):
    df = spark.createDataFrame([("0 0.1 0.1 0.5 0.1 0.5 0.5\nbad 1\n\n2 0.1 0.2\n1 2 2 2 2 2 2",)], "t string").select(F.explode(files.label_lines(F.col("t"))).alias("l"))
    got = df.select("l.cls", files.label_geometry(F.col("l.numbers"), F.lit(100.0), F.lit(200.0)).alias("g")).collect()
    assert [r["cls"] for r in got] == [0, None, 2, 1]
    assert got[0]["g"]["polygon"] == [[10, 20], [50, 20], [50, 100]]
    assert [r["g"]["reason"] for r in got] == [None, "too_few", "too_few", "out_of_range"]


def test_csv_json_xml(spark, tmp_path):
    rows = spark.createDataFrame([("1", 'a "q", b', None)], "id string, note string, z string")
    sinks.write_csv(rows, str(tmp_path / "c"), ["id", "note"])
    assert [tuple(r) for r in files.csv_strings(spark, str(tmp_path / "c"), ["id", "note"]).collect()] == [("1", 'a "q", b')]
    with pytest.raises(ValueError):
        sinks.write_csv(rows, str(tmp_path / "d"), ["id"], strict=True)
    (tmp_path / "ok.json").write_text('{"a": 1}')
    (tmp_path / "no.json").write_text("{")
    got = {r["path"].rsplit("/", 1)[1]: (r["document"], r["broken"]) for r in files.json_documents(spark, str(tmp_path / "*.json"), "a int").collect()}
    assert got["ok.json"][0]["a"] == 1 and not got["ok.json"][1] and got["no.json"][1]
    (tmp_path / "x.xml").write_text("<r><object><name>n1</name></object><object><name>n2</name></object></r>")
    assert sorted(r[0] for r in files.xml_rows(spark, str(tmp_path / "x.xml"), "object", "name string").collect()) == ["n1", "n2"]
    there, found = files.optional(spark, str(tmp_path / "none"), "a int", lambda: None)
    assert not found and there.count() == 0


def test_digests_and_manifest(spark):
    f = spark.createDataFrame([("b", b"2"), ("a", b"1")], "p string, c binary")
    d = sinks.file_digests(f, "p", "c")
    assert [r["path"] for r in d.collect()] == ["a", "b"]
    again = sinks.folder_digest(sinks.file_digests(f.orderBy("p"), "p", "c")).first()
    assert again == sinks.folder_digest(d).first()
    lines = d.select(F.concat_ws("  ", "sha256", "path").alias("value")).unionAll(spark.createDataFrame([("0" * 64 + "  a",), ("1" * 64 + "  gone",)], "value string"))
    assert sorted(map(tuple, sinks.verify_manifest(lines, d).collect())) == [("a", "mismatch"), ("gone", "missing")]
    assert {r["path"]: r["action"] for r in sinks.plan_writes(d, d.where("path = 'a'").select("path", F.lit("x").alias("sha256"))).collect()} == {"a": "conflict", "b": "write"}
    assert [r[0] for r in spark.createDataFrame([("a/b",), ("../x",), ("/y",)], "r string").select(sinks.safe_path(F.lit("/o"), F.col("r"))).collect()] == ["/o/a/b", None, None]


def test_parquet_lookup(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "p"))
    at = files.parquet_with_position(spark, str(tmp_path / "p"), ["id"])
    want = at.where("row_index in (3, 50)").select("file_name", "row_index")
    assert sorted(r["id"] for r in files.parquet_lookup(spark, str(tmp_path / "p"), ["id"], want).collect()) == [3, 50]


def test_places_in_a_table_of_files(spark, tmp_path):
    from millrace.plans import catalog, exchange  # noqa: F401

    sizes = [10, 0, 3, 25, 1]
    rows, first = [], 0
    for n, many in enumerate(sizes):
        rows += [(i, i % 2, i % 3) for i in range(first, first + many)]
        part = spark.createDataFrame(rows[first : first + many], "doc_id bigint, quality int, toxic int").coalesce(1)
        at = str(tmp_path / f"raw-{n}")
        part.write.parquet(at)
        for i, f in enumerate(sorted((tmp_path / f"raw-{n}").glob("*.parquet"))):
            (tmp_path / "labels.parquet").mkdir(exist_ok=True)
            f.rename(tmp_path / "labels.parquet" / f"part-{n:04d}-{i}.parquet")
        first += many
    q = catalog.QUERIES
    assert sorted(tuple(r) for r in q["row_point_lookup"](spark, str(tmp_path)).collect()) == [r for r in rows if r[0] % 7 == 0]
    assert sorted(tuple(r) for r in q["first_rows"](spark, str(tmp_path)).collect()) == [(i, i) for i in range(32)]


def test_overlay_and_views(spark):
    a = annotations.normalise(spark.createDataFrame([(1, 0, "Rust"), (1, 1, "Cavity")], "s int, a int, native string"), "native")
    led = spark.createDataFrame([(1, 1, "crack", "positive")], "s int, a int, canonical_label string, annotation_status string")
    p = annotations.payloads(annotations.overlay(a, led, ["s", "a"]), "s", "a").first()
    assert p["labels"] == "crack|rust_staining" and [x["reviewed"] for x in p["annotations"]] == [False, True]
    v = annotations.task_views(spark.createDataFrame([(1, 0), (2, 3)], "s int, n int"), "n")
    assert v.groupBy("task").count().where("task = 'segmentation'").first()["count"] == 1 and v.count() == 7


def test_findings(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, ver int")
    new = spark.createDataFrame([(1, "c", 1)], "k int, v string, ver int")
    assert sorted((r["k"], r["v"]) for r in findings.upsert(old, new, "k", "ver").collect()) == [(1, "c"), (2, "b")]
    import uuid

    assert spark.createDataFrame([("x",)], "n string").select(findings.uuid5("n")).first()[0] == str(uuid.uuid5(uuid.NAMESPACE_URL, "x"))
    merged = findings.merge_partial(old, new.select("k", F.lit("z").alias("v"), F.lit(9).alias("ver")), "k", ["v"]).collect()
    assert sorted((r["k"], r["v"], r["ver"]) for r in merged) == [(1, "z", 1), (2, "b", 1)]


def test_streaming_matches_batch(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))
    q = reviews.latest_by_key(stream, "user_id", ["ts", "event_id"]).writeStream.outputMode("complete").format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(repr, spark.sql("select user_id, event_id from latest").collect())) == sorted(map(repr, reviews.latest_by_key(rows, "user_id", ["ts", "event_id"]).select("user_id", "event_id").collect()))
    n = reviews.windowed_counts(rows, "ts", "event_type", "value", "1 day")
    assert n.agg(F.sum("n")).first()[0] == rows.count()
    assert reviews.sessions(rows, "ts", "user_id").count() > 0
    assert reviews.distinct_events(stream, "event_id", "ts").isStreaming


class Counted:
    """A file that counts the bytes read from it."""

    def __init__(self, path):
        self.f, self.read_bytes = open(path, "rb"), 0

    def read(self, n=-1):
        out = self.f.read(n)
        self.read_bytes += len(out)
        return out

    def __getattr__(self, name):
        return getattr(self.f, name)


def test_only_wanted_row_groups_are_read(spark, tmp_path):
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    from millrace.sources import ranges

    os.makedirs(tmp_path / "p")
    for k in range(3):
        rows = 10_000
        ids = [k * rows + i for i in range(rows)]
        pq.write_table(pa.table({"id": ids, "text": [f"{i * 7919 % 10007:x}" * 20 for i in ids]}), tmp_path / "p" / f"f{k}.parquet", row_group_size=1000)
    path = str(tmp_path / "p")
    groups = ranges.row_groups(spark, path)
    assert groups.count() == 30 and groups.agg(F.sum("rows")).first()[0] == 30_000
    want = [("f0.parquet", 0), ("f0.parquet", 999), ("f2.parquet", 5000), ("f2.parquet", 5000), ("f2.parquet", 9999)]
    wanted = spark.createDataFrame(want, "file_name string, row_index bigint")
    got = files.parquet_lookup(spark, path, ["id"], wanted).collect()
    assert sorted((r["id"], r["file_name"], r["row_index"]) for r in got) == [(0, "f0.parquet", 0), (999, "f0.parquet", 999), (25_000, "f2.parquet", 5000), (29_999, "f2.parquet", 9999)]
    with pytest.raises(LookupError):
        files.parquet_lookup(spark, path, ["id"], spark.createDataFrame([("f0.parquet", 10_000)], wanted.schema))
    assert files.parquet_lookup(spark, path, ["id"], wanted.limit(0)).count() == 0
    # bytes: a column of one row group, and not the file
    one = Counted(tmp_path / "p" / "f1.parquet")
    assert ranges.read_rows(one, 3, ["id"], [5, 0]).column("id").to_pylist() == [13_005, 13_000]
    size = os.path.getsize(tmp_path / "p" / "f1.parquet")
    footer = int.from_bytes(open(tmp_path / "p" / "f1.parquet", "rb").read()[-8:-4], "little") + 8
    column = pq.read_metadata(tmp_path / "p" / "f1.parquet").row_group(3).column(0).total_compressed_size
    assert one.read_bytes < max(footer, 65536) + footer + column + 1024 and one.read_bytes < size / 2
    first = files.first_rows(spark, path, ["id"], 1500)
    assert sorted(r["id"] for r in first.collect()) == list(range(1500))
    assert files.first_rows(spark, path, ["id"], 50_000).count() == 30_000


def test_members_are_dealt_over_tasks(spark, tmp_path):
    import random

    r = random.Random(1)
    want = {}
    with zipfile.ZipFile(tmp_path / "big.zip", "w") as z:
        for i in range(200):
            data = r.randbytes(20_000)
            z.writestr(zipfile.ZipInfo(f"d/{i:03d} é.bin"), data, zipfile.ZIP_DEFLATED if i % 2 else zipfile.ZIP_STORED)
            want[f"d/{i:03d} é.bin"] = data
        z.mkdir("empty")
    m = files.zip_members(spark, str(tmp_path))
    sizes = [len(p) for p in m.rdd.glom().collect()]
    assert sum(sizes) == 201 and max(sizes) < 120 and sum(s > 0 for s in sizes) > 1
    assert {x["member"]: bytes(x["payload"]) for x in m.where("not is_dir").collect()} == want
    assert [x["payload"] for x in m.where("is_dir").collect()] == [None]
    raw = bytearray((tmp_path / "big.zip").read_bytes())
    raw[200] ^= 1
    (tmp_path / "big.zip").write_bytes(raw)
    with pytest.raises(Exception, match="checksum|BadZip"):
        files.zip_members(spark, str(tmp_path)).collect()


def test_files_are_put_in_place_by_the_commit(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"a/{i}.txt", f"text {i}") for i in range(20)], "path string, content string").repartition(4)
    state = lambda df: sorted((r["state"], r["path"]) for r in df.collect())
    assert {s for s, _ in state(sinks.write_files(rows, root, report=f"{tmp_path}/r1"))} == {"written"}
    assert {s for s, _ in state(sinks.write_files(rows, f"file://{root}", report=f"{tmp_path}/r2"))} == {"reused_identical"}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a"] and (tmp_path / "out/a/7.txt").read_text() == "text 7"
    changed = rows.withColumn("content", F.when(F.col("path") == "a/3.txt", "new").otherwise(F.col("content"))).unionAll(spark.createDataFrame([("b.txt", "b")], rows.schema))
    with pytest.raises(Exception, match="other bytes"):
        sinks.write_files(changed, root)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a"] and (tmp_path / "out/a/3.txt").read_text() == "text 3"
    got = state(sinks.write_files(changed, root, replace=True, report=f"{tmp_path}/r3"))
    assert [x for x in got if x[0] != "reused_identical"] == [("overwritten", "a/3.txt"), ("written", "b.txt")] and (tmp_path / "out/a/3.txt").read_text() == "new"
    with pytest.raises(Exception, match="leaves the folder"):
        sinks.write_files(spark.createDataFrame([("../x", "x")], rows.schema), root)
    fails = F.when(F.col("path") == "b.txt", F.raise_error(F.lit("task failed"))).otherwise(F.col("path"))
    with pytest.raises(Exception, match="task failed"):
        sinks.write_files(changed.withColumn("path", F.concat(fails, F.lit(".new"))), root)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a", "b.txt"] and len(list((tmp_path / "out/a").iterdir())) == 20


def test_label_files_of_samples(spark, tmp_path):
    rows = spark.createDataFrame([("train", "s1", 2, "1 0.5"), ("train", "s1", 1, "0 0.25"), ("val", "s2", 1, "1 1")], "split string, sample string, n int, line string")
    sinks.label_dataset(rows, str(tmp_path / "set"), "sample", "n", "line", "split", ["crack", "rust"])
    assert (tmp_path / "set/labels/train/s1.txt").read_text() == "0 0.25\n1 0.5\n" and (tmp_path / "set/labels/val/s2.txt").read_text() == "1 1\n"
    assert "names: [crack, rust]" in (tmp_path / "set/data.yaml").read_text()
