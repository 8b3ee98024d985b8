"""Queries that write files and read them again, in the shared folder, and DuckDB SQL for the rows that must come back."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import annotations, findings
from ..sources import files, sinks
from .catalog import SPLIT_SQL, docs_split, query, t


def _written(rows: DataFrame, name: str) -> str:
    """Rows of one text column as text files."""
    path = sinks.new_path(rows.sparkSession, name)
    rows.write.text(path)
    return path


def _xml(rows: DataFrame, name: str) -> str:
    """Elements of one text column as one XML file: a file has one root."""
    return _written(rows.agg(F.concat(F.lit("<all>"), F.array_join(F.collect_list("value"), ""), F.lit("</all>")).alias("value")), name)


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, '\"' || p_name || '\", ' || p_type AS note, CASE WHEN p_size % 3 <> 0 THEN p_brand END AS brand FROM part")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit('"'), "p_name", F.lit('", '), "p_type").alias("note"), F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).alias("brand"), F.lit("x").alias("extra"))
    path = sinks.new_path(spark, "csv")
    sinks.write_csv(rows, path, ["id", "note", "brand"])
    return files.csv_strings(spark, path, ["id", "note", "brand"])


@query("SELECT CAST(o_orderkey AS VARCHAR) AS epoch, CAST(o_totalprice AS VARCHAR) AS loss FROM orders ORDER BY o_orderkey DESC LIMIT 1")
def csv_last_row(spark, d):
    path = sinks.new_path(spark, "log")
    rows = t(spark, d, "orders").select(F.col("o_orderkey").alias("epoch"), F.col("o_totalprice").alias("loss"))
    sinks.write_csv(rows, path, ["epoch", "loss"], strict=True)
    read = files.csv_strings(spark, path, ["epoch", "loss"]).withColumn("_n", F.col("epoch").cast("bigint"))
    return files.last_row(read, "_n").drop("_n")


@query("SELECT event_id, event_type, value FROM events WHERE event_id % 10 <> 0")
def json_lines_round_trip(spark, d):
    path = sinks.new_path(spark, "jsonl")
    rows = t(spark, d, "events").select("event_id", "event_type", "value")
    sinks.write_json_lines(rows.where("event_id % 10 <> 0"), path)
    blank = _written(spark.createDataFrame([("",), ("  ",)], "value string"), "blank")
    return files.json_lines(spark, f"{path},{blank}".split(","), "event_id bigint, event_type string, value double").where("event_id is not null")


@query("SELECT n_nationkey, n_nationkey % 5 = 0 AS broken, CASE WHEN n_nationkey % 5 <> 0 THEN n_name END AS name FROM nation")
def json_documents_with_errors(spark, d):
    root = sinks.new_path(spark, "documents")
    rows = t(spark, d, "nation").collect()  # 25 rows by definition of the table: one file each
    for r in rows:
        body = "{" if r["n_nationkey"] % 5 == 0 else f'{{"name": "{r["n_name"]}"}}'
        sinks.write_bytes(spark, f"{root}/n{r['n_nationkey']}.json", body.encode())
    got = files.json_documents(spark, f"{root}/*.json", "name string")
    return got.select(F.regexp_extract("path", r"n([0-9]+)\.json$", 1).cast("int").alias("n_nationkey"), "broken", F.when(~F.col("broken"), F.col("document.name")).alias("name"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Crack,Spallation' WHEN 1 THEN 'Crack' WHEN 2 THEN 'named' ELSE 'unknown' END AS labels FROM part""")
def xml_object_labels(spark, d):
    m = F.col("p_size") % 4
    said = F.when(m == 0, "<Defect><Crack>1</Crack><Spallation> 1 </Spallation></Defect>").when(m == 1, "<name>x</name><Defect><Crack>1</Crack><Spallation>0</Spallation></Defect>").when(m == 2, "<name>named</name><Defect><Crack>0</Crack></Defect>").otherwise("")
    path = _xml(t(spark, d, "part").select(F.concat(F.lit("<object><id>"), F.col("p_partkey").cast("string"), F.lit("</id>"), said, F.lit("</object>")).alias("value")), "xml")
    got = files.xml_objects(spark, path, "object", "Defect", ["Crack", "Spallation"], "id bigint")
    return got.select(F.col("id").alias("p_partkey"), F.array_join("labels_found", ",").alias("labels"))


@query("""SELECT 'crop' || CAST(p_partkey AS VARCHAR) AS name, label FROM part, (SELECT unnest(['Crack', 'Rust']) AS label) WHERE (label = 'Crack' AND p_size % 2 = 0) OR (label = 'Rust' AND p_size % 3 = 0)""")
def xml_label_unpivot(spark, d):
    flag = lambda c: F.when(c, " 1 ").otherwise("0")
    s = F.col("p_size")
    line = F.concat(F.lit('<Defect name="crop'), F.col("p_partkey").cast("string"), F.lit('"><Crack>'), flag(s % 2 == 0), F.lit("</Crack><Rust>"), flag(s % 3 == 0), F.lit("</Rust></Defect>"))
    return files.xml_positive_labels(spark, _xml(t(spark, d, "part").select(line.alias("value")), "meta"), "Defect", "name", ["Crack", "Rust"])


def _archive(spark: SparkSession, d: str) -> str:
    """One ZIP file of the nations, some in a second folder."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for r in t(spark, d, "nation").orderBy("n_nationkey").collect():  # 25 rows by definition of the table
            n = r["n_nationkey"]
            z.writestr(f"{'train' if n % 2 else 'test'}/{r['n_name']}.{'TXT' if n % 3 else 'bin'}", r["n_name"])
            if n % 4 == 0:
                z.writestr(f"train/again/{r['n_name'].lower()}.txt", "later")
                z.writestr(f"__MACOSX/train/._{r['n_name']}.txt", "fork")
    root = sinks.new_path(spark, "zip")
    sinks.write_bytes(spark, f"{root}/nations.zip", out.getvalue())
    return root


@query("""SELECT 'train/' || n_name || '.TXT' AS member, octet_length(encode(n_name)) AS size, sha256(n_name) AS sha256 FROM nation WHERE n_nationkey % 2 = 1 AND n_nationkey % 3 <> 0
UNION ALL SELECT 'train/again/' || lower(n_name) || '.txt', 5, sha256('later') FROM nation WHERE n_nationkey % 4 = 0""")
def zip_members(spark, d):
    m = files.zip_members(spark, _archive(spark, d), prefix="train/", suffix=".txt")
    return m.select("member", F.col("size"), F.sha2("payload", 256).alias("sha256"))


@query("""SELECT lower(n_name) AS stem, CASE WHEN n_nationkey % 4 = 0 THEN 'train/again/' || lower(n_name) || '.txt' ELSE CASE WHEN n_nationkey % 2 = 1 THEN 'train/' ELSE 'test/' END || n_name || CASE WHEN n_nationkey % 3 = 0 THEN '.bin' ELSE '.TXT' END END AS member FROM nation""")
def zip_members_by_stem(spark, d):
    return files.members_by_stem(files.zip_members(spark, _archive(spark, d), payload=False)).select("stem", "member")


@query("""SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS cls, CASE WHEN l_linenumber % 4 = 0 THEN 'odd' WHEN l_linenumber % 4 = 1 THEN 'too_few' WHEN l_linenumber % 4 = 2 THEN 'out_of_range' END AS reason, CASE WHEN l_linenumber % 4 = 3 THEN 3 ELSE 0 END AS points, count(*) AS n FROM lineitem GROUP BY ALL""")
def label_file_geometry(spark, d):
    m = F.col("l_linenumber") % 4
    numbers = F.when(m == 0, " 0.1 0.1 0.2 0.2 0.3 0.3 0.4").when(m == 1, " 0.1 0.1").when(m == 2, " 0.1 0.1 0.2 0.2 0.3 3").otherwise(" 0 0 1 0 1 1")
    text = t(spark, d, "lineitem").select("l_orderkey", F.concat(F.col("l_linenumber").cast("string"), numbers, F.lit("\n\n")).alias("text"))
    each = text.select("l_orderkey", F.explode(files.label_lines(F.col("text"))).alias("l"))
    g = each.select("l_orderkey", "l.cls", files.label_geometry(F.col("l.numbers"), F.lit(640.0), F.lit(480.0)).alias("g"))
    return g.groupBy("l_orderkey", "cls", F.col("g.reason").alias("reason"), F.coalesce(F.size("g.polygon"), F.lit(0)).alias("_p")).agg(F.count(F.lit(1)).alias("n")).withColumn("points", F.greatest("_p", F.lit(0))).drop("_p")


@query("""SELECT CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'val' END AS split, count(*) AS n FROM documents GROUP BY 1""")
def shard_rows(spark, d):
    root = sinks.new_path(spark, "shards")
    x = t(spark, d, "documents").select("doc_id")
    for split, m in (("train", 0), ("val", 1)):
        raw = f"{root}/{split}"
        x.where(f"doc_id % 2 = {m}").write.parquet(raw)
        for i, f in enumerate(sorted(r[0] for r in spark.read.parquet(raw).select("_metadata.file_path").distinct().collect())):  # a few shards
            sinks.rename_file(spark, f, f"{root}/{split}_tiled-{i:05d}.parquet")
    return files.rows_by_shard(spark, f"{root}/*.parquet")


@query("""SELECT doc_id, quality, toxic FROM (SELECT *, file_row_number AS n FROM read_parquet('{labels}', file_row_number = true)) WHERE n % 7 = 0""".replace("read_parquet('{labels}', file_row_number = true)", "(SELECT *, row_number() OVER () - 1 AS file_row_number FROM labels)"))
def row_point_lookup(spark, d):
    at = files.table_places(spark, f"{d}/labels.parquet", files.parquet_with_position(spark, f"{d}/labels.parquet", []))
    wanted = at.where("place % 7 = 0").select("file_name", "row_index")
    return files.parquet_lookup(spark, f"{d}/labels.parquet", ["doc_id", "quality", "toxic"], wanted).select("doc_id", "quality", "toxic")


@query("SELECT doc_id, CAST(row_index AS BIGINT) AS row_index FROM (SELECT doc_id, row_number() OVER () - 1 AS row_index FROM labels) WHERE row_index < 32")
def first_rows(spark, d):
    first = files.first_rows(spark, f"{d}/labels.parquet", ["doc_id"], 32)
    return files.table_places(spark, f"{d}/labels.parquet", first).select("doc_id", F.col("place").alias("row_index"))


@query(f"""WITH l AS (SELECT {SPLIT_SQL} AS split, source, string_agg(CAST(doc_id AS VARCHAR) || ' ' || lang, chr(10) ORDER BY doc_id) AS label_lines FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2) SELECT split, source, label_lines FROM l""")
def label_dataset(spark, d):
    """What is written to the folder, read back from there."""
    root = sinks.new_path(spark, "dataset")
    rows = docs_split(spark, d).where("lang is not null").select("split", "source", "doc_id", F.concat_ws(" ", F.col("doc_id").cast("string"), "lang").alias("line"))
    sinks.label_dataset(rows, root, "source", "doc_id", "line", "split", ["crack", "spalling"])
    read = spark.read.option("recursiveFileLookup", True).text(f"{root}/labels", wholetext=True)
    part = lambda i: F.regexp_extract(F.col("_metadata.file_path"), r"/labels/([^/]+)/([^/]+)[.]txt$", i)
    return read.select(part(1).alias("split"), part(2).alias("source"), F.rtrim("value", F.lit("\n")).alias("label_lines"))


@query("""SELECT s_suppkey, sha256(s_name) AS sha256, octet_length(encode(s_name)) AS size, 'written' AS first, 'reused_identical' AS again, CASE WHEN s_suppkey % 3 = 0 THEN 'overwritten' ELSE 'reused_identical' END AS other FROM supplier""")
def files_of_rows(spark, d):
    """A file a supplier, written three times by executors: new, the same again, and with some other contents."""
    root = sinks.new_path(spark, "derived")
    key = F.col("s_suppkey").cast("string")
    rows = t(spark, d, "supplier").select("s_suppkey", F.concat((F.col("s_suppkey") % 7).cast("string"), F.lit("/"), key, F.lit(".txt")).alias("path"), F.col("s_name").alias("content"))
    other = rows.withColumn("content", F.when(F.col("s_suppkey") % 3 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    first, again, third = (sinks.write_files(x, f"{root}/files", replace=replace, report=f"{root}/{n}") for n, (x, replace) in enumerate(((rows, False), (rows, False), (other, True))))
    out = first.withColumnRenamed("state", "first").join(again.select("path", F.col("state").alias("again")), "path").join(third.select("path", F.col("state").alias("other")), "path")
    return rows.select("s_suppkey", "path").join(out, "path").select("s_suppkey", "sha256", "size", "first", "again", "other")


@query("""SELECT count(*) AS files, 'written' AS first, 'reused_identical' AS again, 'overwritten' AS other FROM region""")
def idempotent_writes(spark, d):
    root = sinks.new_path(spark, "derived")
    states = []
    for r in t(spark, d, "region").collect():  # 5 rows by definition of the table
        path = f"{root}/{r['r_name']}"
        states.append((sinks.write_bytes(spark, path, b"1"), sinks.write_bytes(spark, path, b"1"), sinks.write_bytes(spark, path, b"2", overwrite=True)))
    return spark.createDataFrame(states, "first string, again string, other string").groupBy("first", "again", "other").agg(F.count(F.lit(1)).alias("files"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1""")
def upserted_table(spark, d):
    """The last event of each user, from a table that is brought up to date three times, once with what it had."""
    root = sinks.new_path(spark, "upserts")
    e = t(spark, d, "events").select("user_id", "event_id", "event_type")
    for part in (e.where("event_id % 3 = 0"), e.where("event_id % 3 <> 0"), e.where("event_id % 3 = 0")):
        findings.upsert_table(spark, root, part, "user_id", "event_id", 16)
    return spark.read.parquet(root).select("user_id", "event_id", "event_type")


@query("""SELECT sha256(text) || '  docs/' || CAST(doc_id AS VARCHAR) || '.txt' AS line, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents WHERE doc_id % 10 <> 3""")
def hash_manifest(spark, d):
    x = t(spark, d, "documents").select(F.concat(F.when(F.col("doc_id") % 2 == 0, "docs/").otherwise("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    out = sinks.hash_manifest(x.unionAll(x.limit(3)).unionAll(x.limit(2).withColumn("path", F.concat(F.lit("cache/"), "path"))), "path", "text", ["docs"], r"3\.txt$")
    return out.select("line", F.col("size").cast("bigint").alias("size"))


@query("""SELECT CAST(doc_id AS VARCHAR) || '.txt' AS path, CASE WHEN doc_id % 6 = 0 THEN 'missing' ELSE 'mismatch' END AS problem FROM documents WHERE doc_id % 6 = 0 OR doc_id % 5 = 0""")
def manifest_verification(spark, d):
    x = t(spark, d, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.sha2("text", 256).alias("sha256"))
    lines = x.select(F.concat_ws("  ", F.when(F.col("doc_id") % 5 == 0, F.sha2("path", 256)).otherwise(F.upper("sha256")), "path").alias("value"))
    return sinks.verify_manifest(lines, x.where("doc_id % 6 <> 0"))


@query("""SELECT kind, (SELECT count(*) FROM nation) AS n FROM (SELECT unnest(['csv', 'html', 'json']) AS kind)""")
def exports(spark, d):
    rows, root, out = t(spark, d, "nation"), sinks.new_path(spark, "export"), None
    for kind in ("json", "csv", "html"):
        read = spark.read.text(sinks.export(rows, root, kind)).where("value not like 'n_nationkey,%'")
        one = read.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT 'nations' AS key, 'open' AS licence, CAST(sum(length(n_name)) AS BIGINT) AS bytes FROM nation UNION ALL SELECT 'nothing', 'closed', 0""")
def literal_sources(spark, d):
    root = sinks.new_path(spark, "literal")
    for r in t(spark, d, "nation").collect():  # 25 rows by definition of the table
        sinks.write_bytes(spark, f"{root}/a/{r['n_nationkey']}", r["n_name"].encode())
    return files.literal_sources(spark, [("nations", "open"), ("nothing", "closed")], "key string, licence string", {"nations": root}, "key")


@query("""SELECT sha256(n) AS sha256, min(k) AS first FROM (SELECT CAST(n_regionkey AS VARCHAR) AS n, n_nationkey AS k FROM nation) GROUP BY 1""")
def uploads_once(spark, d):
    root = sinks.new_path(spark, "uploads")
    for r in t(spark, d, "nation").collect():  # 25 rows by definition of the table
        sinks.write_bytes(spark, f"{root}/{r['n_nationkey']:03d}.txt", str(r["n_regionkey"]).encode())
    return files.uploads(spark, root).select("sha256", F.regexp_extract("name", "^([0-9]+)", 1).cast("int").alias("first"))


@query("""SELECT lower(n_name) AS stem, n_nationkey % 3 <> 0 AS has_image, n_nationkey % 4 <> 0 AS has_label FROM nation WHERE n_nationkey % 3 <> 0 OR n_nationkey % 4 <> 0""")
def pairs_by_stem(spark, d):
    n = t(spark, d, "nation")
    listing = n.where("n_nationkey % 3 <> 0").select(F.concat(F.lit("images/"), "n_name", F.lit(".PNG")).alias("path")).unionAll(n.where("n_nationkey % 4 <> 0").select(F.concat(F.lit("labels/"), F.lower("n_name"), F.lit(".txt")).alias("path")))
    return files.pairs_by_stem(listing, ".png", ".txt").select("stem", F.col("left_path").isNotNull().alias("has_image"), F.col("right_path").isNotNull().alias("has_label"))


@query("SELECT l_orderkey, count(*) AS findings, count(DISTINCT l_linenumber || ' ' || l_partkey || ' ' || l_discount || ' ' || l_returnflag || ' ' || l_suppkey) AS ids FROM lineitem GROUP BY 1")
def built_findings(spark, d):
    """Findings get one id for each detection, as a name-based UUID."""
    rows = t(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("label"), F.array(*[F.col(c).cast("double") for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_linenumber")]).alias("box"), F.col("l_discount").alias("score"))
    built = findings.build_findings(rows, "l_orderkey", "label", "box", "score", F.struct(F.lit(1.0).alias("length"), F.lit(1.0).alias("max_width"), F.lit(1.0).alias("area")))
    flat = findings.flatten(built).where(F.col("finding_id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"))
    return flat.groupBy(F.col("sample_id").alias("l_orderkey")).agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("finding_id").alias("ids"))


@query("SELECT n_nationkey, n_nationkey % 4 AS links, n_nationkey % 4 - CASE WHEN n_nationkey % 4 > 2 THEN 1 ELSE 0 END AS good FROM nation WHERE n_nationkey % 4 > 0")
def link_targets(spark, d):
    """Markdown links of texts, and how many of them are in a listing."""
    k = (F.col("n_nationkey") % 4).cast("int")
    text = F.array_join(F.transform(F.sequence(F.lit(0), k), lambda i: F.when(i > 0, F.concat(F.lit("see [doc]("), i.cast("string"), F.lit(".md) "))).otherwise("none [x] (y)")), "")
    rows = t(spark, d, "nation").select("n_nationkey", F.explode(files.links(text)).alias("target"))
    there = spark.createDataFrame([("1.md",), ("2.md",)], "target string").withColumn("there", F.lit(1))
    return rows.join(F.broadcast(there), "target", "left").groupBy("n_nationkey").agg(F.count(F.lit(1)).cast("int").alias("links"), F.count("there").cast("int").alias("good"))


@query("""SELECT p_partkey, 'a' || p_size AS parent, 'x_1' AS stem, CASE p_size % 3 WHEN 0 THEN 'val' WHEN 1 THEN 'train' ELSE 'unknown' END AS split FROM part""")
def names_of_paths(spark, d):
    m = F.col("p_size") % 3
    folder = F.when(m == 0, "data/val/").when(m == 1, "data/other/train_").otherwise("data/other/")
    rows = t(spark, d, "part").select("p_partkey", F.concat(F.lit("a"), F.col("p_size").cast("string"), F.lit("_crop_"), F.col("p_partkey").cast("string")).alias("crop"), F.concat(folder, F.lit("X_1.JPG")).alias("path"))
    return rows.select("p_partkey", labels.parent_name(F.col("crop")).alias("parent"), F.replace(labels.stem(F.col("path")), F.lit("train_")).alias("stem"), labels.split_of_path(F.col("path"), ["train", "val"]).alias("split"))


@query("""SELECT 'docs/' || doc_id || '.md' AS path, '../docs/' || (doc_id + 1) || '.md' AS target FROM documents WHERE doc_id + 1 NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)""")
def missing_links(spark, d):
    """Each document links to the next one, to the web and to a place in itself; every third is no file."""
    key, after = F.col("doc_id").cast("string"), (F.col("doc_id") + 1).cast("string")
    docs = t(spark, d, "documents").select(F.concat(F.lit("docs/"), key, F.lit(".md")).alias("path"), F.concat(F.lit("see [next](../docs/"), after, F.lit(".md), [web](https://x.example/a.md) and [top](#top)")).alias("text"))
    there = t(spark, d, "documents").where("doc_id % 3 <> 0").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    return files.missing_links(docs, "path", "text", there)


@query("""WITH r AS (SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN '255-255-255-255' WHEN 1 THEN '255-0-0-255' WHEN 2 THEN '255-255-0-255' END AS c, vec_id % 5 AS n FROM embeddings)
SELECT vec_id, 'color-' || c AS annotation_id, CASE vec_id % 4 WHEN 0 THEN 'crack' WHEN 1 THEN 'spalling' ELSE 'rust_staining' END AS canonical_label, CASE WHEN vec_id % 4 = 2 THEN 'weak' ELSE 'direct' END AS mapping_strength, n AS pixel_count FROM r WHERE c IS NOT NULL AND n > 0""")
def mask_colour_annotations(spark, d):
    m = F.col("vec_id") % 4
    rgba = lambda *v: F.array(*[F.lit(x) for x in v])
    colour = F.when(m == 0, rgba(255, 255, 255, 255)).when(m == 1, rgba(255, 0, 0, 255)).when(m == 2, rgba(255, 255, 0, 255)).otherwise(rgba(0, 0, 1, 255))
    rows = t(spark, d, "embeddings").select("vec_id", colour.alias("rgba"), (F.col("vec_id") % 5).alias("pixel_count"), F.lit(None).cast("array<double>").alias("box_xywh"))
    return annotations.from_mask_colours(rows, "vec_id").select("vec_id", "annotation_id", "canonical_label", "mapping_strength", "pixel_count")
