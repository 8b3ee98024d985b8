"""Sources: CSV, JSON, JSON lines, XML, Parquet rows by position, ZIP members and label files."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import shard_split, stem
from . import ranges


def csv_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file with a header, all columns strings, blanks null."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "").csv(path)


def last_row(rows: DataFrame, order: str) -> DataFrame:
    """The row of greatest order; a table without rows raises when it is read."""
    best = rows.agg(F.max_by(F.struct(*rows.columns), F.col(order)).alias("r"), F.count(F.lit(1)).alias("n"))
    kind = best.schema["r"].dataType
    some = F.when(F.col("n") > 0, F.col("r")).otherwise(F.raise_error(F.lit("no rows to take the last of")).cast(kind))
    return best.select(some.alias("r")).select("r.*")


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row a file: path, document (null if broken), broken."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return text.select("path", F.from_json("value", schema).alias("document"), F.expr("try_parse_json(value) is null").alias("broken"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def xml_rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def xml_objects(spark: SparkSession, path: str, tag: str, group: str, labels: list[str], others: str = "") -> DataFrame:
    """Objects with `labels_found`: tags of the element `group` that say 1, in the order given; without any, the object's
    name, or unknown."""
    schema = f"name string, {group} struct<{','.join(f'{x}:string' for x in labels)}>" + (f", {others}" if others else "")
    rows = xml_rows(spark, path, tag, schema)
    said = F.array_compact(F.array(*[F.when(F.trim(F.col(f"{group}.{x}")) == "1", F.lit(x)) for x in labels]))
    said = F.coalesce(said, F.array().cast("array<string>"))
    return rows.withColumn("labels_found", F.when(F.size(said) > 0, said).otherwise(F.array(F.coalesce(F.trim("name"), F.lit("unknown")))))


def xml_positive_labels(spark: SparkSession, path: str, tag: str, key: str, labels: list[str]) -> DataFrame:
    """key, label: one row for each child element of `tag` that says 1; key is an attribute."""
    rows = xml_rows(spark, path, tag, f"_{key} string, " + ", ".join(f"`{x}` string" for x in labels))
    each = rows.unpivot([f"_{key}"], labels, "label", "said")
    return each.where(F.trim("said") == "1").select(F.col(f"_{key}").alias(key), "label")


def parquet_with_position(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Columns, the file they come from and the row's place in it."""
    return spark.read.parquet(path).select(*columns, F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.row_index").alias("row_index"))


def parquet_lookup(spark: SparkSession, path: str, columns: list[str], wanted: DataFrame) -> DataFrame:
    """Rows at wanted(file_name, row_index): only row groups that hold one are read. Places that the files do not have raise."""
    return ranges.rows_at(spark, path, columns, wanted)


def table_places(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """rows(file_name, row_index) with `place`: the row's place from 0 in the whole table, whose files follow each other by
    name. What the files before hold comes from footers."""
    sizes = ranges.row_groups(spark, path).groupBy("file_name").agg(F.sum("rows").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("file_name").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a file
    return rows.join(F.broadcast(sizes.select("file_name", before.alias("_before"))), "file_name").withColumn("place", F.col("_before") + F.col("row_index")).drop("_before")


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of Parquet files: no column is read, the footers' counts are added."""
    return spark.read.parquet(path).count()


def rows_by_shard(spark: SparkSession, path: str) -> DataFrame:
    """split, n of Parquet shards whose names begin with their split."""
    return spark.read.parquet(path).select(shard_split(F.col("_metadata.file_name")).alias("split")).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def first_rows(spark: SparkSession, path: str, columns: list[str], n: int) -> DataFrame:
    """The first n rows of Parquet files by file and place: only the row groups that hold them are read."""
    return ranges.first_rows(spark, path, columns, n)


def files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, name, size, content of files."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path)
    return read.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), "content")


def pairs_by_stem(listing: DataFrame, left: str, right: str) -> DataFrame:
    """stem, left_path, right_path of files(path) by ending, paired by lower-cased stem; either may be null."""
    p = F.lower("path")
    one = lambda e, n: listing.where(p.endswith(e.lower())).groupBy(stem(F.col("path")).alias("stem")).agg(F.min("path").alias(n))
    return one(left, "left_path").join(one(right, "right_path"), "stem", "full_outer")


# First bytes of image formats, and modes by number of channels.
FORMATS = (("89504E470D0A1A0A", "PNG"), ("FFD8FF", "JPEG"), ("49492A00", "TIFF"), ("4D4D002A", "TIFF"), ("424D", "BMP"), ("474946", "GIF"))
MODES = {1: "L", 3: "RGB", 4: "RGBA"}


def image_headers(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height, channels, mode, format, readable of image files, each decoded whole; what cannot be decoded has
    nulls but for the format that its first bytes tell (null if they tell none)."""
    i = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    ok = F.col("width") > 0
    size = lambda c: F.when(ok, F.col(c))
    plain = lambda p: F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p)
    one = lambda p: F.regexp_replace(plain(p), "^file:/*", "file:///")
    read = i.select(one(F.col("origin")).alias("path"), size("width").alias("width"), size("height").alias("height"), size("nChannels").alias("channels"), F.coalesce(ok, F.lit(False)).alias("readable"))
    head = F.hex(F.substring("content", 1, 8))
    kind, mode = F.lit(None).cast("string"), F.lit(None).cast("string")
    for first, name in FORMATS:
        kind = F.when(head.startswith(first), name).otherwise(kind)
    for channels, name in MODES.items():
        mode = F.when(F.col("channels") == channels, name).otherwise(mode)
    formats = files(spark, path).select(one(F.col("path")).alias("path"), kind.alias("format"))
    return read.join(formats, "path", "left").select("path", "width", "height", "channels", mode.alias("mode"), "format", "readable")


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """A folder of files sent in: path, name, size, sha256, content, each content once (the least path)."""
    f = files(spark, path).withColumn("sha256", F.sha2("content", 256))
    return f.groupBy("sha256").agg(F.min_by(F.struct("path", "name", "size", "content"), "path").alias("f")).select("f.path", "f.name", "f.size", "sha256", "f.content")


def literal_sources(spark: SparkSession, rows: list[tuple], schema: str, folders: dict[str, str], key: str) -> DataFrame:
    """Stated rows, with the bytes of the files below the folder of each key; 0 where there is none."""
    stated = spark.createDataFrame(rows, schema)
    sizes = None
    for k, folder in folders.items():
        one = files(spark, folder).agg(F.lit(k).alias(key), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
        sizes = one if sizes is None else sizes.unionByName(one)
    if sizes is None:
        return stated.withColumn("bytes", F.lit(0).cast("bigint"))
    return stated.join(F.broadcast(sizes), key, "left").na.fill(0, ["bytes"])  # one row a folder


def zip_members(spark: SparkSession, path: str, *, prefix: str = "", suffix: str = "", payload: bool = True) -> DataFrame:
    """Members of ZIP files as rows; suffix without regard to case; resource forks are left out.

    Directories are read first; members are dealt over tasks, each of which reads its own by ranges.
    """
    kept = ranges.zip_directory(spark, path).where(ranges.kept_members(prefix, suffix))
    if payload:
        return ranges.read_members(kept)
    return kept.select("archive", "ordinal", "member", "is_dir", "size", F.lit(None).cast("binary").alias("payload"))


def members_by_stem(members: DataFrame) -> DataFrame:
    """archive, stem, member: the last member of each lower-cased stem."""
    return members.where("not is_dir").groupBy("archive", stem(F.col("member")).alias("stem")).agg(F.max_by("member", "ordinal").alias("member"))


def label_lines(text: Column) -> Column:
    """Lines of a label file as structs: class (null if malformed), numbers."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    tokens = lambda x: F.split(x, r"\s+")
    return F.transform(lines, lambda x: F.struct(F.try_element_at(tokens(x), F.lit(1)).try_cast("int").alias("cls"), F.transform(F.slice(tokens(x), F.lit(2), F.size(tokens(x))), lambda v: v.try_cast("double")).alias("numbers")))


def label_geometry(numbers: Column, width: Column, height: Column) -> Column:
    """struct(polygon, reason): relative polygon numbers as pixel points, or why they are rejected."""
    bad = F.when(F.size(numbers) < 6, "too_few").when(F.size(numbers) % 2 == 1, "odd").when(F.exists(numbers, lambda v: v.isNull() | F.isnan(v)), "not_a_number").when(F.exists(numbers, lambda v: (v < 0) | (v > 1)), "out_of_range")
    pts = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(numbers) / 2).cast("int") - 1, F.lit(0))), lambda i: F.array(F.get(numbers, i * 2) * width, F.get(numbers, i * 2 + 1) * height))
    return F.struct(F.when(bad.isNull(), pts).alias("polygon"), bad.alias("reason"))


def optional(spark: SparkSession, path: str, schema: str, read) -> tuple[DataFrame, bool]:
    """read() if Spark finds the path, else an empty table, and whether it was there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return (read(), True) if there else (spark.createDataFrame([], schema), False)


def links(text: Column) -> Column:
    """Targets of Markdown links."""
    return F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1))


def local_links(documents: DataFrame, path: str, text: str) -> DataFrame:
    """path, target, resolved: links of Markdown documents to other files. Web and mail addresses and bare fragments are left
    out; a target is taken from its document's folder, with escapes decoded and `.` and `..` followed."""
    every = F.regexp_extract_all(F.col(text), F.lit(r"\[[^\]]*\]\(([^)]+)\)"), F.lit(1))
    each = documents.select(F.col(path).alias("path"), F.explode(every).alias("raw"))
    target = F.regexp_replace(F.split(F.regexp_replace(F.trim("raw"), "^[<>]+|[<>]+$", ""), "#", 2)[0], "^$", "")
    each = each.select("path", target.alias("target")).where("target <> '' and not target rlike '^(https?://|mailto:)'")
    decoded = F.url_decode(F.replace("target", F.lit("+"), F.lit("%2B")))
    whole = F.when(decoded.startswith("/"), decoded).otherwise(F.concat(F.regexp_extract("path", r"^(.*/)?", 0), decoded))
    step = lambda at, x: F.when(x.isin("", "."), at).when(x == "..", F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.concat(at, F.array(x)))
    parts = F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step)
    return each.withColumn("resolved", F.concat(F.when(whole.startswith("/"), "/").otherwise(""), F.array_join(parts, "/")))


def missing_links(documents: DataFrame, path: str, text: str, listing: DataFrame) -> DataFrame:
    """path, target of local links to what is neither a file of listing(path) nor a folder above one."""
    up = lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda n: F.array_join(F.slice(p, F.lit(1), n), "/"))
    there = listing.select(F.explode(up(F.split("path", "/"))).alias("resolved")).distinct()
    return local_links(documents, path, text).join(there, "resolved", "left_anti").select("path", "target")


_PART = "request string, ordinal int, field string, filename string, content binary"


def form_parts(requests: DataFrame, request: str, content_type: str, body: str) -> DataFrame:
    """Parts of multipart/form-data bodies: request, ordinal, field, filename (null for plain fields), content. Bodies of
    other types, or without their boundary, have none. A body is one row in a task."""
    name, file = re.compile(rb'[;\s]name="([^"]*)"'), re.compile(rb'[;\s]filename="([^"]*)"')

    def run(batches):
        for b in batches:
            out = []
            for key, kind, data in zip(*[c.to_pylist() for c in b.columns]):
                mark = re.search(r'boundary="?([^";,]+)', kind or "")
                if not mark or not (kind or "").lower().startswith("multipart/form-data"):
                    continue
                parts = (b"\r\n" + (data or b"")).split(b"\r\n--" + mark[1].encode())
                for n, part in enumerate(parts[1:]):
                    head, gap, content = part.partition(b"\r\n\r\n")
                    if part.startswith(b"--") or not gap or not (field := name.search(head)):
                        continue
                    f = file.search(head)
                    out.append((key, n, field[1].decode("utf-8", "replace"), f and f[1].decode("utf-8", "replace"), content))
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)], names=["request", "ordinal", "field", "filename", "content"])

    return requests.select(F.col(request).cast("string"), F.col(content_type), F.col(body).cast("binary")).mapInArrow(run, _PART)
