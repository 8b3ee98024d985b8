"""Files read by ranges on executors: Parquet row groups that hold wanted rows, and members of ZIP archives.

Footers and directories are read first, in tasks, and become rows; what is wanted of them is dealt over tasks, and each reads
its byte ranges only. Files may lie in any file system that Arrow opens (local, S3, GCS, HDFS).
"""

from __future__ import annotations

import struct
import zipfile
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructType

from .stash import stash


MEMBERS_BYTES = 32 << 20  # packed bytes of archive members that a task reads, about
MOST_TASKS = 100_000


def file_system(path: str):
    """Arrow's file system for a path as Spark names it, and the path in it."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(path)


def opened(path: str) -> pa.NativeFile:
    system, inner = file_system(path)
    return system.open_input_file(inner)


def _listing(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path, length of files; no content is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length")


def _tasks(spark: SparkSession, parts: int) -> int:
    """A number of tasks for so many parts, stated since the rows that name them are small: they would be put together."""
    return max(spark.sparkContext.defaultParallelism, min(parts, MOST_TASKS))


# --- Parquet ------------------------------------------------------------------------------------------------------


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """path, file_name, group, first, rows, bytes of the row groups of Parquet files, from their footers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for file in b.column(0).to_pylist():
                with opened(file) as f:
                    footer, first = pq.read_metadata(f), 0
                for g in range(footer.num_row_groups):
                    rows = footer.row_group(g).num_rows
                    out.append((file, file.rsplit("/", 1)[-1], g, first, rows, footer.row_group(g).total_byte_size))
                    first += rows
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)], names=["path", "file_name", "group", "first", "rows", "bytes"])

    return _listing(spark, path, "*.parquet").select("path").mapInArrow(run, "path string, file_name string, group int, first bigint, rows bigint, bytes bigint")


def read_rows(source: pa.NativeFile, group: int, columns: Sequence[str], places: Sequence[int]) -> pa.Table:
    """The rows at places of one row group: only its column chunks are read."""
    return pq.ParquetFile(source).read_row_group(group, columns=list(columns)).take(pa.array(places, pa.int64()))


def _read_groups(spark: SparkSession, path: str, columns: Sequence[str], wanted: DataFrame) -> DataFrame:
    """columns, file_name, row_index at wanted(path, file_name, group, first, indices): one row a row group."""
    own = spark.read.parquet(path).select(*columns).schema
    schema = StructType([*own.fields]).add("file_name", StringType()).add("row_index", LongType())
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, name, group, first, indices in zip(*[b.column(i).to_pylist() for i in range(5)]):
                with opened(file) as f:
                    t = read_rows(f, group, columns, [i - first for i in indices])
                t = t.append_column("file_name", pa.array([name] * len(indices), pa.string())).append_column("row_index", pa.array(indices, pa.int64()))
                yield from t.cast(arrow).combine_chunks().to_batches()

    some = stash(wanted.select("path", "file_name", "group", "first", "indices"), "groups")
    return some.repartition(_tasks(spark, some.count()), "path", "group").mapInArrow(run, schema)


def rows_at(spark: SparkSession, path: str, columns: Sequence[str], wanted: DataFrame) -> DataFrame:
    """columns, file_name, row_index of the rows at wanted(file_name, row_index), each once. Row groups without a wanted row
    are not read. Places that the files do not have raise."""
    want = wanted.select("file_name", "row_index").distinct()
    groups = row_groups(spark, path).withColumnRenamed("file_name", "_file")
    inside = (F.col("file_name") == F.col("_file")) & (F.col("row_index") >= F.col("first")) & (F.col("row_index") < F.col("first") + F.col("rows"))
    absent = want.join(groups, inside, "left_anti").limit(5).collect()
    if absent:
        raise LookupError(f"no rows at {[tuple(r) for r in absent]}")
    by = want.join(groups, inside).groupBy("path", "file_name", "group", "first").agg(F.sort_array(F.collect_list("row_index")).alias("indices"))
    return _read_groups(spark, path, columns, by)


def first_rows(spark: SparkSession, path: str, columns: Sequence[str], n: int) -> DataFrame:
    """columns, file_name, row_index of the first n rows by file and place. Only the row groups that hold them are read: of
    n groups with rows, which is as many as can be needed, those before the n-th row."""
    groups = row_groups(spark, path).where("rows > 0").orderBy("file_name", "path", "group").limit(n)
    upto = F.sum("rows").over(W.partitionBy(F.lit(0)).orderBy("file_name", "path", "group").rowsBetween(W.unboundedPreceding, -1))  # n rows at most
    some = groups.withColumn("_take", F.least("rows", F.lit(n) - F.coalesce(upto, F.lit(0)))).where("_take > 0")
    return _read_groups(spark, path, columns, some.withColumn("indices", F.sequence("first", F.col("first") + F.col("_take") - 1)))


# --- archives -----------------------------------------------------------------------------------------------------


def zip_directory(spark: SparkSession, path: str) -> DataFrame:
    """archive, ordinal, member, is_dir, size, at, packed, method, crc, locked of the members of ZIP files: their directories
    alone are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_()]
        names = ["archive", "ordinal", "member", "is_dir", "size", "at", "packed", "method", "crc", "locked"]
        for b in batches:
            for archive in b.column(0).to_pylist():
                with opened(archive) as f, zipfile.ZipFile(f) as z:
                    every = z.infolist()
                for start in range(0, len(every), 10_000):
                    part = [(archive, start + n, i.filename, i.is_dir(), i.file_size, i.header_offset, i.compress_size, i.compress_type, i.CRC, bool(i.flag_bits & 1)) for n, i in enumerate(every[start : start + 10_000])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), kinds)], names=names)

    kind = "archive string, ordinal int, member string, is_dir boolean, size bigint, at bigint, packed bigint, method int, crc bigint, locked boolean"
    return _listing(spark, path, "*.zip").select("path").mapInArrow(run, kind)


def read_member(source: pa.NativeFile, at: int, packed: int, method: int, crc: int) -> bytes:
    """One member by the place of its header; stored and deflated ones."""
    source.seek(at)
    head = source.read(30)
    if head[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile(f"no member at {at}")
    source.seek(at + 30 + sum(struct.unpack("<HH", head[26:30])))
    data = source.read(packed)
    if method == zipfile.ZIP_DEFLATED:
        data = zlib.decompress(data, -15)
    elif method != zipfile.ZIP_STORED:
        raise NotImplementedError(f"compression method {method}")
    if zlib.crc32(data) != crc:
        raise zipfile.BadZipFile(f"wrong checksum of the member at {at}")
    return data


def read_members(directory: DataFrame) -> DataFrame:
    """archive, ordinal, member, is_dir, size, payload of rows of `zip_directory`, dealt over all tasks; a task reads the bytes
    of one member after the other. Encrypted members raise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for b in batches:
            for n, (archive, is_dir, at, packed, method, crc, locked) in enumerate(zip(*[b.column(c).to_pylist() for c in (0, 3, 5, 6, 7, 8, 9)])):
                if locked:
                    raise zipfile.BadZipFile(f"a member of {archive} is encrypted")
                if archive != name:
                    name, source = archive, opened(archive)
                data = None if is_dir else read_member(source, at, packed, method, crc)
                yield pa.RecordBatch.from_arrays([*b.slice(n, 1).columns[:5], pa.array([data], pa.binary())], names=["archive", "ordinal", "member", "is_dir", "size", "payload"])

    held = stash(directory, "directory")
    spark = directory.sparkSession
    size = held.agg(F.sum("packed")).first()[0] or 0
    dealt = held.repartition(_tasks(spark, size // MEMBERS_BYTES + 1), "archive", "ordinal").sortWithinPartitions("archive", "at")
    return dealt.mapInArrow(run, "archive string, ordinal int, member string, is_dir boolean, size bigint, payload binary")


def kept_members(prefix: str, suffix: str) -> Column:
    """Members below prefix, with suffix in any case, without the resource forks of another system."""
    parts = F.split("member", "/")
    return F.col("member").startswith(prefix) & F.lower("member").endswith(suffix.lower()) & ~F.array_contains(parts, "__MACOSX") & ~F.element_at(parts, -1).startswith("._")
