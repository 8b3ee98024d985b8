"""Sinks: tables with fixed columns, JSON lines, digests, and writes that reuse what is there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .file_writer import write_files
from .stash import new_path, stash, work_dir  # noqa: F401


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_bytes(spark: SparkSession, path: str, data: bytes, overwrite: bool = False) -> str:
    """Write one file; written, reused_identical where the same bytes are there, and an error where others are unless
    overwrite. For manifests and single assets: the bytes pass through the driver."""
    fs, p = _file_system(spark, path)
    state = "written"
    if fs.exists(p):
        old = fs.open(p)
        same = bytes(old.readAllBytes()) == data
        old.close()
        if same:
            return "reused_identical"
        if not overwrite:
            raise FileExistsError(f"{path} has other bytes")
        state = "overwritten"
    out = fs.create(p, True)
    out.write(bytearray(data))
    out.close()
    return state


def rename_file(spark: SparkSession, old: str, new: str) -> None:
    fs, p = _file_system(spark, old)
    if not fs.rename(p, _file_system(spark, new)[1]):
        raise OSError(f"{old} could not be renamed to {new}")


def write_csv(rows: DataFrame, path: str, columns: list[str], *, strict: bool = False, files: int | None = None) -> None:
    """Columns in order with a header. strict: other columns are an error. The committer makes the write atomic."""
    extra = set(rows.columns) - set(columns)
    if strict and extra:
        raise ValueError(f"columns not in the schema: {sorted(extra)}")
    out = rows.select(*columns)
    (out.coalesce(files) if files else out).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_template(rows: DataFrame, path: str) -> None:
    """Write only where nothing is."""
    rows.write.mode("ignore").option("header", True).csv(path)


def label_files(lines: DataFrame, sample: str, order: str, line: str, split: str) -> DataFrame:
    """split, sample, label_lines, and path and content of one file a sample: `labels/<split>/<sample>.txt`, lines in order."""
    each = F.struct(F.col(order).alias("o"), F.col(line).alias("l"))
    packed = lines.groupBy(split, sample).agg(F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["l"]), "\n").alias("label_lines"))
    path = F.concat(F.lit("labels/"), F.col(split), F.lit("/"), F.col(sample).cast("string"), F.lit(".txt"))
    return packed.withColumns({"path": path, "content": F.concat("label_lines", F.lit("\n")).cast("binary")})


def label_dataset(lines: DataFrame, root: str, sample: str, order: str, line: str, split: str, names: Sequence[str]) -> DataFrame:
    """A detector's data set below root: a label file a sample, a list of samples for each split, and data.yaml.
    Returns split, sample, label_lines.

    Executors write the label files and the commit puts them in place; files that are there with the same lines are kept.
    """
    kept = stash(label_files(lines, sample, order, line, split), "labels")
    write_files(kept, root, replace=True)
    kept.select(F.col(split).alias("split"), F.concat(F.lit("images/"), F.col(split), F.lit("/"), F.col(sample).cast("string")).alias("value")).repartition("split").sortWithinPartitions("value").write.mode("overwrite").partitionBy("split").text(f"{root}/lists")
    spark = lines.sparkSession
    splits = sorted(r[0] for r in kept.select(split).distinct().collect())  # a few splits
    yaml = "".join([f"path: {root}\n", *[f"{s}: lists/split={s}\n" for s in splits], f"nc: {len(names)}\n", "names: [" + ", ".join(names) + "]\n"])
    write_bytes(spark, f"{root}/data.yaml", yaml.encode(), overwrite=True)
    return kept.select(split, sample, "label_lines")


def json_report(**parts: DataFrame) -> DataFrame:
    """One row, one JSON object: each part an array of its rows by their first column, or an object if it is one row
    named with a leading `one_`. For reports: a part is a short table."""
    out = None
    for name, df in parts.items():
        rows = F.array_sort(F.collect_list(F.struct(*df.columns)))
        value = df.agg((rows[0] if name.startswith("one_") else rows).alias(name.removeprefix("one_")))
        out = value if out is None else out.crossJoin(F.broadcast(value))  # one row each
    return out.select(F.to_json(F.struct(*out.columns), {"ignoreNullFields": "false"}).alias("report"))


def export(rows: DataFrame, path: str, kind: str) -> str:
    """Write rows as json lines, csv or an html table below path/kind; returns where."""
    out = f"{path}/{kind}"
    if kind == "json":
        write_json_lines(rows, out)
    elif kind == "csv":
        write_csv(rows, out, rows.columns)
    elif kind == "html":
        clean = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        cells = F.concat(*[F.concat(F.lit("<td>"), clean(c), F.lit("</td>")) for c in rows.columns])
        rows.select(F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("value")).write.mode("overwrite").text(out)
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return out


def hash_manifest(files: DataFrame, path: str, content: str, include: Sequence[str], exclude: str | None = None) -> DataFrame:
    """line, size of files below one of the folders `include` whose path does not match `exclude`, each path once, by path."""
    p = F.col(path)
    below = F.lit(False)
    for root in include:
        below = below | p.startswith(root.rstrip("/") + "/")
    kept = files.where(below if exclude is None else below & ~p.rlike(exclude)).dropDuplicates([path])
    return file_digests(kept, path, content).select(F.concat("sha256", F.lit("  "), "path").alias("line"), "size")


def file_digests(files: DataFrame, path: str, content: str) -> DataFrame:
    """path, sha256, size, by path."""
    return files.select(F.col(path).alias("path"), F.sha2(F.col(content).cast("binary"), 256).alias("sha256"), F.octet_length(F.col(content).cast("binary")).alias("size")).orderBy("path")


def folder_digest(digests: DataFrame) -> DataFrame:
    """One digest over path, NUL, sha256 and newline of every file by path. For folders, whose listing fits a task."""
    each = F.array_sort(F.collect_list(F.struct("path", "sha256")))
    text = F.array_join(F.transform(each, lambda x: F.concat(x["path"], F.lit("\u0000"), x["sha256"], F.lit("\n"))), "")
    return digests.agg(F.sha2(text, 256).alias("digest"), F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def plan_writes(new: DataFrame, existing: DataFrame, overwrite: bool = False) -> DataFrame:
    """new(path, sha256) with action: write, reused_identical, overwrite or conflict, against existing(path, sha256)."""
    old = existing.select("path", F.col("sha256").alias("_old"))
    action = F.when(F.col("_old").isNull(), "write").when(F.col("_old") == F.col("sha256"), "reused_identical").otherwise("overwrite" if overwrite else "conflict")
    return new.join(old, "path", "left").withColumn("action", action).drop("_old")


def verify_manifest(lines: DataFrame, actual: DataFrame, line: str = "value") -> DataFrame:
    """path, problem of manifest lines `<sha>  <path>` whose file is missing or differs in actual(path, sha256)."""
    want = lines.select(F.regexp_extract(line, r"^([0-9a-fA-F]{64})\s+(.+)$", 1).alias("want"), F.regexp_extract(line, r"^([0-9a-fA-F]{64})\s+(.+)$", 2).alias("path")).where("path <> ''")
    both = want.join(actual.select("path", "sha256"), "path", "left")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.lower("want") != F.lower("sha256"), "mismatch")
    return both.select("path", problem.alias("problem")).where("problem is not null")


def safe_path(root: Column, relative: Column) -> Column:
    """root/relative, or null if it would leave root."""
    bad = F.exists(F.split(F.translate(relative, "\\", "/"), "/"), lambda p: p == "..") | relative.startswith("/") | relative.rlike("^[A-Za-z]:")
    return F.when(~bad, F.concat(root, F.lit("/"), relative))
