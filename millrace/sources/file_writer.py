"""One file a row, written by executors and put in place by a commit.

    spark.dataSource.register(FilePerRow)
    rows.write.format("file_per_row").option("path", root).mode("append").save()

rows have `path` (relative to root) and `content` (binary). Tasks write new files to a staging folder below root; when all
have, the commit moves them to their places, and when one fails nothing of the job stays. A file that is there already with
the same bytes is left as it is; one with other bytes fails the job, unless the option `replace` is true. The option `report`
names a folder for JSON lines of path, sha256, size and state (written, reused_identical or overwritten).
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .ranges import file_system


@dataclass
class Staged(WriterCommitMessage):
    folder: str


class FilePerRow(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_per_row"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("use mode append; the option replace says whether files may change")
        return _Writer(self.options["path"], self.options.get("report"), self.options.get("replace", "false").lower() == "true")


class _Writer(DataSourceWriter):
    def __init__(self, root: str, report: str | None, replace: bool):
        self.root, self.report, self.replace = root.rstrip("/"), report, replace
        self.staging = f"{self.root}/_staging-{uuid.uuid4().hex}"
        fs, staging = file_system(self.staging)  # made here, once: a task that is still at work after an abort finds no folder
        fs.create_dir(staging, recursive=True)

    def write(self, iterator: Iterator) -> Staged:
        fs, staging = file_system(f"{self.staging}/{uuid.uuid4().hex}")
        root = file_system(self.root)[1]
        fs.create_dir(staging, recursive=False)
        with fs.open_output_stream(f"{staging}/moves") as moves, fs.open_output_stream(f"{staging}/report") as report:
            for n, row in enumerate(iterator):
                path, content = row["path"], bytes(row["content"])
                if path.startswith("/") or ".." in path.split("/") or "\\" in path:
                    raise ValueError(f"{path} leaves the folder")
                state = self._state(fs, f"{root}/{path}", content)
                if state != "reused_identical":
                    with fs.open_output_stream(f"{staging}/{n}") as out:
                        out.write(content)
                    moves.write(json.dumps([f"{staging}/{n}", f"{root}/{path}"]).encode() + b"\n")
                line = {"path": path, "sha256": hashlib.sha256(content).hexdigest(), "size": len(content), "state": state}
                report.write(json.dumps(line).encode() + b"\n")
        return Staged(staging)

    def _state(self, fs, path: str, content: bytes) -> str:
        from pyarrow.fs import FileType

        info = fs.get_file_info(path)
        if info.type == FileType.NotFound:
            return "written"
        if info.size == len(content):
            with fs.open_input_stream(path) as f:
                if f.read() == content:
                    return "reused_identical"
        if not self.replace:
            raise FileExistsError(f"{path} has other bytes")
        return "overwritten"

    def commit(self, messages: list) -> None:
        fs, staging = file_system(self.staging)
        for k, m in enumerate(x for x in messages if x is not None):
            with fs.open_input_stream(f"{m.folder}/moves") as f:
                for line in f.read().splitlines():
                    old, new = json.loads(line)
                    fs.create_dir(new.rsplit("/", 1)[0], recursive=True)
                    fs.move(old, new)
            if self.report:
                report = file_system(self.report)[1]
                fs.create_dir(report, recursive=True)
                fs.move(f"{m.folder}/report", f"{report}/part-{k:05d}.json")
        self._clear(fs, staging)

    def abort(self, messages: list) -> None:
        self._clear(*file_system(self.staging))

    @staticmethod
    def _clear(fs, staging: str) -> None:
        from pyarrow.fs import FileType

        for _ in range(20):  # other tasks of a job that failed may be writing yet
            if fs.get_file_info(staging).type != FileType.Directory:
                return
            try:
                fs.delete_dir(staging)
            except OSError:
                time.sleep(0.1)


def write_files(rows: DataFrame, root: str, *, replace: bool = False, report: str | None = None) -> DataFrame | None:
    """Write rows(path, content) as files below root; with report, a folder not yet there, its lines come back."""
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(FilePerRow)
    out = rows.selectExpr("cast(path as string) as path", "cast(content as binary) as content").write.format("file_per_row").option("path", root).option("replace", str(replace).lower())
    (out.option("report", report) if report else out).mode("append").save()
    return spark.read.schema("path string, sha256 string, size bigint, state string").json(report) if report else None
