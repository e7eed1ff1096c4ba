"""JSON lines as a data source of Spark: files are read by ranges of bytes, and appended by a commit.

A write stages one file a task and names it in its message to the driver; only when all tasks are done does the driver move
these files among the data, under names that the job and the partition give. What a task wrote that was lost, repeated or
aborted is never moved, and a commit that is repeated finds its files in place, so each row of a job is there once.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

STAGING = "_staging"


def _at(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    fs, at = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
    return fs, at.rstrip("/")


@dataclass
class Range(InputPartition):
    """The lines of a file that begin at start or behind it, and before end."""

    file: str
    start: int
    end: int


class LinesReader(DataSourceReader):
    """Each partition is a range of bytes; a line belongs to the range that its first byte is in."""

    def __init__(self, path: str, schema: StructType, size: int):
        self.path, self.names, self.size = path, schema.names, size

    def partitions(self) -> list[Range]:
        fs, at = _at(self.path)
        found = fs.get_file_info(pyarrow.fs.FileSelector(at, recursive=False, allow_not_found=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", ".")))
        return [Range(f, a, min(a + self.size, n)) for f, n in files for a in range(0, n, self.size)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.file:
            return
        fs, _ = _at(self.path)
        with io.BufferedReader(fs.open_input_file(partition.file), 1 << 20) as f:
            at = max(0, partition.start - 1)
            f.seek(at)
            if partition.start:
                at += len(f.readline())  # up to the end of the line that the byte before is in
            while at < partition.end:
                line = f.readline()
                if not line:
                    return
                at += len(line)
                if line.strip():
                    row = json.loads(line)
                    yield tuple(row.get(n) for n in self.names)


@dataclass
class Staged(WriterCommitMessage):
    file: str
    partition: int


class LinesWriter(DataSourceWriter):
    def __init__(self, path: str, names: list[str], job: str):
        self.path, self.names, self.job = path, names, job

    def write(self, iterator: Iterator) -> Staged:
        fs, at = _at(self.path)
        task = TaskContext.get()
        staged = f"{at}/{STAGING}/{self.job}/{task.partitionId()}-{task.attemptNumber()}-{uuid.uuid4().hex}"
        fs.create_dir(staged.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(staged) as out:
            for row in iterator:
                kept = {n: v for n, v in zip(self.names, row, strict=True) if v is not None}
                out.write((json.dumps(kept, ensure_ascii=False, default=str) + "\n").encode())
        return Staged(staged, task.partitionId())

    def commit(self, messages: list[Staged | None]) -> None:
        fs, at = _at(self.path)
        for m in messages:
            if m is not None:
                to = f"{at}/{self.job}-{m.partition:06d}.jsonl"
                if fs.get_file_info(to).type == pyarrow.fs.FileType.NotFound:
                    fs.move(m.file, to)
        self._clear(fs, at)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*_at(self.path))

    def _clear(self, fs: pyarrow.fs.FileSystem, at: str) -> None:
        if fs.get_file_info(f"{at}/{STAGING}/{self.job}").type != pyarrow.fs.FileType.NotFound:
            fs.delete_dir(f"{at}/{STAGING}/{self.job}")


class JsonLines(DataSource):
    """format("siftline_lines"): a folder of JSON lines, with a schema given by the reader. Options: path; range_bytes, the
    size of a partition (128 MB); job, a name under which a repeated append adds nothing."""

    @classmethod
    def name(cls) -> str:
        return "siftline_lines"

    def reader(self, schema: StructType) -> LinesReader:
        return LinesReader(self.options["path"], schema, int(self.options.get("range_bytes", 128 << 20)))

    def writer(self, schema: StructType, overwrite: bool) -> LinesWriter:
        if overwrite:
            raise ValueError("rows can only be appended")
        return LinesWriter(self.options["path"], schema.names, self.options.get("job") or uuid.uuid4().hex)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonLines)
