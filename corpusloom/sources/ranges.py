"""Files of any size as ranges of bytes: a data source whose partitions are ranges, digests in chunks, flat arrays.

Every task opens its file through the file system that the path names (file:, hdfs:, s3:, gs: as Arrow knows them) and
reads its own range in chunks, so one large file is many tasks and no task holds more than a chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK = 1 << 20
#: Bytes of a file that one task reads, where ranges can be read on their own.
RANGE = 64 << 20
#: Small files that one task reads, as long as they have no more bytes than a range.
TASK_FILES = 64
BYTES, DIGESTS = "path string, at bigint, content binary", "path string, length bigint, sha256 string"


def _open(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, inner


def _files(path: str) -> list[tuple[str, int]]:
    """Files below a path, or the file itself, by name, without hidden ones; the prefix of the path is kept."""
    from pyarrow import fs

    system, inner = _open(path)
    info = system.get_file_info(inner)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else path.split("/")[0] + "//"
    return sorted((prefix + x.path, x.size) for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))


class _Range(NamedTuple):
    path: str
    first: int
    last: int


class _Ranges(InputPartition):
    """Ranges that one task reads, one after another."""

    def __init__(self, ranges: list[_Range]):
        self.ranges = ranges


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.chunk, self.digest = options["path"], int(options.get("chunk", CHUNK)), options.get("digest") == "true"
        self.range = int(options.get("range", RANGE)) // self.chunk * self.chunk or self.chunk

    def partitions(self):
        step = lambda size: max(size, 1) if self.digest else self.range
        tasks, held = [], 0
        for p, size in _files(self.path):
            for a in range(0, max(size, 1), step(size)):
                part = _Range(p, a, min(size, a + step(size)))
                if not tasks or held + part.last - part.first > self.range or len(tasks[-1]) == TASK_FILES:
                    tasks.append([])
                    held = 0
                tasks[-1].append(part)
                held += part.last - part.first
        return [_Ranges(x) for x in tasks]

    def read(self, task: _Ranges) -> Iterator[pa.RecordBatch]:
        for part in task.ranges:
            yield from self._read(part)

    def _read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        system, inner = _open(part.path)
        h, at = hashlib.sha256(), part.first
        with system.open_input_file(inner) as f:
            f.seek(at)
            while at < part.last:
                held = f.read(min(self.chunk, part.last - at))
                if not held:
                    raise OSError(f"{part.path} became shorter")
                if self.digest:
                    h.update(held)
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([part.path]), pa.array([at], pa.int64()), pa.array([held], pa.binary())], names=["path", "at", "content"])
                at += len(held)
        if self.digest:
            yield pa.RecordBatch.from_arrays([pa.array([part.path]), pa.array([at], pa.int64()), pa.array([h.hexdigest()])], names=["path", "length", "sha256"])


class ByteRanges(DataSource):
    """`byte_ranges`: (path, at, content) in chunks of `chunk` bytes, a task for each `range`; with digest=true (path, length,
    sha256), where a file is in one task, as SHA-256 goes from front to back. Small files share a task."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return DIGESTS if self.options.get("digest") == "true" else BYTES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def _load(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(ByteRanges)
    return spark.read.format("byte_ranges").options(path=path, **options).load()


def file_digests(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """(path, length, sha256) of files of any size, hashed in chunks."""
    return _load(spark, path, digest="true", chunk=str(chunk))


def flat_array(spark: SparkSession, path: str, kind: str = "<u2", chunk: int = CHUNK, size: int = RANGE) -> DataFrame:
    """(path, start, ids): the numbers of flat files in pieces, each with the place of its first number in its file.

    A file that does not end with a whole number is an error.
    """
    width = np.dtype(kind).itemsize
    held = _load(spark, path, chunk=str(max(chunk // width, 1) * width), range=str(size))

    def numbers(batches):
        for b in batches:
            for p, at, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if len(content) % width:
                    raise ValueError(f"{p} does not end with a whole number")
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([at // width], pa.int64()), pa.array([np.frombuffer(content, kind).astype(np.int64)], pa.list_(pa.int64()))], names=["path", "start", "ids"])

    return held.mapInArrow(numbers, "path string, start bigint, ids array<bigint>")
