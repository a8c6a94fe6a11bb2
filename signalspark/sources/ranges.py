"""Files of any size as byte ranges, by Python data sources that Spark deals out by file and range.

A partition is a stretch of one file; it is read in pieces, each with the first bytes of what follows, so that nothing
that is shorter than the overlap is missed at a border, and a task holds one piece. Paths may be files or folders of any
file system that pyarrow.fs opens by URI; without a scheme they are local ones or mounts that all machines share.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .containers import MAGIC


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path within it."""
    local = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in local else (fs.LocalFileSystem(), local)


def listed(paths: Sequence[str]) -> list[tuple[str, int]]:
    """(path, length) of all files, folders looked through; names that begin with . or _ are left out, as Spark does."""
    out = []
    for path in paths:
        system, inner = opened(path)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        prefix = path[: len(path) - len(inner)] if path.endswith(inner) else "file:"
        files = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.is_file]
        root = "" if info.is_file else inner
        out += [(prefix + f.path, f.size) for f in files if not any(part[:1] in "._" for part in f.path[len(root) :].strip("/").split("/")) or info.is_file]
    return sorted(out)


@dataclass
class Stretch(InputPartition):
    """Bytes from `start` up to `stop` of a file of `length` bytes."""

    path: str
    start: int
    stop: int
    length: int


class _Ranges(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split("\n") if p]
        self.size, self.overlap = int(options.get("size", 8 << 20)), int(options.get("overlap", 64))
        self.stretch = max(self.size, int(options.get("stretch", 256 << 20)) // self.size * self.size)
        self.most = int(options.get("most", 2000))
        if self.size < 1 or self.overlap < 0 or self.most < 1:
            raise ValueError("size and most are 1 or more, overlap 0 or more")

    def partitions(self) -> Sequence[InputPartition]:
        files = listed(self.paths)
        # the driver keeps something of every task, so of many stretches longer ones are made; a piece stays as long as it is
        stretch = max(self.stretch, -(-sum(n for _, n in files) // (max(1, self.most - len(files)) * self.size)) * self.size)
        return [Stretch(path, a, min(a + stretch, n), n) for path, n in files for a in range(0, n, stretch)] or [Stretch("", 0, 0, 0)]

    def pieces(self, part: Stretch) -> Iterator[tuple[int, int, bytes]]:
        """(start, own, bytes): pieces in order, each with bytes that the next one owns, `overlap` at most."""
        if part.stop <= part.start:
            return
        system, inner = opened(part.path)
        with system.open_input_file(inner) as file:
            for start in range(part.start, part.stop, self.size):
                own = min(self.size, part.stop - start)
                data = file.read_at(min(own + self.overlap, part.length - start), start)
                yield start, own, data


class _Bytes(_Ranges):
    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for start, own, data in self.pieces(partition):
            columns = [pa.array([x], kind) for x, kind in ((partition.path, pa.string()), (partition.length, pa.int64()), (start, pa.int64()), (own, pa.int64()), (data, pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["path", "length", "start", "own", "content"])


class _Hits(_Ranges):
    def __init__(self, options: dict):
        super().__init__(options)
        self.overlap = max(map(len, MAGIC.values())) - 1

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for start, own, data in self.pieces(partition):
            found = sorted((start + at, name) for name, sign in MAGIC.items() for at in places(data, sign, own))
            if found:
                columns = [pa.array([partition.path] * len(found), pa.string()), pa.array([n for _, n in found], pa.string()), pa.array([at for at, _ in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["path", "format", "offset"])


def places(data: bytes, sign: bytes, own: int) -> Iterator[int]:
    """Where a sign begins within the first `own` bytes."""
    at = data.find(sign)
    while 0 <= at < own:
        yield at
        at = data.find(sign, at + 1)


class ByteRanges(DataSource):
    """Format `byte_ranges`: (path, length, start, own, content). Options: path (several: a line each), size, overlap,
    stretch, the bytes of a partition, and most, how many partitions there are (one for each file at least)."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "path string, length long, start long, own long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Bytes(self.options)


class SignatureHits(DataSource):
    """Format `signature_hits`: (path, format, offset) of every signature of MAGIC, found where the bytes are read."""

    @classmethod
    def name(cls) -> str:
        return "signature_hits"

    def schema(self) -> str:
        return "path string, format string, offset long"

    def reader(self, schema) -> DataSourceReader:
        return _Hits(self.options)


def _loaded(spark: SparkSession, source: type[DataSource], paths: str | Sequence[str], options: dict) -> DataFrame:
    spark.dataSource.register(source)
    given = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.format(source.name()).options(**options).option("path", "\n".join(given)).load()


def byte_ranges(spark: SparkSession, paths: str | Sequence[str], *, size: int = 8 << 20, overlap: int = 64, stretch: int = 256 << 20, most: int = 2000) -> DataFrame:
    """(path, length, start, own, content): the files in pieces of `size` bytes, each followed by up to `overlap` bytes of
    the next; the first `own` bytes of the content are the piece's. An empty file has no piece."""
    return _loaded(spark, ByteRanges, paths, {"size": size, "overlap": overlap, "stretch": stretch, "most": most})


def signature_hits(spark: SparkSession, paths: str | Sequence[str], *, size: int = 8 << 20, stretch: int = 256 << 20, most: int = 2000) -> DataFrame:
    """(path, format, offset): every place with the signature of an embedded format, once, in files of any size."""
    return _loaded(spark, SignatureHits, paths, {"size": size, "stretch": stretch, "most": most})
