"""Byte ranges of files, and manifests of folders that don't open what they list."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range at most.
MOST = 4 << 20


@dataclass
class Range(InputPartition):
    path: str
    offset: int
    length: int


def _opened(path: str):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store, inner


class ByteRanges(DataSource):
    """``spark.read.format("byte_ranges").option("paths", ...)``: (path, offset, bytes), one row a range, each read by itself.

    Options: ``paths``, comma-separated files that executors can reach; ``size``, bytes of a range (1 to 4 MiB; the last one of a file is
    shorter); ``offset`` and ``length`` for one range of each file instead, which must lie within it. A range is a task's work, so a large file is
    read by many tasks, and a lost one reads its range again.
    """

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "path string, offset long, bytes binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = [p for p in options.get("paths", "").split(",") if p]
        self.size = int(options.get("size", MOST))
        self.offset = int(options["offset"]) if "offset" in options else None
        self.length = int(options.get("length", self.size))
        if not 1 <= self.size <= MOST or not 1 <= self.length <= MOST:
            raise ValueError(f"a range has 1 to {MOST} bytes")

    def partitions(self) -> list[Range]:
        out = []
        for path in self.paths:
            store, inner = _opened(path)
            there = store.get_file_info(inner)
            if not there.is_file:
                raise FileNotFoundError(path)
            if self.offset is None:
                out += [Range(path, at, min(self.size, there.size - at)) for at in range(0, there.size, self.size)]
            elif self.offset < 0 or self.offset + self.length > there.size:
                raise ValueError(f"the range exceeds {path}, which has {there.size} bytes")
            else:
                out.append(Range(path, self.offset, self.length))
        return out

    def read(self, partition: Range) -> Iterator[tuple[str, int, bytes]]:
        store, inner = _opened(partition.path)
        with store.open_input_file(inner) as f:
            f.seek(partition.offset)
            data = f.read(partition.length)
        if len(data) != partition.length:
            raise OSError(f"{partition.path} became shorter while it was read")
        yield partition.path, partition.offset, data


def byte_ranges(spark: SparkSession, paths: list[str], size: int = MOST, offset: int | None = None, length: int | None = None) -> DataFrame:
    """(path, offset, bytes): all ranges of ``size`` bytes of each file, or the one at ``offset``."""
    spark.dataSource.register(ByteRanges)
    read = spark.read.format("byte_ranges").option("paths", ",".join(paths)).option("size", size)
    if offset is not None:
        read = read.option("offset", offset).option("length", length or size)
    return read.load()


def listing(spark: SparkSession, folder: str, most: int = 50_000, depth: int = 32, skip: tuple[str, ...] = ()) -> DataFrame:
    """(path, size, modified, depth) of the files under a folder, out of the store's own listing: no file is opened.

    Folders are listed level by level, and names in ``skip`` or with a leading dot aren't entered; beyond ``most`` files it is refused.
    """
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    base = fs.getFileStatus(root).getPath().toString().rstrip("/")
    level, rows = [root], []
    for at in range(depth + 1):
        below = []
        for path in level:
            for status in fs.listStatus(path):
                name = status.getPath().getName()
                if name in skip or name.startswith("."):
                    continue
                if status.isDirectory():
                    below.append(status.getPath())
                else:
                    rows.append((status.getPath().toString()[len(base) + 1 :], status.getLen(), status.getModificationTime(), at))
            if len(rows) > most:
                raise ValueError(f"more than {most} files under {folder}")
        level = below
    return spark.createDataFrame(rows, "path string, size long, modified long, depth int")
