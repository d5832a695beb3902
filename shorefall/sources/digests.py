"""SHA-256 of files of any size: a data source with a partition for each group of files, read in blocks into the digest."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK = 4 << 20
#: Files that are small go to one task together, up to this many bytes or files.
GROUP_BYTES, GROUP_FILES = 1 << 30, 4096


def _filesystem(path: str):
    """(pyarrow file system, path on it) of a path or URI."""
    from pyarrow import fs

    if urlparse(path).scheme in ("", "file"):
        return fs.LocalFileSystem(), os.path.abspath(urlparse(path).path if path.startswith("file:") else path)
    return fs.FileSystem.from_uri(path)


class _Files(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(names)
        self.names = names


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        from pyarrow import fs

        system, root = _filesystem(self.path)
        found = sorted((f.path, f.size or 0) for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File)
        groups: list[list[str]] = []
        held = 0
        for name, size in found:
            if not groups or held + size > GROUP_BYTES or len(groups[-1]) == GROUP_FILES:
                groups.append([])
                held = 0
            groups[-1].append(os.path.relpath(name, root))
            held += size
        return [_Files(g) for g in groups] or [_Files([])]

    def read(self, partition) -> Iterator[tuple]:
        system, root = _filesystem(self.path)
        for name in partition.names:
            sha, size = hashlib.sha256(), 0
            with system.open_input_stream(f"{root}/{name}") as f:
                while block := f.read(BLOCK):
                    sha.update(block)
                    size += len(block)
            yield name, size, sha.hexdigest()


class FileDigests(DataSource):
    """(file, bytes, sha256) of all files below a folder; file is the path from the folder."""

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return "file string, bytes long, sha256 string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Digests of the files below a folder that all executors reach (a path, or a URI of a pyarrow file system); a task holds one block."""
    spark.dataSource.register(FileDigests)
    return spark.read.format(FileDigests.name()).option("path", path).load()
