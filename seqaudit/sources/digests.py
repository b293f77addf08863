"""File digests as a data source of its own: files of any size are hashed in pieces.

``binaryFile`` holds a whole file in one cell, so it ends at 2 GB. This source lists the files
below a folder on the driver, deals them to partitions by size, and each task streams its
files through the hash ``PIECE`` bytes at a time. A sha256 is sequential, so one file is one
task's work; its memory is one piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PIECE = 4 << 20
#: A partition ends at this many bytes or files.
PARTITION_BYTES, PARTITION_FILES = 256 << 20, 1000


def _store(path: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path in it, prefix of the paths that are returned)."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path, "file:"
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/"), "file:"
    store, inside = fs.FileSystem.from_uri(path)
    return store, inside, path.partition("://")[0] + "://"


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class DigestReader(DataSourceReader):
    def __init__(self, path: str, piece: int):
        self.path, self.piece = path, piece

    def partitions(self) -> list[Files]:
        store, inside, _ = _store(self.path)
        top = store.get_file_info(inside)
        if top.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [top] if top.is_file else store.get_file_info(fs.FileSelector(inside, recursive=True))
        # hidden files and folders are left out, as Spark's own sources do
        shown = [f for f in found if f.is_file and not any(p[:1] in "._" for p in f.path[len(inside):].split("/") if p)]
        parts: list[Files] = []
        held = 0
        for f in sorted(shown, key=lambda f: (-f.size, f.path)):
            if not parts or held + f.size > PARTITION_BYTES or len(parts[-1].files) >= PARTITION_FILES:
                parts.append(Files([]))
                held = 0
            parts[-1].files.append((f.path, f.size))
            held += f.size
        return parts

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _, prefix = _store(self.path)
        rows = []
        for path, size in partition.files:
            digest = hashlib.sha256()
            with store.open_input_stream(path, compression=None) as stream:
                while piece := stream.read(self.piece):
                    digest.update(piece)
            rows.append((prefix + path, size, digest.hexdigest()))
        columns = list(zip(*rows)) or [(), (), ()]
        types = (pa.string(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["path", "size", "sha256"])


class FileDigests(DataSource):
    """``spark.read.format("file_digests").load(folder)``: path, size and sha256 of every file below it."""

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return "path string, size bigint, sha256 string"

    def reader(self, schema) -> DigestReader:
        return DigestReader(self.options["path"], int(self.options.get("piece", PIECE)))


def file_digests(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    spark.dataSource.register(FileDigests)
    return spark.read.format("file_digests").option("piece", piece).load(path)
