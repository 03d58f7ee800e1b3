"""Whole files and archives as data sources: a file is read by one task, in pieces, so its size is bounded by nothing but time.

Files are opened through Arrow's file systems, by the scheme of their path (local files, s3, gs, hdfs).  Large
files are a partition each; small ones share partitions of about PARTITION_BYTES.
"""

from __future__ import annotations

import hashlib
import io
import json
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes that are read at a time, files that share a partition, and lines of a batch.
PIECE_BYTES, PARTITION_BYTES, LINES = 8 << 20, 128 << 20, 10_000


def opened(path: str) -> pa.NativeFile:
    """A file of any file system that Arrow knows, to be read from any place."""
    system, place = pyarrow.fs.FileSystem.from_uri(f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file://") else path)
    return system.open_input_file(place)


def lines_of(path: str, member: str) -> Iterator[str]:
    """The non-blank lines of the one member of a zip or tar archive whose name ends in `member`."""
    with opened(path) as file:
        if zipfile.is_zipfile(file):
            archive = zipfile.ZipFile(file)
            names, content = archive.namelist(), archive.open
        else:
            file.seek(0)
            archive = tarfile.open(fileobj=file)
            names, content = archive.getnames(), archive.extractfile
        found = [n for n in names if n.endswith(member)]
        if len(found) != 1:
            raise ValueError(f"{path}: {len(found)} members end in {member}")
        with content(found[0]) as stream:
            for line in io.TextIOWrapper(stream, "utf-8"):
                if line.strip():
                    yield line.rstrip("\r\n")


def digest_of(path: str) -> tuple[int, str]:
    """(bytes, SHA-256) of a file."""
    made, size = hashlib.sha256(), 0
    with opened(path) as file:
        while piece := file.read(PIECE_BYTES):
            made.update(piece)
            size += len(piece)
    return size, made.hexdigest()


class _Files(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.files, self.member = json.loads(options["files"]), options.get("member")

    def partitions(self) -> list[InputPartition]:
        packs, room = [], 0
        for path, size in self.files:
            if size > room:
                packs.append([])
                room = PARTITION_BYTES
            packs[-1].append(path)
            room -= size
        return [InputPartition(pack) for pack in packs]


class _LineReader(_Files):
    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for path in partition.value:
            held: list[str] = []
            for line in lines_of(path, self.member):
                held.append(line)
                if len(held) == LINES:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * LINES), pa.array(held)], ["archive", "line"])
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(held)), pa.array(held)], ["archive", "line"])


class _DigestReader(_Files):
    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for path in partition.value:
            size, digest = digest_of(path)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([digest])], ["path", "bytes", "sha256"])


class ArchiveLines(DataSource):
    """(archive, line) of the member of each archive that its option `member` names the end of."""

    @classmethod
    def name(cls) -> str:
        return "archive_lines"

    def schema(self) -> str:
        return "archive string, line string"

    def reader(self, schema) -> DataSourceReader:
        return _LineReader(self.options)


class FileDigests(DataSource):
    """(path, bytes, sha256) of each file."""

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return "path string, bytes long, sha256 string"

    def reader(self, schema) -> DataSourceReader:
        return _DigestReader(self.options)


def _read(spark: SparkSession, source: type[DataSource], path: str, **options: str) -> DataFrame:
    """A data source over the files that Spark lists under `path`: names and sizes, as many as there will be partitions or a few times that."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").orderBy("path").collect()
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(files=json.dumps([list(r) for r in listed]), **options).load()


def archive_lines(spark: SparkSession, path: str, member: str) -> DataFrame:
    """(archive, line): the non-blank lines of the one member of each zip or tar archive whose name ends in `member`; another number of such members raises."""
    return _read(spark, ArchiveLines, path, member=member)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files of a folder, its subfolders and patterns."""
    return _read(spark, FileDigests, path)
