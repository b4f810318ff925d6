"""Integrity of large files before anything opens them: hashes and CRC-32 by chunks, and the members of archives.

A file is read in byte ranges, each by a task of its own, a mebibyte at a time. CRCs of ranges are
combined into the file's (a CRC is linear, so what follows a range shifts its CRC by that length); digests of
ranges into one digest of the file's list of them, so a file that changed is told, and the range that did.
Members of a ZIP archive are read one by one and held against the CRCs in its directory.
"""

from __future__ import annotations

import hashlib
import zipfile
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK, READ = 64 << 20, 1 << 20
CHUNKS = "file string, start long, bytes long, crc32 long, sha256 string"
MEMBERS = "file string, member string, bytes long, sound boolean"
POLYNOMIAL = 0xEDB88320  # fixed value: CRC-32 as in ZIP and gzip


# ---- CRC of joined ranges


def _times(matrix: tuple[int, ...], vector: int) -> int:
    total = 0
    for row in matrix:
        if vector & 1:
            total ^= row
        vector >>= 1
    return total


@lru_cache(maxsize=64)
def _zeros(k: int) -> tuple[int, ...]:
    """The linear map that appending 2^k zero bytes makes of a CRC."""
    if k == 0:
        out = []
        for bit in range(32):
            crc = 1 << bit
            for _ in range(8):
                crc = crc >> 1 ^ (POLYNOMIAL if crc & 1 else 0)
            out.append(crc)
        return tuple(out)
    half = _zeros(k - 1)
    return tuple(_times(half, row) for row in half)


def joined_crc(first: int, second: int, second_bytes: int) -> int:
    """The CRC of two ranges, one after the other."""
    k = 0
    while second_bytes:
        if second_bytes & 1:
            first = _times(_zeros(k), first)
        second_bytes >>= 1
        k += 1
    return first ^ second


def _joined(chunks: pa.Array) -> pa.Array:
    out = []
    for row in chunks.to_pylist():
        crc = 0
        for c in row:
            crc = joined_crc(crc, c["crc32"], c["bytes"])
        out.append(crc)
    return pa.array(out, pa.int64())


# ---- data sources


def _files(path: str) -> list[tuple[str, int]]:
    system, folder = fs.FileSystem.from_uri(path)
    info = system.get_file_info(folder)
    if info.type == fs.FileType.NotFound:
        raise ValueError(f"no such path: {path}")
    found = [info] if info.type == fs.FileType.File else [x for x in system.get_file_info(fs.FileSelector(folder, recursive=True)) if x.type == fs.FileType.File]
    return sorted((x.path, x.size) for x in found)


class ChunkSource(DataSource):
    """Options: path (a file or folder, as a URI), chunk_bytes."""

    @classmethod
    def name(cls) -> str:
        return "file_chunks"

    def schema(self) -> str:
        return CHUNKS

    def reader(self, schema) -> DataSourceReader:
        return ChunkReader(self.options)


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("chunk_bytes", CHUNK))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((file, start, min(start + self.size, size))) for file, size in _files(self.path) for start in range(0, max(size, 1), self.size)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        file, start, stop = partition.value
        crc, sha, at = 0, hashlib.sha256(), start
        with fs.FileSystem.from_uri(self.path)[0].open_input_file(file) as f:
            f.seek(start)
            while at < stop and (data := f.read(min(READ, stop - at))):
                crc, at = zlib.crc32(data, crc), at + len(data)
                sha.update(data)
        yield file, start, at - start, crc, sha.hexdigest()


class MemberSource(DataSource):
    """Options: path (a ZIP archive or a folder of them, as a URI)."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> DataSourceReader:
        return MemberReader(self.options)


class MemberReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def _open(self, file: str) -> zipfile.ZipFile:
        return zipfile.ZipFile(fs.FileSystem.from_uri(self.path)[0].open_input_file(file))

    def partitions(self) -> list[InputPartition]:
        out = []
        for file, _ in _files(self.path):
            try:
                with self._open(file) as z:
                    out += [InputPartition((file, i.filename)) for i in z.infolist() if not i.is_dir()]
            except (zipfile.BadZipFile, pa.ArrowInvalid):  # the latter where a file is too short to have a directory
                out.append(InputPartition((file, None)))
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        file, member = partition.value
        if member is None:
            yield file, None, None, False
            return
        size, sound = 0, True
        with self._open(file) as z:
            try:
                with z.open(member) as f:
                    while data := f.read(READ):
                        size += len(data)
            except (zipfile.BadZipFile, zlib.error, EOFError):
                sound = False  # the directory's CRC, or the compressed data, doesn't hold
        yield file, member, size, sound


def _uri(path: str) -> str:
    return path if "://" in path else f"file://{path}"


def chunk_hashes(spark: SparkSession, path: str, chunk_bytes: int = CHUNK) -> DataFrame:
    """(file, start, bytes, crc32, sha256) of each range of each file."""
    spark.dataSource.register(ChunkSource)
    return spark.read.format("file_chunks").options(path=_uri(path), chunk_bytes=chunk_bytes).load()


def file_hashes(chunks: DataFrame) -> DataFrame:
    """(file, bytes, crc32, tree): of whole files; tree is the digest of the ranges' digests in order (a row of them for each file)."""
    ordered = F.sort_array(F.collect_list(F.struct("start", "bytes", "crc32", "sha256")))
    rows = chunks.groupBy("file").agg(ordered.alias("c"))
    return rows.select("file", F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x["bytes"]).alias("bytes"), F.arrow_udf(_joined, "long")("c").alias("crc32"), F.sha2(F.array_join(F.transform("c", lambda x: x["sha256"]), ""), 256).alias("tree"))


def changed_chunks(now: DataFrame, sealed: DataFrame) -> DataFrame:
    """(file, start, problem): ranges that are `changed`, `missing` or `extra` against the sealed ones."""
    a, b = now.select("file", "start", F.struct("bytes", "sha256").alias("now")), sealed.select("file", "start", F.struct("bytes", "sha256").alias("was"))
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "extra").when(F.col("now") != F.col("was"), "changed")
    return a.join(b, ["file", "start"], "full").select("file", "start", problem.alias("problem")).where("problem is not null")


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(file, member, bytes, sound): each member read and held against its CRC; a file that is no archive has a null member."""
    spark.dataSource.register(MemberSource)
    return spark.read.format("zip_members").options(path=_uri(path)).load()
