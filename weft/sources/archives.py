"""Delimited members of ZIP and tar archives as partitions."""

from __future__ import annotations

import gzip
import io
import json
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MEMBERS = (".tsv", ".txt", ".csv", ".tsv.gz", ".txt.gz", ".csv.gz")
#: Rows that are held at once.
CHUNK_ROWS = 50_000


def opened(path: str) -> io.BufferedReader:
    """A file for random access, on the local disk or in a store that Arrow knows."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    system, inner = (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)
    return io.BufferedReader(_Seekable(system.open_input_file(inner)), 1 << 20)


class _Seekable(io.RawIOBase):
    """An Arrow file, or `size` bytes of it from `start` on, as a raw stream."""

    def __init__(self, file, start: int = 0, size: int | None = None) -> None:
        self.file, self.start, self.size, self.at = file, start, file.size() - start if size is None else size, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = max(0, (0, self.at, self.size)[whence] + offset)
        return self.at

    def readinto(self, buffer) -> int:
        n = max(0, min(len(buffer), self.size - self.at))
        if n:
            data = self.file.read_at(n, self.start + self.at)
            buffer[: len(data)] = data
            n = len(data)
        self.at += n
        return n


@dataclass
class Member(InputPartition):
    """A member of an archive; start: its first byte if it lies there as it is; a compressed tar archive (name None) is one partition."""

    path: str
    order: int
    name: str | None
    start: int | None = None
    size: int | None = None


def members(path: str, order: int = 0) -> list[Member]:
    """The delimited members of an archive, from a ZIP file's directory or a tar file's headers; nothing else is read."""
    with opened(path) as f:
        head = f.read(512)
        if head.lstrip().lower().startswith((b"<!doctype", b"<html")):
            raise ValueError("a web page instead of an archive")
        f.seek(0)
        if head[:2] == b"PK":
            with zipfile.ZipFile(f) as z:
                return [Member(path, order + i, n) for i, n in enumerate(z.namelist()) if n.endswith(MEMBERS)]
        if head[:2] == b"\x1f\x8b":
            return [Member(path, order, None)]
        with tarfile.open(fileobj=f, mode="r:") as t:
            return [Member(path, order + i, m.name, m.offset_data, m.size) for i, m in enumerate(t) if m.isfile() and m.name.endswith(MEMBERS)]


def _streams(member: Member) -> Iterator[tuple[str, io.BufferedIOBase]]:
    """Names and contents of a partition's members, as streams."""
    with opened(member.path) as f:
        if member.start is not None:
            yield member.name, io.BufferedReader(_Seekable(f.raw.file, member.start, member.size), 1 << 20)
        elif member.name is None:
            with tarfile.open(fileobj=f, mode="r:gz") as t:
                for m in t:
                    if m.isfile() and m.name.endswith(MEMBERS):
                        yield m.name, t.extractfile(m)
        else:
            with zipfile.ZipFile(f) as z, z.open(member.name) as inner:
                yield member.name, inner


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths, self.columns, self.origin = json.loads(options["paths"]), json.loads(options["columns"]), options.get("origin") == "true"

    def partitions(self) -> list[Member]:
        out: list[Member] = []
        for path in self.paths:
            out += members(path, len(out))
        return out or [Member("", 0, "")]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        for name, stream in _streams(partition):
            sep, plain = "," if ".csv" in name else "\t", gzip.open(stream) if name.endswith(".gz") else stream
            place = 0
            for chunk in pd.read_csv(plain, sep=sep, dtype=str, usecols=self.columns, chunksize=CHUNK_ROWS):
                arrays = [pa.array(chunk[c].astype(object).where(chunk[c].notna(), None), pa.string()) for c in self.columns]
                if self.origin:
                    arrays += [pa.array([name] * len(chunk)), pa.array(range(place, place + len(chunk)), pa.int64())]
                place += len(chunk)
                yield pa.RecordBatch.from_arrays(arrays, [*self.columns, *(["member", "row"] if self.origin else [])])


class Archives(DataSource):
    """Format `weft_archives`: options paths and columns as JSON lists, origin (true: also member and row, the place in it)."""

    @classmethod
    def name(cls) -> str:
        return "weft_archives"

    def schema(self) -> str:
        return ", ".join([*[f"`{c}` string" for c in json.loads(self.options["columns"])], *(["member string", "row long"] if self.options.get("origin") == "true" else [])])

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def table(spark: SparkSession, path: str, columns: list[str], origin: bool = False) -> DataFrame:
    """Delimited members of the archives that `path` (a file, folder or glob) finds, all strings. Each member of a ZIP or tar file is a task, which streams
    it in chunks, whatever its size; a compressed tar archive can't be entered in the middle and is one. Web pages are refused."""
    paths = sorted(r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect())  # names only
    spark.dataSource.register(Archives)
    return spark.read.format("weft_archives").options(paths=json.dumps(paths), columns=json.dumps(columns), origin=str(origin).lower()).load()
