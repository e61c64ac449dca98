"""Lines of archive members of any size, as a data source: spark.read.format("archive_lines").load(path).

Each archive is a partition. Its members are unpacked as a stream and their
lines come in batches of a bounded size; neither archive nor member is ever a
value. Members are those of zip, tar (packed or not) and gzip files; other files
are read as they are. A member is UTF-8 if all of it is valid, else Latin-1, as
in files.decode_bytes(), so it is read twice, once for the decision.
"""

from __future__ import annotations

import codecs
import gzip
import hashlib
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .lines import BREAK

SCHEMA = "file_id string, filename string, line_no long, line string"
#: Bytes unpacked at a time, and characters of lines in a batch.
CHUNK, BATCH_CHARS = 1 << 20, 1 << 22

_BREAK = re.compile(BREAK)


def _located(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("file:///", "file:/").replace("file:/", "file:///"))


def _chunks(opened: Callable[[], BinaryIO]) -> Iterator[bytes]:
    with opened() as f:
        while raw := f.read(CHUNK):
            yield raw


def _is_utf8(opened: Callable[[], BinaryIO]) -> bool:
    decoder = codecs.getincrementaldecoder("utf-8")()
    try:
        for raw in _chunks(opened):
            decoder.decode(raw)
        decoder.decode(b"", True)
    except UnicodeDecodeError:
        return False
    return True


def lines_in(opened: Callable[[], BinaryIO]) -> Iterator[str]:
    """The lines of a stream; an end of line at the very end opens no further line. One line is held at a time."""
    decoder = codecs.getincrementaldecoder("utf-8" if _is_utf8(opened) else "latin-1")()
    held: list[str] = []  # the pieces of the line that goes on
    carried = ""  # a carriage return may be half of an end of line
    some = False
    for raw in _chunks(opened):
        text = carried + decoder.decode(raw)
        carried = ""
        if text.endswith("\r"):
            text, carried = text[:-1], "\r"
        first, *rest = _BREAK.split(text)
        held.append(first)
        some = some or bool(text) or bool(carried)
        for line in rest:
            yield "".join(held)
            held = [line]
    if carried:
        yield "".join(held)
        held = [""]
    if some and (last := "".join(held)):
        yield last


def _tar_members(system: fs.FileSystem, path: str, name: str) -> Iterator[tuple[str, Callable[[], BinaryIO]]]:
    with system.open_input_file(path) as raw, tarfile.open(fileobj=raw, mode="r:*") as t:
        for m in t:
            if m.isfile():
                yield f"{name}:{m.name}", lambda m=m: t.extractfile(m)


def _zip_members(system: fs.FileSystem, path: str, name: str) -> Iterator[tuple[str, Callable[[], BinaryIO]]]:
    with system.open_input_file(path) as raw, zipfile.ZipFile(raw) as z:
        for m in z.infolist():
            if not m.is_dir():
                yield f"{name}:{m.filename}", lambda m=m: z.open(m)


def members(path: str) -> Iterator[tuple[str, Callable[[], BinaryIO]]]:
    """(name, how to open it) of each member; a file that is no archive, or a broken one, is its own."""
    system, at = _located(path)
    name = at.rpartition("/")[2]
    with system.open_input_file(at) as f:
        head = f.read(512)
    plain = lambda: system.open_input_stream(at, compression=None)
    if head[:4] == b"PK\x03\x04":
        try:
            with system.open_input_file(at) as f, zipfile.ZipFile(f):
                whole = True
        except (zipfile.BadZipFile, pa.ArrowInvalid, OSError):
            whole = False
        if whole:
            yield from _zip_members(system, at, name)
        else:
            yield name, plain
    elif head[257:262] == b"ustar":
        yield from _tar_members(system, at, name)
    elif head[:2] == b"\x1f\x8b":
        unpacked = lambda: gzip.GzipFile(fileobj=system.open_input_file(at))
        with unpacked() as f:
            inner = f.read(512)
        if inner[257:262] == b"ustar":
            yield from _tar_members(system, at, name)
        else:
            yield name.removesuffix(".gz") if name.endswith(".gz") else f"{name}.decompressed", unpacked
    else:
        yield name, plain


class Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ArchiveReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        found = []
        for path in self.paths:
            system, at = _located(path)
            info = system.get_file_info(at)
            files = system.get_file_info(fs.FileSelector(at, recursive=True)) if info.type == fs.FileType.Directory else [info]
            prefix = path[: len(path.rstrip("/")) - len(at.rstrip("/"))]
            found += [Archive(prefix + f.path) for f in files if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
        return sorted(found, key=lambda p: p.path)

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        for name, opened in members(partition.path):
            # members of an archive are files of their own
            own = hashlib.md5(f"{partition.path}:{name}".encode()).hexdigest()[:12]
            first, lines, size = 1, [], 0
            for line in lines_in(opened):
                lines.append(line)
                size += len(line)
                if size >= BATCH_CHARS or len(lines) >= 50_000:
                    yield _batch(own, name, first, lines)
                    first, lines, size = first + len(lines), [], 0
            if lines:
                yield _batch(own, name, first, lines)


def _batch(own: str, name: str, first: int, lines: list[str]) -> pa.RecordBatch:
    n = len(lines)
    return pa.RecordBatch.from_arrays([pa.repeat(own, n), pa.repeat(name, n), pa.array(range(first, first + n), pa.int64()), pa.array(lines, pa.string())], ["file_id", "filename", "line_no", "line"])


class ArchiveLines(DataSource):
    """Options: path, a file or a folder (of any file system that Arrow opens)."""

    @classmethod
    def name(cls) -> str:
        return "archive_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader([self.options["path"]])


def read_archive_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, filename, line_no, line) of all members of the archives at path."""
    spark.dataSource.register(ArchiveLines)
    return spark.read.format("archive_lines").load(path)
