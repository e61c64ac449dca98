"""Files as rows (file_id, filename, content), archives expanded, bytes decoded."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P

_RAW = "file_id string, filename string, bytes binary"


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Every file below path as (file_id, filename, bytes), archives expanded."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    name = F.element_at(F.split("path", "/"), -1)
    return expand_archives(reader.load(path).select(F.substring(F.md5("path"), 1, 12).alias("file_id"), name.alias("filename"), F.col("content").alias("bytes")))


def inline_files(spark: SparkSession, files: list[tuple[str, str]]) -> DataFrame:
    """(filename, content) pairs that a caller holds as (file_id, filename, content)."""
    rows = [(f"{k}", name, content) for k, (name, content) in enumerate(files)]
    return spark.createDataFrame(rows, "file_id string, filename string, content string")


def resolve(files: DataFrame, assets: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Files joined to their assets, optionally only some ids; a file without asset drops out."""
    wanted = files if ids is None else files.where(F.col("file_id").isin(ids))
    return wanted.join(assets, "asset_id")


def archive_kind(content: Column) -> Column:
    """zip, gzip or tar by the first bytes; null for other files."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head == "504B0304", "zip").when(F.startswith(head, F.lit("1F8B08")), "gzip").when(F.decode(F.substring(content, 258, 5), "ISO-8859-1") == "ustar", "tar")


def _members(name: str, kind: str, raw: bytes) -> Iterator[tuple[str, bytes]]:
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for m in z.infolist():
                if not m.is_dir():
                    yield f"{name}:{m.filename}", z.read(m)
    elif kind == "gzip":
        yield name.removesuffix(".gz") if name.endswith(".gz") else f"{name}.decompressed", gzip.decompress(raw)
    else:
        with tarfile.open(fileobj=io.BytesIO(raw)) as t:
            for m in t:
                if m.isfile():
                    yield f"{name}:{m.name}", t.extractfile(m).read()


def _expand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for r in frame.itertuples():
            try:
                for name, raw in _members(r.filename, r.kind, r.bytes):
                    yield pd.DataFrame({"file_id": [r.file_id], "filename": [name], "bytes": [raw]})
            except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError):
                yield pd.DataFrame({"file_id": [r.file_id], "filename": [r.filename], "bytes": [r.bytes]})


def expand_archives(files: DataFrame) -> DataFrame:
    """zip, gzip and tar members as files of their own (archive:member); a broken archive stays as it is."""
    tagged = files.withColumn("kind", archive_kind(F.col("bytes")))
    plain = tagged.where("kind is null").select("file_id", "filename", "bytes")
    return plain.unionByName(tagged.where("kind is not null").mapInPandas(_expand, _RAW))


def decode_bytes(files: DataFrame) -> DataFrame:
    """(file_id, filename, content): UTF-8 where valid, else Latin-1."""
    text = F.when(F.is_valid_utf8(F.col("bytes").cast("string")), F.col("bytes").cast("string")).otherwise(F.decode("bytes", "ISO-8859-1"))
    return files.select("file_id", "filename", text.alias("content"))


def digest(files: DataFrame) -> DataFrame:
    """What an upload records: file_id, filename, size and SHA-256."""
    return files.select("file_id", "filename", F.length("bytes").cast("long").alias("size"), F.sha2("bytes", 256).alias("sha256"))


def magic(content: Column) -> Column:
    """The binary format that the first bytes tell; null if none."""
    head = F.hex(F.substring(content, 1, 8))
    return F.coalesce(*[F.when(F.startswith(head, F.lit(m)), F.lit(name)) for m, name in P.MAGIC])


def is_binary_name(filename: Column) -> Column:
    return F.lower(filename).rlike(r"\.(" + "|".join(P.BINARY_EXTENSIONS) + ")$")
