"""Text out of binary files: how binary they are, and what can be decoded from them."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from .files import magic

LOW_ENTROPY, BINARY_SHARE = 4.0, 0.1
# Lines around a base64 frame.
FRAME = r"(?is)(?:^|\n)[ \t]*(?:BEGIN_B64|BASE64_START|B64_BEGIN)[ \t]*\r?\n(.*?)\n[ \t]*(?:END_B64|BASE64_END|B64_END)[ \t]*(?=\r?\n|$)"


def unprintable_share(text: Column) -> Column:
    """Share of characters in the first 100 lines that can't be shown."""
    head = F.substring_index(text, "\n", 100)
    kept = F.regexp_replace(head, r"[\n\r]", "")
    odd = F.length(F.regexp_replace(kept, r"[^\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f�]", ""))
    return F.coalesce(odd / F.greatest(F.length(kept), F.lit(1)), F.lit(0.0))


def _entropy(files: DataFrame, symbols: Column) -> DataFrame:
    """file_id, entropy of an array of symbols, 0 if empty: they are counted by Spark, so that a large file is many small rows."""
    n = files.select("file_id", F.explode_outer(symbols).alias("s")).groupBy("file_id", "s").agg(F.count("s").alias("k"))
    total, spread = F.sum("k"), F.coalesce(F.sum(F.col("k") * F.log2("k")), F.lit(0.0))
    return n.groupBy("file_id").agg(F.coalesce(F.log2(total) - spread / total, F.lit(0.0)).alias("entropy"))


def character_entropy(files: DataFrame) -> DataFrame:
    """file_id, entropy: bits for each character of content."""
    return _entropy(files, F.filter(F.split("content", ""), lambda c: c != ""))


def byte_entropy(files: DataFrame) -> DataFrame:
    """file_id, entropy: bits for each of the bytes."""
    return _entropy(files, F.regexp_extract_all(F.hex("bytes"), F.lit("(..)"), F.lit(1)))


def base64_text(text: Column) -> Column:
    """The texts of base64 frames, one after the other."""
    frames = F.regexp_extract_all(text, F.lit(FRAME), F.lit(1))
    return F.array_join(F.transform(frames, lambda x: F.make_valid_utf8(F.try_to_binary(F.regexp_replace(x, r"\s", ""), F.lit("base64")).cast("string"))), "\n")


def hex_text(text: Column) -> Column:
    """The texts of lines that are hex digits only, 16 or more; an odd last digit is left out."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x.rlike(P.CONTINUOUS_HEX))
    even = F.transform(lines, lambda x: F.substring(x, F.lit(1), F.floor(F.length(x) / 2).cast("int") * 2))
    return F.array_join(F.filter(F.transform(even, lambda x: F.trim(F.make_valid_utf8(F.unhex(x).cast("string")))), lambda x: x != ""), "\n")


def printable_text(content: Column) -> Column:
    """Runs of four or more printable characters, a line each."""
    return F.array_join(F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(f"({P.PRINTABLE_RUN})"), F.lit(1)), "\n")


def gutter_text(text: Column) -> Column:
    """What stands between bars at the end of hex dump lines; null unless a line of it assigns something."""
    parts = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(F.regexp_extract(x, P.HEX_GUTTER, 1))), lambda x: x != "")
    return F.when(F.exists(parts, lambda x: F.contains(x, F.lit("="))), F.array_join(parts, "\n"))


def _inflate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for raw in frame["bytes"]:
            text = ""
            for head in (b"\x78\x9c", b"\x78\x01", b"\x78\xda"):
                if (at := raw.find(head)) >= 0:
                    try:
                        text = zlib.decompress(raw[at:]).decode("utf-8", "ignore")
                        break
                    except zlib.error:
                        continue
            out.append(text)
        yield frame.assign(inflated=out)


def decode(files: DataFrame) -> DataFrame:
    """(file_id, filename, content, kind) of binary files (file_id, filename, bytes).

    Bytes of low entropy are text as they are; of others what zlib, base64
    frames, hex lines and printable runs give, in this order.
    """
    d = files.select("file_id", "filename", "bytes").join(byte_entropy(files), "file_id", "left")
    d = d.mapInPandas(_inflate, "file_id string, filename string, bytes binary, entropy double, inflated string")
    text = F.make_valid_utf8(F.col("bytes").cast("string"))
    found = F.array(F.col("inflated"), base64_text(text), hex_text(text), printable_text(F.col("bytes")))
    joined = F.array_join(F.filter(found, lambda x: F.coalesce(x, F.lit("")) != ""), "\n")
    return d.select("file_id", "filename", F.when(F.coalesce("entropy", F.lit(0.0)) < LOW_ENTROPY, text).otherwise(joined).alias("content"), magic(F.col("bytes")).alias("kind"))
