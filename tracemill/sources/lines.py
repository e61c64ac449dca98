"""Lines of files: (file_id, filename, line_no, line), line_no from 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Where a text breaks into lines.
BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def lines_of(files: DataFrame) -> DataFrame:
    """One row for each line of content; an end of line at the very end opens no further line."""
    body = F.regexp_replace("content", f"(?:{BREAK})$(?![\\s\\S])", "")
    parts = F.when(F.length("content") > 0, F.split(body, BREAK))
    return files.select("file_id", "filename", F.posexplode(parts).alias("at", "line")).select("file_id", "filename", (F.col("at") + 1).cast("long").alias("line_no"), "line")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of large text files without holding a file whole: splits are read in parallel.

    line_no orders the lines of a file and has gaps between splits.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    raw = raw.withColumn("at", F.monotonically_increasing_id())
    return raw.select(F.substring(F.md5("path"), 1, 12).alias("file_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), (F.col("start") * 2**20 + F.col("at") % 2**33 + 1).alias("line_no"), F.col("value").alias("line"))


def sample(lines: DataFrame, n: int) -> DataFrame:
    """The non-blank ones of the first n lines of each file, numbered by pos from 1."""
    first = Window.partitionBy("file_id").orderBy("line_no")
    top = lines.withColumn("at", F.row_number().over(first)).where(F.col("at") <= n).where(F.trim(F.regexp_replace("line", r"\s", " ")) != "")
    return top.withColumn("pos", F.row_number().over(first)).drop("at")
