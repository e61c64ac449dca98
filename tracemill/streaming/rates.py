"""Structured Streaming: log lines as they arrive, error rates by time, sessions, template counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S


def line_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """New text files below path as a stream of (filename, line)."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(path).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("filename"), F.col("value").alias("line"))


def timed(lines: DataFrame) -> DataFrame:
    """Lines with the time and the level they state; lines without time are dropped."""
    return lines.withColumn("at", S.as_timestamp(S.first_timestamp(F.col("line")))).where("at is not null").withColumn("level", S.infer_level(F.col("line")))


def error_rate(events: DataFrame, window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """window start, n, n_errors, error_rate; lines later than the watermark are left out."""
    w = F.window("at", window, slide) if slide else F.window("at", window)
    n_errors = F.count_if(F.col("level").isin("ERROR", "FATAL", "CRITICAL"))
    g = events.withWatermark("at", late).groupBy(w.alias("w")).agg(F.count("*").alias("n"), n_errors.alias("n_errors"))
    return g.select(F.col("w.start").alias("start"), "n", "n_errors", (F.col("n_errors") / F.col("n")).alias("error_rate"))


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of events of a key without a gap: start, end, n."""
    g = events.withWatermark("at", late).groupBy(key, F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def template_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """How often each template occurs in each window."""
    d = events.withColumn("skeleton", S.skeleton(F.col("line")))
    g = d.withWatermark("at", late).groupBy(F.window("at", window).alias("w"), S.template_id(F.col("skeleton")).alias("template_id")).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), "template_id", "n")


def write_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Processes what has arrived and stops; a rerun goes on where this ended."""
    return df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
