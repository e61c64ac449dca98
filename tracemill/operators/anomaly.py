"""Findings on parsed units (file_id, start_line, end_line, raw, fields, confidence)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scalars as S
from ..sources.shared import written

SEVERITIES = ("critical", "high", "medium", "low")
COLUMNS = ("file_id", "type", "severity", "message", "line_start", "line_end", "confidence")


def _finding(kind: str, severity: str, message: Column, start: Column, end: Column, confidence: Column) -> list[Column]:
    return [F.col("file_id"), F.lit(kind).alias("type"), F.lit(severity).alias("severity"), message.alias("message"), start.cast("long").alias("line_start"), end.cast("long").alias("line_end"), confidence.cast("double").alias("confidence")]


def _percent(c: Column) -> Column:
    return F.concat(F.bround(c * 100, 0).cast("int").cast("string"), F.lit("%"))


def is_error(raw: Column, level: Column) -> Column:
    """A level that means an error, or a word for one in the text."""
    return F.coalesce(F.upper(level).isin(*P.ERROR_LEVELS), F.lit(False)) | F.lower(raw).rlike("error|fatal|critical|panic")


def _ratio(units: DataFrame, hit: Column, key: str = "file_id") -> DataFrame:
    return units.withColumn("hit", hit).groupBy(key).agg(F.avg(F.col("hit").cast("double")).alias("ratio"), F.min(F.when(F.col("hit"), F.col("start_line"))).alias("a"), F.max(F.when(F.col("hit"), F.col("end_line"))).alias("b"))


def format_drift(units: DataFrame) -> DataFrame:
    """Files in which more than a quarter of the units have a confidence below .4."""
    r = F.col("ratio")
    return _ratio(units, F.col("confidence") < 0.4).where(r > 0.25).select(*_finding("format_drift", "high", F.concat(F.lit("Potential format drift detected ("), _percent(r), F.lit(" low-confidence units).")), F.col("a"), F.col("b"), F.least(F.lit(0.95), 0.5 + r)))


def security(units: DataFrame) -> DataFrame:
    """Units with an injection or script payload, one finding each."""
    found = units.withColumn("kind", S.attack(F.col("raw"))).where("kind is not null")
    return found.select(*_finding("security_pattern", "critical", F.lit("Potential injection or script payload detected in log data."), F.col("start_line"), F.col("end_line"), F.lit(0.9)))


def schema_breakage(null_rates: DataFrame) -> DataFrame:
    """Fields (file_id, field, null_rate, start_line, end_line) that are null in nine of ten units."""
    r = F.col("null_rate")
    return null_rates.where(r >= 0.9).select(*_finding("schema_breakage", "medium", F.concat(F.lit("Field '"), F.col("field"), F.lit("' has "), _percent(r), F.lit(" null rate, suggesting schema mismatch.")), F.col("start_line"), F.col("end_line"), F.least(F.lit(0.95), r)))


def error_density(units: DataFrame) -> DataFrame:
    """Files in which three of ten units or more speak of errors."""
    r = F.col("ratio")
    hit = is_error(F.col("raw"), F.try_element_at("fields", F.lit("log_level")))
    return _ratio(units, hit).where(r >= 0.3).select(*_finding("high_error_density", "high", F.concat(F.lit("High error density detected ("), _percent(r), F.lit(" of parsed units indicate errors).")), F.col("a"), F.col("b"), F.least(F.lit(0.95), 0.4 + r)))


def field_null_rates(units: DataFrame) -> DataFrame:
    """file_id, field, null_rate, start_line, end_line over all fields that occur in a file."""
    n = units.groupBy("file_id").agg(F.count("*").alias("n"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))
    held = units.select("file_id", F.explode("fields").alias("field", "value")).groupBy("file_id", "field").agg(F.count("value").alias("held"))
    return held.join(n, "file_id").select("file_id", "field", F.bround(1 - F.col("held") / F.col("n"), 3).alias("null_rate"), "start_line", "end_line")


def report(units: DataFrame) -> DataFrame:
    """All findings on all files. What the rules ask of the units is written once, so that lines are parsed once."""
    units = written(units.select("file_id", "start_line", "end_line", "raw", "fields", "confidence"))
    return reduce(DataFrame.unionByName, [format_drift(units), security(units), schema_breakage(field_null_rates(units)), error_density(units)])


def summary(findings: DataFrame) -> DataFrame:
    """How many findings of each severity, zero included."""
    return findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
