"""Tables and log lines rendered from them, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def registry():
    """A dict of queries and a decorator that fills it: @query(sql)."""
    found: dict = {}

    def query(sql: str | None = None):
        def put(f):
            found[f.__name__] = (f, sql)
            return f

        return put

    return found, query


_LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' ELSE 'INFO' END"
_CENTS = "CAST(round(value * 100) AS BIGINT)"
_STATUS = "CASE WHEN event_id % 11 = 0 THEN 503 WHEN event_id % 7 = 0 THEN 404 ELSE 200 END"


def _lines(spark: SparkSession, d: str, line: str, where: str = "true") -> DataFrame:
    e = table(spark, d, "events").where(where)
    return e.selectExpr("cast(user_id as string) as file_id", "concat('user_', user_id, '.log') as filename", "event_id + 1 as line_no", f"{line} as line")


def _cte(line: str) -> str:
    return f"lines AS (SELECT CAST(user_id AS VARCHAR) AS file_id, 'user_' || user_id || '.log' AS filename, event_id + 1 AS line_no, {line} AS line FROM events)"


def logfmt_lines(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d, f"concat('ts=', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), ' user_id=', user_id, ' level=', {_LEVEL}, ' type=', event_type, ' cents=', {_CENTS}, ' msg=\"', event_type, ' by ', user_id, '\" user_id=', user_id % 10)")


LOGFMT = _cte(f"'ts=' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' user_id=' || user_id || ' level=' || {_LEVEL} || ' type=' || event_type || ' cents=' || {_CENTS} || ' msg=\"' || event_type || ' by ' || user_id || '\" user_id=' || user_id % 10")


def syslog_lines(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d, f"concat('<', event_id % 192, '>', date_format(ts, 'MMM d HH:mm:ss'), ' host-', user_id, ' ', event_type, 'd[', event_id, ']: ', upper(event_type), '_SEEN: cents=', {_CENTS}, ' state=', {_LEVEL})")


SYSLOG = _cte(f"'<' || event_id % 192 || '>' || strftime(ts, '%b %-d %H:%M:%S') || ' host-' || user_id || ' ' || event_type || 'd[' || event_id || ']: ' || upper(event_type) || '_SEEN: cents=' || {_CENTS} || ' state=' || {_LEVEL}")


def access_lines(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d, f"concat('10.0.', user_id % 256, '.', event_id % 256, ' - u', user_id, ' [', date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000] \"GET /', event_type, '/', event_id, ' HTTP/1.1\" ', {_STATUS}, ' ', {_CENTS}, if(event_id % 3 = 0, ' \"-\" \"curl/8\"', ''))")


ACCESS = _cte(f"'10.0.' || user_id % 256 || '.' || event_id % 256 || ' - u' || user_id || ' [' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000] \"GET /' || event_type || '/' || event_id || ' HTTP/1.1\" ' || {_STATUS} || ' ' || {_CENTS} || CASE WHEN event_id % 3 = 0 THEN ' \"-\" \"curl/8\"' ELSE '' END")


def json_text_lines(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d, "if(event_id % 13 = 0, concat('{\"id\": ', event_id), concat('{\"id\": ', event_id, ', \"payload\": ', props, ', \"who\": {\"user\": ', user_id, ', \"tags\": [\"', event_type, '\", \"x\"]}}'))")


JSON_TEXT = _cte("CASE WHEN event_id % 13 = 0 THEN '{\"id\": ' || event_id ELSE '{\"id\": ' || event_id || ', \"payload\": ' || props || ', \"who\": {\"user\": ' || user_id || ', \"tags\": [\"' || event_type || '\", \"x\"]}}' END")


def trace_lines(spark: SparkSession, d: str) -> DataFrame:
    """Errors with stack frames and causes, and blank lines between."""
    return _lines(spark, d, "case event_type when 'view' then concat('    at com.example.C', event_id) when 'click' then concat('Caused by: E', event_id) when 'signup' then '' else concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' ', upper(event_type), ' ', event_id) end")


TRACE = _cte("CASE event_type WHEN 'view' THEN '    at com.example.C' || event_id WHEN 'click' THEN 'Caused by: E' || event_id WHEN 'signup' THEN '' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || upper(event_type) || ' ' || event_id END")


def document_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every document."""
    t = table(spark, d, "documents").where("text is not null")
    return t.select(F.col("doc_id").cast("string").alias("file_id"), F.concat("source", F.lit(".txt")).alias("filename"), F.posexplode(F.split("text", "\n")).alias("at", "line")).selectExpr("file_id", "filename", "cast(at + 1 as bigint) as line_no", "line")


DOC_LINES = r"""doc_parts AS (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
lines AS (SELECT CAST(doc_id AS VARCHAR) AS file_id, source || '.txt' AS filename, CAST(i AS BIGINT) AS line_no, parts[i] AS line
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM doc_parts))"""
BLANK = r"regexp_replace(line, '\s', '', 'g') = ''"


def sample_sql(n: int) -> str:
    """CTE s: non-blank ones of the first n lines with their position."""
    return f"s AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS nth FROM lines) WHERE nth <= {n} AND NOT ({BLANK}))"
